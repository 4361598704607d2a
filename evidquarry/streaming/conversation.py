"""The conversation state over a stream of turns: the same marks, folded in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from evidquarry.operators.conversation import marked, resolved_question

STATE = StructType([StructField("asked", StringType()), StructField("told", StringType())])
CARRIED = "conv_id bigint, turn bigint, role string, text string, follow_up boolean, reason string, now string, last_asked string, last_told string"


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    asked, told = state.get if state.exists else (None, None)
    for frame in frames:
        rows = []
        for row in frame.sort_values("turn").itertuples():
            last = (asked, told)
            asked, told = _text(row.asked) or asked, _text(row.told) or told
            rows.append((row.conv_id, row.turn, row.role, _text(row.text), row.follow_up, row.reason, asked, *last))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CARRIED.split(", ")])
    state.update((asked, told))


def folded_stream(turns: DataFrame) -> DataFrame:
    """Rows as the batch fold gives them; the turns of a conversation must arrive in order across batches."""
    carried = marked(turns).groupBy("conv_id").applyInPandasWithState(_step, CARRIED, STATE, "append", GroupStateTimeout.NoTimeout)
    active = F.coalesce("now", "last_told", F.lit(""))
    return carried.where("role = 'user'").select(
        "conv_id", "turn", "follow_up", "reason", active.alias("active_subject"),
        resolved_question(F.coalesce("text", F.lit("")), F.col("follow_up"), F.col("last_asked"), F.col("last_told")).alias("resolved"))
