"""Named repairs of almost-JSON text, and the JSON shape tests, as expressions.

Only the repairs that are plain rewrites are here, applied in their fixed order and
each reported by name. Character-level state machines (closing cut-off documents,
quote conversion inside strings, the width-filling printer) are left out: they would
be a parser in a UDF, not work for Spark.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, functions as F

# A comment outside a double-quoted string; strings are matched first and kept.
_COMMENT = r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/'


def _literals(text: Column) -> Column:
    for word, value in (("None", "null"), ("True", "true"), ("False", "false")):
        text = F.regexp_replace(text, rf"\b{word}\b", value)
    return text


def _one_array(text: Column) -> Column:
    joined = F.concat(F.lit("["), F.regexp_replace(text, r"\}\s*\{", "},{"), F.lit("]"))
    return F.when(text.rlike(r"\}\s*\{"), joined).otherwise(text)


# The repairs by name, in the order in which they apply.
REPAIRS = (
    ("bom", lambda text: F.regexp_replace(text, "^\ufeff+", "")),
    ("smart_quotes", lambda text: F.translate(text, "“”‘’", "\"\"''")),
    ("comments", lambda text: F.regexp_replace(text, _COMMENT, "$1")),
    ("python_literals", _literals),
    ("non_finite_numbers", lambda text: F.regexp_replace(text, r"\b(?:NaN|-?Infinity)\b", "null")),
    ("unquoted_keys", lambda text: F.regexp_replace(text, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_\-]*)(\s*:)", r'$1"$2"$3')),
    ("trailing_commas", lambda text: F.regexp_replace(text, r",(\s*[}\]])", "$1")),
    ("concatenated_objects", _one_array),
)


def repaired(text: Column) -> Column:
    """struct<text, repairs>: the rewritten text and the repairs that changed it."""
    steps = list(accumulate(REPAIRS, lambda value, repair: repair[1](value), initial=text))
    names = F.array_compact(
        F.array(*[F.when(before != after, F.lit(name)) for (name, _), before, after in zip(REPAIRS, steps, steps[1:])])
    )
    return F.struct(steps[-1].alias("text"), names.alias("repairs"))


def unwrapped(text: Column, rounds: int = 5) -> Column:
    """Undo repeated JSON string encoding, at most *rounds* times."""
    value = text
    for _ in range(rounds):
        inner = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "struct<v:string>")["v"]
        value = F.when(value.rlike(r'(?s)^\s*"\s*(?:\\"|[\[{]).*"\s*$') & inner.isNotNull(), inner).otherwise(value)
    return value


def fenced_payload(text: Column) -> Column:
    return F.regexp_extract(text, r"(?is)```[ \t]*(?:json|jsonc|json5)?[ \t]*\r?\n(.*?)```", 1)


def looks_like_payload(text: Column, prose_limit: int) -> Column:
    """Does a long message consist mostly of one JSON document?"""
    bare = F.trim(text)
    inner = F.trim(F.regexp_replace(F.regexp_replace(bare, "^`+|`+$", ""), "(?i)^json", ""))
    body = F.when(bare.startswith("```"), inner).otherwise(bare)
    framed = (body.startswith("{") & body.endswith("}")) | (body.startswith("[") & body.endswith("]"))
    quoted = body.startswith('"') & body.endswith('"') & (body.contains("{") | body.contains("["))
    return (F.length(bare) <= prose_limit) | framed | quoted
