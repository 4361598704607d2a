"""Token counts with the whole-token shortcut.

Once, before any text is read, every vocabulary string that can end a word is put through
the merges; those that come out as one token are proven to need no merging. While counting,
a pre-token among them counts one; only the rest are merged, and the counts of the latest
distinct ones are remembered in a table of bounded size. The vocabulary is a fixed file of
some MB, read on the driver from the path given and sent to the tasks.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a special string inside a
text is one token, as the tokenizer's library does by default; repeated rows each give a
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidquarry.llm.base import table
from evidquarry.llm.pretokens import WORD_RULE, Splitter, Vocabulary, lowered

REMEMBERED = 400_000


def whole_tokens(vocabulary: Vocabulary) -> dict[str, int]:
    """Pre-tokens proven to encode as a single token, each with the count 1."""
    proven = {}
    for (word, ends), number in vocabulary.ids.items():
        if ends and vocabulary.merged(word) == [number]:
            try:
                proven[word.decode()] = 1
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token
    return proven


class Counter:
    def __init__(self, vocabulary: Vocabulary, proven: dict[str, int]):
        self.vocabulary, self.proven, self.counts = vocabulary, proven, dict(proven)
        self.split = Splitter(WORD_RULE)

    def _merge(self, word: str) -> int:
        count = self.counts[word] = len(self.vocabulary.merged(word.encode("utf-8", "surrogatepass")))
        return count

    def tokens(self, text: str) -> int:
        total = 0
        for place, piece in enumerate(self.vocabulary.pieces(text)):
            if place % 2:
                total += 1
                continue
            words = self.split(lowered(piece))
            known = list(map(self.counts.get, words))
            if None in known:
                known = [n or self.counts.get(w) or self._merge(w) for w, n in zip(words, known, strict=True)]
            total += sum(known)
            if len(self.counts) > REMEMBERED + len(self.proven):
                self.counts = dict(self.proven)
        return total


@lru_cache(maxsize=2)
def _parsed(content: str) -> Vocabulary:
    return Vocabulary(content)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit) per document."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    sent = docs.sparkSession.sparkContext.broadcast((content, whole_tokens(_parsed(content))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(_parsed(sent.value[0]), sent.value[1])
        for batch in batches:
            numbers = [counter.tokens(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(numbers, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return (
        docs.select(
            F.col(id_col).alias("id"), F.col(text_col).alias("text"),
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
        .mapInArrow(count, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op5_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_whole_token_counts": op5_whole_token_counts}
ORACLES: dict[str, str] = {}
