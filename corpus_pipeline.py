"""A corpus pipeline over ``documents``: each stage is one operator of the llm subpackage.

Every stage reads what the one before has kept and written. All but the last return the
columns of ``documents``; stages that filter keep clean documents.

1. language_id: texts without letters, and texts in which no language holds
   ``MIN_SHARE`` of the words, go; a missing ``lang`` is filled in. All labelled rows with an
   id may be learned from; where there are none, texts with letters stay as they are.
2. near_dedup: one document of each group of near copies stays.
3. decontamination: documents that contain a benchmark item go.
4. pii: personal data in the text is replaced by the name of its kind.
5. bpe: the texts are encoded; ids, their digest and that of the decoded text are returned.

Every row is a document of its own, without or with a repeated doc_id too; of a group of near
copies the row with the smallest doc_id stays (of equal ones the first, rows without an id last).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidquarry.llm import bpe, decontamination, language_id, near_dedup, pii
from evidquarry.llm.base import stored, table

MIN_SHARE = 0.35
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learned(docs, F.lit(True))
    if not model:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    texts = docs.select(*COLUMNS).withColumn("_text", F.col("text"))
    seen = language_id.identified(texts, model, "_text", COLUMNS)
    kept = seen.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id())  # one scan of written files: the same in every job
    found = near_dedup.near_duplicates(keyed, "_row")
    copies = stored(found.where("not kept").select("_row", "component_id"), "copies")
    members = copies.unionByName(copies.select(F.col("component_id").alias("_row"), "component_id").distinct())
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    stay = members.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    gone = stored(members.join(stay, "_row", "left_anti").select("_row"), "gone")  # its size is known before the texts move
    return keyed.join(gone, "_row", "left_anti").select(*COLUMNS)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_items(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")))  # also without or with repeated ids
    rows = docs.select(*COLUMNS, key.alias("key"))
    found = pii.personal_data(rows, "key").where("size(spans) > 0").select("key", "spans").dropDuplicates(["key"])
    rows = rows.join(found, "key", "left").select(*COLUMNS, "spans")

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for text, spans, size in zip(batch.column("text"), batch.column("spans"), batch.column("n_chars"), strict=True):
                text, size = text.as_py(), size.as_py()
                if text and spans.is_valid:
                    text = pii.redacted_text(text, [(s["start"], s["kind"], s["end"]) for s in spans.as_py()])
                    size = len(text)
                texts.append(text)
                sizes.append(size)
            kept = {name: batch.column(name) for name in COLUMNS} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))

    schema = ", ".join(f"{f.name} {'long' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in docs.select(*COLUMNS).schema)
    return rows.mapInArrow(redact, schema)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(
        docs, public_tokenizers.path("byte_bpe_50k.json"), columns=("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", _language_id),
    ("near_dedup", _near_dedup),
    ("decontamination", _decontamination),
    ("pii", _pii),
    ("bpe", _bpe),
]

ORACLE_SQL = None  # language and token models have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
