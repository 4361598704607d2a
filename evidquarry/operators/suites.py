"""Suite builders: heading paths, question indexes, registry rows and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STACK = "array<struct<level:int,title:string>>"


def heading_paths(text: Column) -> Column:
    """array<string>: the heading path in force at each line, as ``a > b``."""
    lines = F.split(text, "\n")
    start = F.struct(F.array().cast(STACK).alias("stack"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#{1,6})\s+.+?\s*$", 1))
        entry = F.struct(level.alias("level"), F.trim(F.regexp_extract(line, r"^#{1,6}\s+(.+?)\s*$", 1)).alias("title"))
        stack = F.when(
            level > 0, F.concat(F.filter(acc["stack"], lambda s: s["level"] < level), F.array(entry))
        ).otherwise(acc["stack"])
        path = F.array_join(F.transform(stack, lambda s: s["title"]), " > ")
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(path)).alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def question_index(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Questions with their group and routed sections, one row per question."""
    group = F.explode(F.split(F.col(text_col), r"(?m)(?=^##\s+\[QUESTION-)"))
    parts = documents.select(id_col, group.alias("g")).where(F.col("g").rlike(r"^##\s+\[QUESTION-"))
    asked = F.regexp_extract("g", r"(?s)(?:Equivalent questions:|Preguntas equivalentes:)(.*?)(?:\n(?:(?:Priority\s+)?Routes?|Rutas?)|\z)", 1)
    routed = F.regexp_extract("g", r"(?is)\n(?:(?:Priority\s+)?Routes?|Rutas?(?:\s+prioritarias?)?):(.*?)(?:\n\s*\n|\z)", 1)
    return parts.select(
        id_col,
        F.regexp_extract("g", r"^##\s+\[(QUESTION-[A-Z0-9-]+)\]", 1).alias("group_id"),
        F.array_distinct(F.regexp_extract_all(routed, F.lit(r"\[([A-Z][A-Z0-9-]+)\]"), 1)).alias("sections"),
        F.explode(F.regexp_extract_all(asked, F.lit(r"(?m)^-\s+[\"“](.+?)[\"”]\s*$"), 1)).alias("question"),
    ).withColumn("answerable", F.col("group_id") != "QUESTION-OUT-OF-SCOPE")


def registry_entries(rows: DataFrame, text_col: str, order: str) -> DataFrame:
    """First constant, id and version of every wire name in table rows."""
    pattern = r"^\|\s*`([A-Z][A-Z0-9_]{3,})`\s*\|\s*`([A-Za-z0-9_]+)`\s*\|\s*(\d+)\s*\|\s*([\d.,]+)\s*\|"

    def part(group: int) -> Column:
        return F.regexp_extract(F.col(text_col), pattern, group)

    found = rows.where(F.col(text_col).rlike(pattern)).select(
        part(2).alias("wire_name"), part(1).alias("constant"), part(3).alias("event_id"),
        F.replace(part(4), F.lit(","), F.lit(".")).alias("version"), F.col(order).alias("_o"),
    )
    first = F.min_by(F.struct("constant", "event_id", "version"), "_o").alias("e")
    return found.groupBy("wire_name").agg(first).select("wire_name", "e.*")


def category(text: Column) -> Column:
    """Document category from its line shapes."""
    lines = F.split(text, "\n")

    def share(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda l: l.rlike(pattern)))

    total = F.greatest(F.size(F.filter(lines, lambda l: F.trim(l) != "")), F.lit(1))
    entities = share(r"^#{3}\s+`[A-Z][A-Z0-9_]*`\s+[—-]\s+id\s+\d+,\s+version\s+[\d.]+\s*$")
    return (
        F.when(entities >= 5, "entity-contract")
        .when(share(r"^\s*\|") / total >= 0.35, "registry-table")
        .when(share(r"^\s*\d+\.\s+\S") / total >= 0.08, "workflow")
        .otherwise("narrative")
    )


def issue_suite(section_chunks: DataFrame, slots: int = 2) -> DataFrame:
    """Two distinct events per section kind, asked in both languages."""
    events = section_chunks.groupBy("section_kind", "source_id", "event_id").agg(
        F.min("ord").alias("ord"), F.min_by("issue_key", "ord").alias("issue_key"), F.count(F.lit(1)).alias("gold")
    )
    nth = F.row_number().over(Window.partitionBy("section_kind").orderBy("ord", "source_id", "event_id"))
    chosen = events.withColumn("slot", nth).where(F.col("slot") <= slots)
    return chosen.withColumn("language", F.explode(F.array(F.lit("en"), F.lit("es")))).select(
        F.concat_ws("-", F.lower("section_kind"), (F.col("slot") - 1).cast("string"), "language").alias("case_id"),
        "section_kind", "issue_key", "event_id", "language", "gold",
    )


def generation_sample(cases: DataFrame, size: int, per_group: int = 4) -> DataFrame:
    """All must-refuse cases, a few per language and section, then round-robin filler.

    *cases*: case_id, ord, answerable, query_language, section. The first two lanes are
    reserved and always whole, so the sample has more than *size* rows where they do not fit;
    the filler takes what they leave. Fillers cannot exceed *size*, so strata are rank-limited
    before the final ordering.
    """
    nth = F.row_number().over(Window.partitionBy("query_language", "section").orderBy("ord"))
    positives = cases.where("answerable").withColumn("rn", nth).where(F.col("rn") <= size + per_group)
    negatives = cases.where(~F.col("answerable")).select("case_id", F.lit(0).alias("lane"))
    few = positives.where(F.col("rn") <= per_group).select("case_id", F.lit(1).alias("lane"))
    reserved = negatives.unionByName(few)
    room = max(0, size - reserved.limit(size).count())
    filler = positives.where(F.col("rn") > per_group).orderBy("rn", "query_language", "section", "ord").limit(room)
    return reserved.unionByName(filler.select("case_id", F.lit(2).alias("lane")))


def row_fingerprints(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 of each row's canonical JSON."""
    return rows.withColumn("digest", F.sha2(F.to_json(F.struct(*columns)), 256))


def set_digest(digests: DataFrame) -> DataFrame:
    """Order-free fingerprint of a row set: count, xor and sum of digest prefixes.

    Constant memory per task, unlike hashing one sorted list of every row. The sum is taken
    modulo 2^64 as a signed number: some 65,000 prefixes add up to more than a bigint holds.
    """
    value = F.conv(F.substring("digest", 1, 12), 16, 10).cast("bigint")
    half, whole = (F.lit(str(2**n)).cast("decimal(20,0)") for n in (63, 64))
    total = F.sum(value.cast("decimal(15,0)"))
    return digests.agg(
        F.count(F.lit(1)).alias("record_count"), F.bit_xor(value).alias("xor_digest"), (F.pmod(total + half, whole) - half).cast("bigint").alias("sum_digest")
    )
