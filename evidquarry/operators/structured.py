"""Exact aggregates over a complete issue snapshot.

Every operator is a plain aggregation with map-side combine. The identity dedup
keeps the last observation through ``max_by``, so a hot identity shrinks to one
row per task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.functions.text import casefold, first_present, fold_accents, parse_values

UNSPECIFIED = "Unspecified"

# Category of a status recorded before categories existed.
LEGACY_STATUS_CATEGORY = {
    "to do": "new",
    "open": "new",
    "in progress": "indeterminate",
    "in review": "indeterminate",
    "qa": "indeterminate",
    "done": "done",
    "closed": "done",
    "resolved": "done",
}
# Words that mean a resolution of "fixed".
FIXED_ALIASES = ("fixed", "resolved", "corregido", "corregida", "resuelto", "resuelta")

MULTI_VALUED = ("labels", "components")
# A section body is cut to this many characters; with at least one character and one
# line break per part, this many parts always cover it.
SECTION_CHARACTERS = 4000
SECTION_PARTS = SECTION_CHARACTERS // 2 + 2


def current_state(chunks: DataFrame) -> DataFrame:
    """Rows describing the present state of an issue."""
    return chunks.where(F.col("chunk_kind") == "CURRENT")


def _values_of(df: DataFrame, field: str) -> Column:
    if field not in df.columns:
        return F.array().cast("array<string>")
    if field in MULTI_VALUED:
        return parse_values(F.col(field))
    return F.filter(F.array(F.trim(F.col(field))), lambda item: item != "")


def _topic_text(df: DataFrame) -> Column:
    parts = [F.coalesce(F.col("title"), F.lit(""))]
    for field in MULTI_VALUED:
        parts.append(F.array_join(_values_of(df, field), " "))
    return fold_accents(F.concat_ws(" ", *parts))


def field_predicate(df: DataFrame, filters: Mapping[str, Sequence[str]]) -> Column:
    """OR within a field, AND across fields, ignoring case."""
    condition = F.lit(True)
    for field, expected in filters.items():
        if field == "topic":
            text = _topic_text(df)
            for value in expected:
                condition = condition & text.contains(fold_accents(F.lit(value)))
            continue
        column = "labels" if field == "topic_alias_label" else field
        actual = _values_of(df, column)
        if field == "status_category_key":
            legacy = F.create_map(
                *[F.lit(item) for pair in LEGACY_STATUS_CATEGORY.items() for item in pair]
            )
            actual = F.when(
                F.size(actual) == 0, F.array_compact(F.array(legacy[fold_accents(F.col("status"))]))
            ).otherwise(actual)
        wanted = F.array(*[casefold(F.lit(value)) for value in expected])
        condition = condition & F.coalesce(
            F.arrays_overlap(F.transform(actual, casefold), wanted), F.lit(False)
        )
    return condition


def last_per_identity(issues: DataFrame, order: str = "ord") -> DataFrame:
    """One row per (cloud, identity): the last observation wins."""
    row = F.struct(*[F.col(c) for c in issues.columns])
    return (
        issues.withColumn("_id", first_present(F.col("source_id"), F.col("issue_key")))
        .where(F.col("_id").isNotNull())
        .groupBy("cloud_id", "_id")
        .agg(F.max_by(row, F.col(order)).alias("_row"))
        .select("_row.*")
    )


def matched_issues(issues: DataFrame, filters: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    current = current_state(issues)
    if filters:
        current = current.where(field_predicate(current, filters))
    return last_per_identity(current)


SNAPSHOT_ROWS = 1_000_000  # a larger snapshot is not given as complete


def snapshot_state(issues: DataFrame, cap: int = SNAPSHOT_ROWS) -> DataFrame:
    """One row: snapshot_at, complete, and why not. A snapshot of more than *cap* rows is truncated."""
    fits = F.count(F.lit(1)) <= cap
    return current_state(issues).agg(
        F.nullif(F.max("issue_updated"), F.lit("")).alias("snapshot_at"), fits.alias("complete"),
        F.when(fits, "").otherwise("SNAPSHOT_TRUNCATED").alias("degradation"))


def count_issues(issues: DataFrame, filters=None, cap: int = SNAPSHOT_ROWS) -> DataFrame:
    """COUNT with its snapshot; of a truncated snapshot there is no total."""
    found = matched_issues(issues, filters).agg(F.count(F.lit(1)).alias("total"))
    state = snapshot_state(issues, cap).withColumn("total", found.scalar())
    return state.select(F.when(F.col("complete"), F.col("total")).alias("total"), "snapshot_at", "complete", "degradation")


def natural_order(key: Column) -> list[Column]:
    """Prefix, then number, then the key itself, all ignoring case."""
    pattern = r"^(.+?)-(\d+)$"
    shaped = key.rlike(pattern)
    return [
        F.when(shaped, F.lower(F.regexp_extract(key, pattern, 1))).otherwise(F.lower(key)),
        F.when(shaped, F.regexp_extract(key, pattern, 2).cast("bigint")).otherwise(F.lit(0)),
        F.lower(key),
    ]


ROW_FIELDS = (
    "issue_key", "title", "status", "status_category_key", "resolution", "issue_type",
    "priority", "parent_issue_key", "assignee", "issue_updated",
)


def issue_row(df: DataFrame) -> DataFrame:
    """The presentation columns of one issue."""
    return df.select(
        F.col("issue_key").alias("key"),
        F.col("title").alias("summary"),
        *[F.col(c) for c in ROW_FIELDS if c not in ("issue_key", "title", "issue_updated")],
        F.array_join(parse_values(F.col("labels")), "|").alias("labels"),
        F.col("issue_updated").alias("updated"),
    )


def list_page(issues: DataFrame, filters, offset: int, limit: int) -> DataFrame:
    """One page in natural key order; the total is a separate scalar aggregate."""
    matched = matched_issues(issues, filters)
    total = matched.agg(F.count(F.lit(1)).alias("n"))
    page = matched.orderBy(*natural_order(F.col("issue_key"))).offset(offset).limit(limit)
    return issue_row(page).withColumn("total", total.scalar())


def distribution(issues: DataFrame, group_by: str, filters=None) -> DataFrame:
    value = F.coalesce(F.nullif(F.col(group_by), F.lit("")), F.lit(UNSPECIFIED))
    return (
        matched_issues(issues, filters)
        .groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("value")
    )


def overview(issues: DataFrame, filters=None) -> DataFrame:
    """Five distributions and the child/top-level split in a single aggregation."""
    matched = matched_issues(issues, filters)

    def facet(name: str, field: str) -> Column:
        values = _values_of(matched, field)
        values = F.when(F.size(values) == 0, F.array(F.lit(UNSPECIFIED))).otherwise(values)
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    has_parent = F.coalesce(F.col("parent_issue_key"), F.lit("")) != ""
    level = F.array(
        F.struct(
            F.when(has_parent, "child_work_items").otherwise("top_level_work_items").alias("facet"),
            F.lit("").alias("value"),
        )
    )
    facets = F.concat(
        facet("statuses", "status"),
        facet("issue_types", "issue_type"),
        facet("priorities", "priority"),
        facet("labels", "labels"),
        facet("components", "components"),
        level,
    )
    return (
        matched.select(F.explode(facets).alias("f"))
        .groupBy("f.facet", "f.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("facet", F.desc("n"), F.lower("value"))
    )


def resolve_fixed(issues: DataFrame) -> DataFrame:
    """Which rule the "fixed" filter resolves to, from the observed resolutions."""
    current = current_state(issues)
    value = F.trim(F.coalesce(F.col("resolution"), F.lit("")))
    known = fold_accents(value).isin(*FIXED_ALIASES)
    seen = current.agg(
        F.array_sort(F.collect_set(F.when(known, value))).alias("matching"),
        F.count(F.lit(1)).alias("rows"),
    )
    has_category = F.lit("status_category_key" in issues.columns)
    return seen.select(
        F.array_join("matching", "|").alias("matching"),
        F.when(F.size("matching") > 1, "AMBIGUOUS_RESOLUTION")
        .when(F.size("matching") == 1, F.concat(F.lit("RESOLUTION:"), F.element_at("matching", 1)))
        .when(has_category & (F.col("rows") > 0), "STATUS_CATEGORY:DONE")
        .otherwise("LEGACY_STATUS:DONE")
        .alias("rule"),
    )


def topic_label_candidates(issues: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Labels that stand for a topic, best first, with the acceptance verdict.

    The verdict compares the best two candidates only, so the ranking is a bounded
    top-2 rather than a global window.
    """
    current = current_state(issues)
    title = fold_accents(F.coalesce(F.col("title"), F.lit("")))
    in_title = F.lit(True)
    in_text = F.lit(True)
    text = _topic_text(current)
    for topic in topics:
        in_title = in_title & title.contains(fold_accents(F.lit(topic)))
        in_text = in_text & text.contains(fold_accents(F.lit(topic)))
    totals = current.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(in_text, 1)).alias("direct")
    )
    rows = totals.select("rows").scalar()
    direct = totals.select("direct").scalar()
    counted = (
        current.select(F.explode(parse_values(F.col("labels"))).alias("label"), in_title.alias("hit"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("frequency"), F.count(F.when(F.col("hit"), 1)).alias("mentions"))
        .where(
            (F.col("mentions") >= 2)
            & (F.col("frequency") <= F.greatest(F.lit(3), F.floor(rows * F.lit(0.8))))
        )
        .withColumn("score", F.round(F.col("mentions") / F.sqrt("frequency"), 6))
    )
    best = [F.desc("score"), F.desc("mentions"), F.desc("frequency"), F.desc("label")]
    top = counted.orderBy(*best).limit(2)
    pair = top.agg(
        F.sort_array(F.collect_list(F.struct("score", "mentions", "frequency", "label")), False).alias("c")
    )
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    return pair.where(F.size("c") > 0).select(
        first["label"].alias("label"),
        first["score"].alias("score"),
        first["frequency"].alias("population"),
        second["score"].alias("runner_up"),
        (
            (first["frequency"] > direct)
            & (F.coalesce(second["score"], F.lit(0.0)) * 1.5 <= first["score"])
        ).alias("resolved"),
    )


def freshness(chunks: DataFrame) -> DataFrame:
    value = first_present(F.col("issue_updated"), F.col("event_date"))
    return chunks.agg(F.nullif(F.max(value), F.lit("")).alias("freshness"))


def section_identity() -> list[Column]:
    return [F.col(c) for c in ("cloud_id", "issue_key", "section_kind", "event_id")]


def render_changelog(text: Column) -> Column:
    """Change entries as ``field: from → to`` lines; other text is left alone.

    The JSON reader stops after the first value, so text that holds several lists
    (joined from parts by line breaks) is excluded by shape first.
    """
    parsed = F.from_json(text, "array<struct<field:string,fromString:string,toString:string>>")

    def line(change: Column) -> Column:
        missing = F.lit("not set")
        return F.concat(
            F.coalesce(change["field"], F.lit("Field")), F.lit(": "),
            F.coalesce(F.nullif(change["fromString"], F.lit("")), missing), F.lit(" → "),
            F.coalesce(F.nullif(change["toString"], F.lit("")), missing),
        )

    return F.when(
        text.rlike(r"(?s)^\[.*\]$") & ~text.rlike(r"\]\s*\n\s*\[") & parsed.isNotNull(), F.array_join(F.transform(parsed, line), "\n")
    ).otherwise(text)


def section_identity(chunks: DataFrame) -> Column:
    """What tells one section from another: the first of these that the chunk has."""
    chain = ("event_id", "attachment_id", "locator", "source_id", "chunk_id")
    return F.coalesce(first_present(*[F.col(c).cast("string") for c in chain if c in chunks.columns]), F.lit(""))


def section_page(chunks: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of sections by issue, date and event, with the total of all pages."""
    found = sections(chunks)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    order = ["key", "sort_date", "event_id", "kind"]
    return found.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def sections(chunks: DataFrame) -> DataFrame:
    """Split section chunks regrouped into one record per event.

    Equal bodies collapse in a first aggregation. Of other kinds than change lists only the
    leading parts that can reach the 4000-character body below its header line survive a
    per-group rank limit (a part has a character and a line end at least, the header ends
    with the first part), so a group holding a large share of all chunks is never gathered
    whole. A change list is one JSON value and is gathered as such.
    """
    chunks = chunks.withColumn("event_id", section_identity(chunks))
    keys = ["cloud_id", "issue_key", "section_kind", "event_id"]
    blanks = F.lit(" \t\n\x0b\f\r")
    heads = chunks.groupBy(*keys).agg(
        F.min_by(F.col("event_date"), F.struct("chunk_ordinal", "ord", "event_date")).alias("event_date"),
        F.min_by(F.col("event_date"), F.struct("ord", "event_date")).alias("sort_date"),
        F.count(F.lit(1)).alias("chunks"),
    )
    distinct_parts = (
        chunks.select(*keys, F.btrim("page_content", blanks).alias("body"), F.struct("chunk_ordinal", "ord").alias("at"))
        .where(F.col("body") != "")
        .groupBy(*keys, "body")
        .agg(F.min("at").alias("at"))
    )
    changes = F.col("section_kind") == "CHANGELOG"
    leading = distinct_parts.where(~changes).withColumn(
        "rn", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "body"))
    ).where(F.col("rn") <= SECTION_PARTS).drop("rn")
    bodies = leading.unionByName(distinct_parts.where(changes)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("at", "body"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["body"]), "\n")
    joined = heads.join(bodies, keys, "left").withColumn("text", F.coalesce(text, F.lit("")))
    header = F.concat(F.upper("section_kind"), F.lit(" "))
    below_header = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit(""))
    stripped = F.when(
        F.upper(F.left("text", F.length("section_kind") + 1)) == header, F.btrim(below_header, blanks)
    ).otherwise(F.col("text"))
    rendered = F.when(F.col("section_kind") == "CHANGELOG", render_changelog(stripped)).otherwise(stripped)
    return joined.select(
        F.col("issue_key").alias("key"),
        F.col("section_kind").alias("kind"),
        "event_id",
        "event_date",
        "sort_date",
        "chunks",
        F.substring(rendered, 1, SECTION_CHARACTERS).alias("text"),
    )


def section_counts(chunks: DataFrame) -> DataFrame:
    """Distinct section identities per issue and kind."""
    return (
        chunks.where(F.col("section_kind") != "CURRENT")
        .groupBy(F.upper("issue_key").alias("key"), F.upper("section_kind").alias("kind"))
        .agg(F.count_distinct(first_present(F.col("event_id"), F.col("source_id"))).alias("n"))
    )


def children(issues: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Current child issues whose parent is among the requested keys."""
    current = current_state(issues)
    kids = last_per_identity(current.where(F.coalesce("parent_issue_key", F.lit("")) != ""))
    parents = current if requested is None else requested
    keys = parents.select(F.upper("issue_key").alias("_parent")).distinct()
    return kids.join(keys, F.upper("parent_issue_key") == F.col("_parent"), "left_semi")


def detail(issues: DataFrame, section_chunks: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Parent rows with their section counts, followed by child rows."""
    parents = last_per_identity(current_state(issues))
    if requested is not None:
        wanted = requested.select(F.upper("issue_key").alias("_want")).distinct()
        parents = parents.join(wanted, F.upper("issue_key") == F.col("_want"), "left_semi")
    counts = (
        section_counts(section_chunks)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    )
    counted = parents.join(counts, F.upper("issue_key") == F.col("key"), "left")
    shown = F.coalesce(
        F.array_join(
            F.transform("kinds", lambda k: F.concat(k["kind"], F.lit("="), k["n"].cast("string"))), ","
        ),
        F.lit(""),
    )
    columns = ["issue_key", "status", "parent_issue_key"]
    parent_rows = counted.select(*columns, F.lit("PARENT").alias("row_role"), shown.alias("section_counts"))
    child_rows = children(issues, requested).select(
        *columns, F.lit("CHILD").alias("row_role"), F.lit("").alias("section_counts")
    )
    return parent_rows.unionByName(child_rows)
