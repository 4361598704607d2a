"""Readers for the input tables and their chunk / issue / section bindings.

Each binding is a projection (or a union of projections) that stays inside the
scan stage: no shuffle, and unused columns are pruned down to the parquet read.
The column rules are portable SQL text so that a test oracle can reuse them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

PROJECT = "ALPHA"
REQUIRED_POLICY = "project:ALPHA"
CALLER_POLICIES = ("project:ALPHA", "department:ALPHA:ops", "user:42", "project:BETA")


def issue_key(expr: str) -> str:
    """Portable SQL text for the natural key of an order number expression."""
    return (
        f"(CASE WHEN ({expr}) % 3 = 0 THEN 'ALPHA-' WHEN ({expr}) % 3 = 1 THEN 'BETA-' "
        f"ELSE 'gamma-' END || CAST({expr} AS STRING))"
    )


# column -> portable expression over `documents`
CHUNK_COLUMNS: dict[str, str] = {
    "chunk_id": "doc_id",
    "page_content": "text",
    "language": "lang",
    "source_id": "source",
    "source_type": (
        "CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'PAGE' WHEN 1 THEN 'ISSUE' "
        "WHEN 2 THEN 'CODE' ELSE 'ATTACHMENT' END"
    ),
    "project_id": (
        "CASE WHEN doc_id % 11 = 0 THEN 'BETA' WHEN doc_id % 13 = 0 THEN '' ELSE 'ALPHA' END"
    ),
    "access_policy_id": (
        "CASE doc_id % 7 WHEN 0 THEN 'department:ALPHA:ops' WHEN 1 THEN 'department:ALPHA:sales' "
        "WHEN 2 THEN '' WHEN 3 THEN 'user:42' ELSE 'project:ALPHA' END"
    ),
    "authority": "CAST(doc_id % 3 AS INT)",
    "source_version": "'V' || CAST(doc_id % 4 AS STRING) || '.' || CAST(doc_id % 12 AS STRING)",
    "observed_at": (
        "CASE WHEN doc_id % 5 = 0 THEN '' ELSE '2024-0' || CAST(doc_id % 9 + 1 AS STRING) || '-01' END"
    ),
    "parent_id": "'P' || CAST(CAST((doc_id - doc_id % 10) / 10 AS BIGINT) AS STRING)",
    "chunk_ordinal": "CAST(doc_id % 10 AS INT)",
    "doc_category": (
        "CASE doc_id % 10 WHEN 9 THEN 'index' WHEN 8 THEN 'entity-contract' "
        "WHEN 7 THEN 'registry-table' ELSE 'narrative' END"
    ),
    "entity_key": (
        "CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'E' || CAST(doc_id % 97 AS STRING) END"
    ),
    "entity": "CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'app' || CAST(doc_id % 3 AS STRING) END",
    "schema_version": (
        "CASE WHEN doc_id % 17 = 0 THEN '3' WHEN doc_id % 29 = 0 THEN '' ELSE '4' END"
    ),
    "title": "split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)",
    "reference": "source || '#' || CAST(doc_id AS STRING)",
    "locator": "'L' || CAST(doc_id % 40 AS STRING)",
    "ord": "doc_id",
}

ISSUE_COLUMNS: dict[str, str] = {
    "source_id": "'issue:' || CAST(o_orderkey AS STRING)",
    "cloud_id": "'c' || CAST(o_orderkey % 3 AS STRING)",
    "issue_key": issue_key("o_orderkey"),
    "title": "'Order of customer ' || CAST(o_custkey AS STRING) || ' ' || o_orderpriority",
    "status_category_key": (
        "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'done' "
        "WHEN o_orderstatus = 'O' THEN 'new' ELSE 'indeterminate' END"
    ),
    "priority": "o_orderpriority",
    "labels": (
        "'L' || CAST(o_custkey % 8 AS STRING) || "
        "CASE WHEN o_custkey % 3 = 0 THEN ', POS' ELSE '' END"
    ),
    "issue_type": (
        "CASE o_orderkey % 5 WHEN 1 THEN 'Task' WHEN 2 THEN 'Story' WHEN 3 THEN '' ELSE 'Bug' END"
    ),
    "resolution": (
        "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'Fixed' ELSE '' END"
    ),
    "parent_issue_key": (
        "CASE WHEN o_orderkey % 6 IN (1, 2, 3) THEN "
        + issue_key("(o_orderkey - o_orderkey % 6)") + " ELSE '' END"
    ),
    "assignee": "'user' || CAST(o_custkey AS STRING)",
    "issue_updated": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "chunk_kind": "'CURRENT'",
}

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Open' ELSE 'In Progress' END"

# (status expression, ordinal expression, row filter): the second branch is a later
# observation of every fifth issue, so the identity dedup has work to do.
ISSUE_BRANCHES = (
    (_STATUS, "o_orderkey * 2", "true"),
    ("'Done'", "o_orderkey * 2 + 1", "o_orderkey % 5 = 0"),
)

SECTION_COLUMNS: dict[str, str] = {
    "source_id": "'issue:' || CAST(l_orderkey AS STRING)",
    "cloud_id": "'c' || CAST(l_orderkey % 3 AS STRING)",
    "issue_key": issue_key("l_orderkey"),
    "section_kind": (
        "CASE l_linenumber % 4 WHEN 0 THEN 'DESCRIPTION' WHEN 1 THEN 'COMMENT' "
        "WHEN 2 THEN 'CHANGELOG' ELSE 'ATTACHMENT' END"
    ),
    "event_id": "'ev' || CAST(l_linenumber AS STRING)",
    "event_date": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "chunk_ordinal": "CAST(l_partkey AS INT)",
    "page_content": (
        "CASE WHEN l_linenumber % 4 = 2 THEN '[{\"field\":\"status\",\"fromString\":\"' || l_returnflag "
        "|| '\",\"toString\":\"' || l_linestatus || '\"}]' "
        "WHEN l_linenumber % 4 = 1 THEN 'COMMENT ' || CAST(l_suppkey AS STRING) || chr(10) || "
        "' Part ' || CAST(l_partkey AS STRING) || ' shipped ' "
        "ELSE ' Part ' || CAST(l_partkey AS STRING) || ' supplier ' || CAST(l_suppkey AS STRING) END"
    ),
    "ord": "l_partkey * 1000000 + l_suppkey * 10 + l_linenumber",
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


@dataclass(frozen=True)
class Tables:
    """Lazy access to one scale-factor folder of parquet tables."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def chunks(self) -> DataFrame:
        return self.read("documents").selectExpr(*_select(CHUNK_COLUMNS))

    def issues(self) -> DataFrame:
        orders = self.read("orders")
        parts = [
            orders.where(keep).selectExpr(
                *_select(ISSUE_COLUMNS), f"{status} AS status", f"{ordinal} AS ord"
            )
            for status, ordinal, keep in ISSUE_BRANCHES
        ]
        return parts[0].unionByName(parts[1])

    def sections(self) -> DataFrame:
        return self.read("lineitem").selectExpr(*_select(SECTION_COLUMNS))


def oracle_cte(name: str) -> str:
    """The same binding as a CTE body, for the cross-check in the other engine."""
    if name == "chunks":
        return "SELECT " + ", ".join(_select(CHUNK_COLUMNS)) + " FROM documents"
    if name == "sections":
        return "SELECT " + ", ".join(_select(SECTION_COLUMNS)) + " FROM lineitem"
    if name == "issues":
        return " UNION ALL ".join(
            "SELECT " + ", ".join(_select(ISSUE_COLUMNS) + [f"{status} AS status", f"{ordinal} AS ord"])
            + f" FROM orders WHERE {keep}"
            for status, ordinal, keep in ISSUE_BRANCHES
        )
    raise KeyError(name)
