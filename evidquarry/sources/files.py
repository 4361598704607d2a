"""JSONL and CSV readers with their contracts, and the matching writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The catalog contract.
CATALOG_COLUMNS = (
    "sku", "name_es", "name_en", "brand", "category_code", "category_es", "category_en", "subcategory_code",
    "subcategory_es", "subcategory_en", "presentation_es", "presentation_en", "assortment_type", "lifecycle_state",
    "availability_scope", "regions", "effective_date",
)
PRICE_COLUMNS = ("price", "precio", "regular_price", "sale_price", "currency")


class ContractError(ValueError):
    """The input does not satisfy its declared contract."""


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Non-blank JSON lines under an explicit schema; a bad line fails the read."""
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed strings; required columns are checked on the header."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "FAILFAST").csv(path)
    rows = rows.withColumnRenamed(rows.columns[0], rows.columns[0].lstrip("﻿"))
    missing = sorted(set(CATALOG_COLUMNS) - set(rows.columns))
    if missing:
        raise ContractError("missing required columns: " + ", ".join(missing))
    return rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in rows.columns])


def catalog_violation(columns: list[str]) -> Column:
    """First broken row rule, or null; duplicates are found separately."""
    absent = F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in CATALOG_COLUMNS if c != "regions"]))
    priced = F.lit(False)
    for name in PRICE_COLUMNS:
        if name in columns:
            priced = priced | (F.coalesce(F.col(name), F.lit("")) != "")
    regions = F.filter(F.transform(F.split("regions", r"\|"), lambda r: F.trim(r)), lambda r: r != "")
    return (
        F.when(priced, "PRICED")
        .when(F.size(absent) > 0, "MISSING_FIELDS")
        .when(F.upper("lifecycle_state") != "ACTIVE", "INACTIVE")
        .when(F.col("effective_date").try_cast("date").isNull() | ~F.col("effective_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "BAD_DATE")
        .when((F.upper("availability_scope") != "NATIONAL") & (F.size(regions) == 0), "REGION_REQUIRED")
    )


def catalog_report(rows: DataFrame) -> DataFrame:
    """Violation counts, with repeated and conflicting SKUs told apart."""
    found = rows.select("sku", F.xxhash64(*rows.columns).alias("_row"), catalog_violation(rows.columns).alias("violation"))
    per_sku = found.groupBy("sku").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_row").alias("versions"))
    copies = per_sku.where(F.col("n") > 1).select(
        F.when(F.col("versions") > 1, "CONFLICTING_SKU").otherwise("REPEATED_SKU").alias("violation")
    )
    return (
        found.where(F.col("violation").isNotNull()).select("violation").unionByName(copies)
        .groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
    )


def catalog_markdown(rows: DataFrame, language: str) -> DataFrame:
    """One Markdown section per product, ready for a text sink."""
    other = "en" if language == "es" else "es"
    section = F.concat(F.lit("product:"), F.col("sku"))

    def item(name: str, value: Column, quoted: bool) -> Column:
        mark = F.lit("`" if quoted else "")
        return F.concat(F.lit(f"- {name}: "), mark, value, mark)

    lines = [
        F.concat(F.lit("## "), F.col(f"name_{language}")), F.lit(""),
        item("section_id", section, True),
        item("translation_of", F.concat(section, F.lit(f":{other}")), True),
        item("sku", F.col("sku"), True),
        item("brand", F.col("brand"), False),
        item("category_code", F.col("category_code"), True),
        item("category", F.col(f"category_{language}"), False),
        item("effective_date", F.col("effective_date"), True),
    ]
    return rows.select("sku", F.concat_ws("\n", *lines).alias("value"))


def publish(rows: DataFrame, root: str, release: str, activate: bool = True) -> None:
    """Write an immutable release and move the pointer to it only afterwards."""
    if not release or any(part in release for part in ("/", "\\", "..")):
        raise ContractError("release name is not safe for a folder")
    rows.write.mode("errorifexists").option("header", True).csv(f"{root}/releases/{release}/products")
    for language in ("es", "en"):
        catalog_markdown(rows, language).orderBy("sku").select("value").write.mode("errorifexists").text(
            f"{root}/releases/{release}/{language}"
        )
    if activate:
        point_to(rows.sparkSession, root, release, set_fingerprint(rows, "sku"))


def set_fingerprint(rows: DataFrame, key: str) -> int:
    """Order-free fingerprint of a key set, combined on the executors."""
    return rows.agg(F.bit_xor(F.xxhash64(key)).alias("v")).first()["v"]


def point_to(spark: SparkSession, root: str, release: str, fingerprint: int) -> None:
    spark.createDataFrame([(release, fingerprint)], "release string, fingerprint bigint").write.mode("overwrite").json(
        f"{root}/active"
    )


def rollback(spark: SparkSession, root: str, release: str, fingerprint: int) -> None:
    """Reactivate a release after checking that its rows are still the same set."""
    rows = spark.read.option("header", True).csv(f"{root}/releases/{release}/products")
    if set_fingerprint(rows, "sku") != fingerprint:
        raise ContractError(f"release {release} failed its checksum")
    point_to(spark, root, release, fingerprint)
