"""Answers that name code files or list features, taken from the evidence and checked against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.functions.answers import feature_name, identifier_components
from evidquarry.functions.text import normalized_words

# What asks for a location, and words that say nothing about which.
LOCATION = (
    r"\b(?:which|what)\s+(?:(?:source|github|repository)\s+)?(?:files?|code|class(?:es)?|methods?|functions?)\b|\bwhere\b|"
    r"\b(?:files?|code|classes?|methods?|functions?)\s+(?:has|have|contains?|defines?|implements?|includes?)\b"
)
IGNORED = (
    "a", "an", "and", "are", "class", "classes", "code", "does", "file", "files", "for", "function", "functions", "has", "have", "in", "is", "it", "method",
    "methods", "of", "repository", "source", "the", "what", "where", "which", "with", "you",
)
MOST, PREFIX = 3, 4


def singular(word: Column) -> Column:
    return F.when((F.length(word) > 4) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def location_terms(question: Column) -> Column:
    """What a question for a code location names; empty for any other question."""
    words = normalized_words(question)
    named = F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(*IGNORED)), singular))
    return F.when(F.array_join(words, " ").rlike("(?U)" + LOCATION), named).otherwise(F.array().cast("array<string>"))


def label_score(terms: Column, label: Column) -> Column:
    """How many terms are, begin, or are begun by a part of a file's name."""
    parts = identifier_components(F.regexp_replace(label, r"\.[^.]*$", ""))

    def near(a: Column, b: Column) -> Column:
        return (a == b) | ((F.least(F.length(a), F.length(b)) >= PREFIX) & (a.startswith(b) | b.startswith(a)))

    return F.size(F.filter(terms, lambda t: F.exists(parts, lambda p: near(t, p))))


def file_labels(evidence: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Rows (query_id, source, label): the path of a document and the file names it mentions."""
    pattern = r"[A-Za-z0-9_./-]*[A-Za-z0-9_-]\.(?:" + "|".join(e.lstrip(".") for e in extensions) + r")(?![A-Za-z0-9_])"
    path = F.trim(F.coalesce("path", F.lit("")))
    own = F.when(path.rlike("^(?:" + pattern + ")$"), F.array(path)).otherwise(F.array().cast("array<string>"))
    mentioned = F.transform(F.regexp_extract_all(F.coalesce("page_content", F.lit("")), F.lit(pattern), 0), lambda v: F.regexp_extract(v, "([^/]*)$", 1))
    return evidence.select("query_id", "source", F.explode(F.array_distinct(F.concat(own, mentioned))).alias("label"))


def located(questions: DataFrame, evidence: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Rows (query_id, place, label, source, score): the best matching files, at most three."""
    labels = file_labels(evidence, extensions).groupBy("query_id", F.lower("label").alias("key")).agg(F.min(F.struct("source", "label")).alias("first"))
    asked = questions.select("query_id", location_terms(F.col("question")).alias("terms")).where(F.size("terms") > 0)
    scored = labels.join(asked, "query_id").select("query_id", "key", "first.source", "first.label", label_score(F.col("terms"), F.col("first.label")).alias("score"))
    best = scored.where("score > 0").groupBy("query_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("source", F.desc("key")))
    top = scored.join(best, ["query_id", "score"]).withColumn("place", place).where(F.col("place") <= MOST)
    return top.select("query_id", "place", "label", "source", "score")


def location_answers(found: DataFrame) -> DataFrame:
    """One answer a question, every line with its source."""
    line = F.concat(F.lit("`"), "label", F.lit("` [SOURCE "), F.col("source").cast("string"), F.lit("]."))
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))  # at most MOST
    one = F.concat(F.lit("The matching file is "), F.get("lines", F.lit(0))["line"])
    many = F.concat(F.lit("### Matching files\n"), F.array_join(F.transform("lines", lambda r: F.concat(F.lit("- "), r.line)), "\n"))
    return listed.select("query_id", F.when(F.size("lines") == 1, one).otherwise(many).alias("answer"))


def feature_inventory(evidence: DataFrame) -> DataFrame:
    """One answer a question: a line for each document, its feature name out of title and entity."""
    name = feature_name(F.col("title"), F.col("entity"))
    named = evidence.select("query_id", "source", name.alias("name")).where("name <> ''")
    line = F.concat(F.lit("- "), "name", F.lit(" [SOURCE "), F.col("source").cast("string"), F.lit("]."))
    return named.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", line.alias("line")))), lambda r: r.line), "\n").alias("answer"))


def verified(answers: DataFrame, derived: DataFrame) -> DataFrame:
    """Is each answer, line by line, the one derived anew? An answer that cannot be derived is not."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda v: F.trim(v)), lambda v: v != "")
    again = derived.select("query_id", F.col("answer").alias("_again"))
    return answers.join(again, "query_id", "left").withColumn("verified", F.coalesce(lines("answer") == lines("_again"), F.lit(False))).drop("_again")
