"""Which one, two or three sources together support a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidquarry.functions import anchors

MOST_SOURCES = 12  # fixed value: the evidence list of one answer


def evidence_places(claims: DataFrame, newest: Column) -> DataFrame:
    """A row for each source number a claim may use: the *newest* one and those before it.

    Numbers are spread before the join with the evidence, so a long conversation is no hot key.
    """
    first = F.greatest(F.lit(1), newest - (MOST_SOURCES - 1))
    return claims.withColumn("source", F.explode(F.sequence(first.cast("bigint"), newest.cast("bigint"))))


def best_sets(claims: DataFrame, evidence: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The smallest set of at most three sources that reaches the threshold, and its score.

    *claims*: keys, source (a row for each source that may be used), terms (distinct). *evidence*:
    the first key, source, words. A set's score is the share of a claim's terms its sources hold together; of
    equally small sets the best, then that of the smallest numbers, is taken. Pairs are scored
    only where no single source reaches the threshold and only if their shares could add up to
    it; triples only where no pair does, from a pair's uncovered terms, with the same test.
    A claim without such a set keeps its best single score and null members.
    """
    open_terms = claims.join(evidence, [keys[0], "source"]).select(
        *keys, "source", F.size("terms").alias("n"), F.array_except("terms", "words").alias("open"))
    # at most MOST_SOURCES entries a claim
    grouped = open_terms.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("source", "open"))).alias("sources"))
    sources, n = F.col("sources"), F.greatest(F.col("n"), F.lit(1))

    def reaches(covered: Column) -> Column:
        return covered >= F.lit(threshold) * n

    def covered(missing: Column) -> Column:
        return F.col("n") - F.size(missing)

    def candidate(missing: Column, *members: Column) -> Column:
        return F.struct(covered(missing).alias("covered"), F.array(*[-m for m in members]).alias("order"))

    def pairs(possible) -> Column:
        return F.flatten(F.transform(sources, lambda a: F.transform(
            F.filter(sources, lambda b: (b.source > a.source) & possible(a, b)),
            lambda b: F.struct(a.source.alias("a"), b.source.alias("b"), F.array_intersect(a.open, b.open).alias("open")))))

    def could(a: Column, b: Column) -> Column:
        return reaches(covered(a.open) + covered(b.open))

    single = F.array_max(F.transform(sources, lambda a: candidate(a.open, a.source)))
    double = F.array_max(F.transform(pairs(could), lambda p: candidate(p.open, p.a, p.b)))
    triple = F.array_max(F.flatten(F.transform(pairs(lambda a, b: F.lit(True)), lambda p: F.transform(
        F.filter(sources, lambda c: (c.source > p.b) & could(p, c)),
        lambda c: candidate(F.array_intersect(p.open, c.open), p.a, p.b, c.source)))))
    one = grouped.withColumn("one", single)
    two = one.withColumn("two", F.when(~reaches(F.col("one.covered")), double))
    three = two.withColumn("three", F.when(~reaches(F.col("one.covered")) & ~F.coalesce(reaches(F.col("two.covered")), F.lit(False)), triple))
    best = F.coalesce(*[F.when(reaches(F.col(f"{c}.covered")), F.col(c)) for c in ("one", "two", "three")])
    chosen = three.withColumn("best", best)
    return chosen.select(
        *keys, F.transform("best.order", lambda m: -m).alias("members"),
        F.round(F.coalesce("best.covered", "one.covered") / n, 6).alias("score"))


def supported(claims: DataFrame, sets: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The claims (keys, plain) whose set also holds their anchors and negation: keys, members, score."""
    used = claims.join(sets.where("members is not null"), keys).withColumn("source", F.explode("members"))
    proof = used.join(evidence.select(keys[0], "source", "page_content"), [keys[0], "source"]).groupBy(*keys, "plain", "members", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "page_content"))), lambda e: e.page_content), "\n").alias("proof"))
    kept = anchors.anchors_supported(F.col("plain"), F.col("proof")) & anchors.negation_supported(F.col("plain"), F.col("proof"))
    return proof.where(kept).select(*keys, "members", "score")
