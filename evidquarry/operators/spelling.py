"""Spelling variants of shouted questions, through a deletion neighbourhood of the vocabulary.

Two words within k edits (an adjacent swap is one) share a string that is left of either after
deleting at most k letters. So near words meet in an equi-join on such strings, and only these
pairs are measured; no word is compared with the whole vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidquarry.functions.answers import swap_distance
from evidquarry.functions.text import casefold

# What a token is, what stays as it is, and how far a correction may go.
PIECES = r"`[^`]+`|['\"][^'\"]+['\"]|[A-Za-zÀ-ÿ_][A-Za-zÀ-ÿ0-9_]*|[^A-Za-zÀ-ÿ_`'\"]+|[`'\"]"
TOKEN = r"^[A-Za-zÀ-ÿ_][A-Za-zÀ-ÿ0-9_]*$"
LETTERS = r"[A-Za-zÀ-ÿ]+"
SHOUTED = 0.6
SHORT, SHORT_EDITS, LONG_EDITS = 5, 1, 2


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def neighbourhood(word: Column, edits: Column) -> Column:
    """The word and what is left of it after deleting one letter, or up to two."""
    one = _without_one(word)
    two = F.flatten(F.transform(one, lambda w: F.when(F.length(w) > 0, _without_one(w)).otherwise(F.array().cast("array<string>"))))
    near = F.concat(F.array(word), one)
    return F.array_distinct(F.when(edits >= 2, F.concat(near, two)).otherwise(near))


def corrections(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows (word, correction): the one nearest word of the lexicon within the allowed edits.

    *words* has word, *lexicon* has entry, both folded. A word with two equally near entries
    (by edits, then by difference in length) has no correction.
    """
    edits = F.when(F.length("word") <= SHORT, SHORT_EDITS).otherwise(LONG_EDITS)
    asked = words.select("word").distinct().withColumn("edits", edits)
    left = asked.select("word", "edits", F.explode(neighbourhood(F.col("word"), F.col("edits"))).alias("rest"))
    entries = lexicon.select("entry").where("entry <> ''").distinct()
    far = F.when(F.length("entry") + LONG_EDITS > SHORT, LONG_EDITS).otherwise(SHORT_EDITS)  # short entries only meet short words
    right = entries.select("entry", F.explode(neighbourhood(F.col("entry"), far)).alias("rest"))
    pairs = left.join(right, "rest").select("word", "edits", "entry").distinct()
    gap = F.abs(F.length("entry") - F.length("word"))
    measured = pairs.withColumn("gap", gap).where(F.col("gap") <= F.col("edits")).withColumn("distance", swap_distance(F.col("word"), F.col("entry")))
    tied = measured.where(F.col("distance") <= F.col("edits")).groupBy("word", "distance", "gap").agg(
        F.count(F.lit(1)).alias("n"), F.min("entry").alias("entry"))
    best = tied.groupBy("word").agg(F.min_by(F.struct("n", "entry"), F.struct("distance", "gap")).alias("best"))
    return best.where("best.n = 1").select("word", F.col("best.entry").alias("correction"))


def corrected_variants(questions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows (query_id, corrected) of the questions in capitals that have a spelling variant.

    Words of the lexicon, quoted spans, words with digits or underscores and single letters stay.
    """
    letters = F.regexp_extract_all("question", F.lit(LETTERS), 0)
    loud = F.size(F.filter(letters, lambda w: F.upper(w) == w))
    shouted = questions.where((F.size(letters) > 0) & (loud >= SHOUTED * F.size(letters)))
    pieces = shouted.select("query_id", F.posexplode(F.regexp_extract_all("question", F.lit(PIECES), 0)).alias("pos", "piece"))
    plain = F.col("piece").rlike(TOKEN) & ~F.col("piece").rlike("[0-9_]") & (F.length("piece") >= 2)
    pieces = pieces.withColumn("word", F.when(plain, casefold(F.col("piece"))))
    unknown = pieces.where("word is not null").select("word").distinct().join(lexicon.select(F.col("entry").alias("word")), "word", "left_anti")
    found = corrections(unknown, lexicon)
    shown = F.when(F.upper("piece") == F.col("piece"), F.upper("correction")).otherwise(F.col("correction"))
    changed = pieces.join(found, "word", "left").withColumn("piece", F.coalesce(shown, "piece"))
    # the pieces of one question
    whole = changed.groupBy("query_id").agg(
        F.count("correction").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p.piece), "").alias("corrected"))
    return whole.where("n > 0").select("query_id", "corrected")
