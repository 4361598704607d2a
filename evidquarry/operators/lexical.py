"""Inverted-index statistics and BM25 over a batch of queries.

Scores are computed in the scan: two passes over the chunks, one for the counts of the
asked terms and one for each task's own best. The index over all terms is a map-side
combined aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.functions.text import token_bag, token_count, tokens
from evidquarry.operators.best import SCHEMA, Best
from evidquarry.operators.ranks import at_index, cumulative_counts
from evidquarry.session import balanced, fits_within, shared_path

# Saturation, length normalisation, score precision.
K1 = 1.2
B = 0.75
DIGITS = 6
PAIRS_PER_PASS = 500_000  # (query, term) pairs of one block, about 30 MB in a task
POSTINGS = 20_000  # term occurrences expanded to their queries at a time
TOKENS = 500_000  # tokens of chunks looked up at a time, about 50 MB in a task
REPEATED = 100_000  # repeated chunk ids that travel to the tasks

# How often each metadata field is repeated in the searchable text.
FIELD_WEIGHTS = {
    "title": 2,
    "path": 3,
    "symbol": 4,
    "reference": 3,
    "issue_key": 4,
    "locator": 2,
    "important_kwd": 5,
    "keywords": 3,
    "question_terms": 3,
}


def searchable_text(chunks: DataFrame) -> Column:
    """Body followed by the weighted metadata fields that the frame carries."""
    types = dict(chunks.dtypes)
    parts = [F.col("page_content")]
    for field, weight in FIELD_WEIGHTS.items():
        if field not in types:
            continue
        value = F.array_join(F.col(field), " ") if types[field].startswith("array") else F.col(field)
        parts.append(F.array_join(F.array_repeat(F.nullif(value, F.lit("")), weight), " "))
    return F.concat_ws(" ", *[F.nullif(part, F.lit("")) for part in parts])


def _searchable_fields(chunks: DataFrame) -> list[tuple[Column, int]]:
    types = dict(chunks.dtypes)
    fields = [(F.col("page_content"), 1)]
    for field, weight in FIELD_WEIGHTS.items():
        if field in types:
            value = F.array_join(F.col(field), " ") if types[field].startswith("array") else F.col(field)
            fields.append((value, weight))
    return fields


def prepared(chunks: DataFrame) -> DataFrame:
    """The searchable fields of every chunk, spread over the available cores."""
    columns = ["chunk_id", "page_content", *[f for f in FIELD_WEIGHTS if f in chunks.columns]]
    return balanced(chunks.select(*columns), "chunk_id")


def _tokens(corpus: DataFrame) -> Column:
    """All tokens, a weighted field's repeated: a space never sits inside a token, so
    this equals tokenizing the text in which the field itself is repeated."""
    none = F.array().cast("array<string>")
    parts = []
    for value, weight in _searchable_fields(corpus):
        found = F.coalesce(token_bag(value), none)
        parts.append(found if weight == 1 else F.flatten(F.array_repeat(found, weight)))
    return F.concat(*parts)


def searchable_terms(corpus: DataFrame) -> Column:
    """The terms of a chunk, each field tokenized once whatever its weight."""
    bags = [F.coalesce(token_bag(value), F.array().cast("array<string>")) for value, _ in _searchable_fields(corpus)]
    return F.transform(F.array_distinct(F.concat(*bags)), F.lower)


def postings(corpus: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, length, term, tf), optionally only for the given terms.

    The length is a column before the explode and the token array is the generator's own
    expression: otherwise one would be computed, or the other copied, per exploded row.
    """
    counts = [F.coalesce(token_count(value), F.lit(0)) * weight for value, weight in _searchable_fields(corpus)]
    sized = corpus.withColumn("length", sum(counts[1:], counts[0]))
    rows = sized.select("chunk_id", "length", F.explode(_tokens(corpus)).alias("term"))
    rows = rows.withColumn("term", F.lower("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_frequency(corpus: DataFrame) -> DataFrame:
    """(term, df) of all terms: the same as of all postings, without shuffling these.

    A chunk's distinct terms are counted where it is read. Only rows of a repeated chunk id go
    through postings, where rows of one id and length are one chunk.
    """
    ids = corpus.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("chunk_id").alias("_id"))
    if not fits_within(ids, REPEATED):
        return document_frequency(postings(corpus))
    same = F.col("chunk_id").eqNullSafe(F.col("_id"))
    again, once = (corpus.join(F.broadcast(ids), same, how) for how in ("left_semi", "left_anti"))
    counted = document_frequency(once.select(F.explode(F.array_distinct(searchable_terms(once))).alias("term")))
    return counted.unionByName(document_frequency(postings(again))).groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of each query."""
    return queries.select(
        "query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term")
    )


class Asked:
    """The terms of one block of queries: what the tasks look tokens up in."""

    def __init__(self, pairs: pa.Table):
        self.query_ids, query = np.unique(pairs.column("query_id").to_numpy(), return_inverse=True)
        encoded = pc.dictionary_encode(pairs.column("term")).combine_chunks()
        self.terms, term = encoded.dictionary, encoded.indices.to_numpy()
        order = np.lexsort((query, term))
        self.owner = query[order]  # queries, term by term
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def found(self, bags: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return looked_up(self.terms, bags)


def looked_up(terms: pa.Array, bags: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token counts of all rows, and (row, term, times) of the asked terms in them."""
    lengths = np.diff(bags.offsets.to_numpy())
    at = pc.index_in(pc.ascii_lower(bags.flatten()), value_set=terms).fill_null(-1).to_numpy()
    row = np.repeat(np.arange(len(bags)), lengths)
    cell, times = np.unique(row[at >= 0] * len(terms) + at[at >= 0], return_counts=True)
    return lengths, cell // max(1, len(terms)), cell % max(1, len(terms)), times


def portions(batches: Iterator[pa.RecordBatch], most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices with about *most* elements in the lists of a column (one row at least), whatever a batch holds."""
    for batch in batches:
        ends, start = batch.column(column).offsets.to_numpy(), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about TOKENS tokens."""
    return portions(batches, TOKENS)


def _counts(asked: Asked):
    """A task's own sums: rows (0), tokens (1), and documents for each asked term (2 ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + len(asked.terms), np.int64)
        for batch in _portions(batches):
            lengths, _, term, _ = asked.found(batch.column(1))
            sums[:2] += len(lengths), lengths.sum()
            sums[2:] += np.bincount(term, minlength=len(asked.terms))
        slot = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sums[slot])], names=["slot", "n"])

    return run


def _best_scores(asked: Asked, sums: np.ndarray, k: int):
    """BM25 of a task's chunks against all queries of the block, its k best for each query."""
    size, tokens_in_all, df = sums[0], sums[1], sums[2:]
    idf = np.log(1 + (size - df + 0.5) / (df + 0.5))
    average = max(1.0, tokens_in_all / max(1, size))
    fan = np.diff(asked.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(asked.query_ids, k)
        width = len(asked.query_ids)
        for batch in _portions(batches):
            lengths, row, term, times = asked.found(batch.column(1))
            ids = batch.column(0).to_numpy()
            norm = 1 - B + B * lengths[row] / average
            weight = idf[term] * (times * (K1 + 1)) / (times + K1 * norm)
            for start in range(0, len(ids), best.portion):
                stop = min(start + best.portion, len(ids))
                scores, hits = np.zeros((stop - start) * width), np.zeros((stop - start) * width, bool)
                lo, hi = np.searchsorted(row, [start, stop])
                for at in range(lo, hi, POSTINGS):
                    here = slice(at, min(at + POSTINGS, hi))
                    times_asked = fan[term[here]]
                    ahead = np.cumsum(times_asked) - times_asked
                    place = np.arange(times_asked.sum()) + np.repeat(asked.start[term[here]] - ahead, times_asked)
                    cell = np.repeat((row[here] - start) * width, times_asked) + asked.owner[place]
                    scores += np.bincount(cell, np.repeat(weight[here], times_asked), len(scores))
                    hits[cell] = True
                shown = np.where(hits, np.round(scores, DIGITS), np.nan)
                best.meet(ids[start:stop], shown.reshape(stop - start, width))
        yield best.rows()

    return run


def _scored_block(corpus: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    spark = corpus.sparkSession
    block = pairs.select(F.col("query_id").cast("bigint"), "term").toArrow()
    if not block.num_rows:
        return spark.createDataFrame([], SCHEMA)
    asked = Asked(block)
    sums = np.zeros(2 + len(asked.terms), np.int64)
    for slot, n in corpus.mapInArrow(_counts(asked), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        sums[slot] = n
    return corpus.mapInArrow(_best_scores(asked, sums, k), SCHEMA)


def bags(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tokens): every chunk's searchable tokens with repeats, in any order and case."""
    frame = prepared(chunks)
    return frame.select(F.col("chunk_id").cast("bigint"), _tokens(frame).alias("tokens"))


def matching_top_k(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The *k* best matching chunks of every query: query_id, chunk_id, lexical_score.

    All terms of a chunk are in one row, so it is scored where it is read: the asked terms
    go to the tasks in blocks of about PAIRS_PER_PASS (query, term) pairs, each task counts
    them, and with the summed counts a second pass scores its chunks and hands on its own
    k best. Neither tokens nor pairs of query and chunk are shuffled, whatever the terms.
    """
    corpus = bags(chunks)
    pairs = query_terms(queries)
    if fits_within(pairs, PAIRS_PER_PASS):
        local = _scored_block(corpus, pairs, k)
    else:
        blocks = pairs.count() // PAIRS_PER_PASS + 1
        slot = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        path = shared_path(corpus.sparkSession, "lexical")
        for block in range(blocks):
            _scored_block(corpus, pairs.where(slot == block), k).write.mode("append").parquet(path)
        local = corpus.sparkSession.read.schema(SCHEMA).parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    ranked = local.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)
    return ranked.select("query_id", "chunk_id", F.col("score").alias("lexical_score"))


def bm25_top_k(chunks: DataFrame, queries: DataFrame, k: int, order: str = "chunk_id") -> DataFrame:
    """Top *k* chunks per query: query_id, chunk_id, lexical_score, lexical_rank."""
    return padded(chunks, queries, matching_top_k(chunks, queries, k), k, order)


def padded(chunks: DataFrame, queries: DataFrame, top: DataFrame, k: int, order: str = "chunk_id") -> DataFrame:
    """*top* (query_id, chunk_id, lexical_score) filled up to *k* chunks a query, ranked.

    Chunks without a matching term score 0 and rank after all others in input
    order; only the first *k* chunks by order can ever be needed for that padding,
    and the k best of the matching ones already decide which of them are free.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("lexical_score"), F.asc("chunk_id"))
    first = chunks.select(F.col(order).alias("chunk_id")).orderBy("chunk_id").limit(k)
    padding_ids = first.agg(F.collect_list("chunk_id").alias("ids")).scalar()
    padding = queries.select("query_id", F.explode(padding_ids).alias("chunk_id"), F.lit(0.0).alias("lexical_score"))
    # at most 2k rows per query remain; a chunk found both ways keeps its real score
    merged = top.unionByName(padding).groupBy("query_id", "chunk_id").agg(F.max("lexical_score").alias("lexical_score"))
    return merged.withColumn("lexical_rank", F.row_number().over(best)).where(F.col("lexical_rank") <= k)


def wordings_top_k(chunks: DataFrame, wordings: DataFrame, k: int, variants: int) -> DataFrame:
    """``bm25_top_k`` of several wordings (query_id, variant, question) of each query at once.

    The chunks are read and tokenized for all *variants* (0, 1, ...) together. Adds the column variant.
    """
    asked = wordings.select((F.col("query_id").cast("bigint") * variants + F.col("variant")).alias("query_id"), "question")
    variant = F.pmod("query_id", F.lit(variants)).cast("int")
    ranked = bm25_top_k(chunks, asked, k).withColumn("variant", variant)
    return ranked.withColumn("query_id", F.expr(f"(query_id - variant) DIV {variants}"))


def max_normalised(ranked: DataFrame) -> DataFrame:
    """Score relative to the best of the same query (groups are top-k bounded)."""
    top = F.max("lexical_score").over(Window.partitionBy("query_id"))
    return ranked.withColumn(
        "score", F.when(top > 0, F.round(F.col("lexical_score") / top, DIGITS)).otherwise(F.lit(0.0))
    )


def rare_threshold(frequencies: DataFrame) -> DataFrame:
    """Document frequency at the bottom decile of the whole vocabulary."""
    at = F.greatest(F.ceil(F.col("total") / 10) - 1, F.lit(0))
    return cumulative_counts(frequencies, "df", []).agg(at_index("df", at).alias("threshold"))


def rare_query_terms(chunks: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """First rare terms of each query, in question order."""
    path = shared_path(chunks.sparkSession, "frequencies")  # read three times below
    term_frequency(prepared(chunks)).write.parquet(path)
    frequencies = chunks.sparkSession.read.schema("term string, df bigint").parquet(path)
    threshold = rare_threshold(frequencies).scalar()
    terms = queries.select(
        "query_id",
        F.posexplode(
            F.filter(
                F.array_distinct(tokens(F.col("question"))),
                lambda term: (F.length(term) >= 2) & ~term.rlike("^[0-9]+$"),
            )
        ).alias("pos", "term"),
    )
    rare = terms.join(frequencies, "term").where(F.col("df") <= threshold)
    order = Window.partitionBy("query_id").orderBy("pos")
    return rare.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select(
        "query_id", "term", "df", "rn"
    )
