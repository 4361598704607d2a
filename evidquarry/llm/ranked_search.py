"""Ranked lexical search: summed accumulators of short lists inside document-at-a-time skipping.

Method
------
Documents are scored where they are read. A first scan counts, for a block of items, the
documents with a term, all terms, and the documents of each asked term. A second one
gathers portions of documents (about ``POSTINGS`` postings) into posting lists and answers the
items one after another:

1. Lists of at most ``1 / SHORT`` of the portion's documents are short. They are added up term
   at a time into accumulators, one (document, partial score) each.
2. The accumulators then stand as one list among the long ones. Each list is bounded by its
   largest contribution. Lists in order of their bounds, those whose bounds together stay
   below the item's bar (its k-th best score so far in the task) cannot bring in a document.
3. The documents of the other lists are candidates; they meet the remaining lists from the
   largest bound down, by binary search over the list, and leave as soon as their partial
   score and the bounds still to come cannot reach the bar.

Scores are integers throughout. A task hands on k rows an item; nothing else is shuffled. Items
go to the tasks in blocks of about ``PAIRS`` (item, term) pairs, each block's rows are written
to the shared folder before the next one is fetched.

Terms are the runs of ASCII letters and digits and of all other characters beyond ASCII, with
A-Z lower-cased.

Defined results: a null or term-free text has no terms, counts for nothing and is never found; a
document without an id counts in the statistics and is not returned; repeated documents are
ranked each; rows of one item id are one item, items without an id or terms give no rows; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidquarry.llm.base import fresh_path, stored, table, text_portions

PAIRS = 500_000
POSTINGS = 2_000_000
TEXT = 4 << 20  # characters made into terms at a time
PIECE = 1 << 20  # bytes of one text split at a time
SHORT = 64
_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c >= 128 or c in _LETTERS else ord(chr(c).lower()) if 65 <= c <= 90 else 32 for c in range(256))


def term_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, as UTF-8, a bounded stretch at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0), batch.column(1), strict=True):
            terms = sorted({t for piece in term_pieces(text.as_py()) for t in piece})
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.binary())], names=["item", "term"])


class Asked:
    """A block of items: the number of every asked term, and the terms of each item."""

    def __init__(self, pairs: pa.Table):
        terms, index = np.unique(np.array(pairs.column("term").to_pylist(), dtype=object), return_inverse=True)
        self.number = {term: i for i, term in enumerate(terms)}
        self.items, owner = np.unique(pairs.column("item").to_numpy(), return_inverse=True)
        order = np.argsort(owner, kind="stable")
        self.terms = np.split(index[order], np.searchsorted(owner[order], np.arange(1, len(self.items))))

    def counted(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of terms of a text, and the asked ones among them with their frequency."""
        length, found = 0, []
        for piece in term_pieces(text):
            at = np.fromiter(map(self.number.get, piece, repeat(-1)), np.int64, len(piece))
            length += len(piece)
            found.append(np.unique(at[at >= 0], return_counts=True))
        if len(found) == 1:
            return length, *found[0]
        if not found:
            return 0, np.empty(0, np.int64), np.empty(0, np.int64)
        term, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
        return length, term, np.bincount(at, np.concatenate([c for _, c in found]), len(term)).astype(np.int64)


def _statistics(sent):
    """A task's sums by slot: documents with terms (0), terms (1), documents of each term (2 ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        sums = np.zeros(2 + len(asked.number), np.int64)
        for batch in batches:
            for _, texts in text_portions(batch.column(1), TEXT):
                for text in texts:
                    length, terms, _ = asked.counted(text)
                    sums[:2] += length > 0, length
                    sums[2 + terms] += 1
        slot = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sums[slot])], names=["slot", "n"])

    return run


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)


class Lists:
    """Posting lists of one portion of documents: (document, contribution) for every term."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray, np.ndarray]], weight: np.ndarray, documents: int, terms: int):
        self.ids = np.array([d[0] for d in docs], np.int64)
        length = np.array([d[1] for d in docs], np.int64)
        term = np.concatenate([d[2] for d in docs])
        doc = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
        times = np.concatenate([d[3] for d in docs])
        order = np.argsort(term, kind="stable")
        term, self.doc, times = term[order], doc[order], times[order]
        norm = 10 + (90 * length * documents) // terms
        self.part = weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * norm[self.doc]))
        self.start = np.searchsorted(term, np.arange(len(weight) + 1))
        filled = np.flatnonzero(np.diff(self.start))
        self.bound = np.zeros(len(weight), np.int64)
        if len(filled):
            self.bound[filled] = np.maximum.reduceat(self.part, self.start[filled])

    def summed(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: documents of the lists in order, with their contributions added up."""
        spans = [slice(self.start[t], self.start[t + 1]) for t in terms]
        if not spans:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return _added(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.part[s] for s in spans]))

    def best(self, terms: np.ndarray, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of all documents that reach the bar (which is at least one)."""
        size = self.start[terms + 1] - self.start[terms]
        terms, size = terms[size > 0], size[size > 0]
        short = size * SHORT <= len(self.ids)
        iterators = [self.summed(terms[short])] if short.any() else []
        iterators += [(self.doc[self.start[t] : self.start[t + 1]], self.part[self.start[t] : self.start[t + 1]]) for t in terms[~short]]
        bounds = [int(part.max()) for _, part in iterators[: int(short.any())]] + self.bound[terms[~short]].tolist()
        order = sorted(range(len(iterators)), key=bounds.__getitem__)
        below = np.cumsum([bounds[i] for i in order])  # most that the lists up to here can bring together
        skipped = int(np.searchsorted(below, bar))  # these lists alone stay below the bar
        lead = [iterators[i] for i in order[skipped:]]
        if not lead:
            return self.ids[:0], self.ids[:0]
        doc, score = lead[0] if len(lead) == 1 else _added(np.concatenate([d for d, _ in lead]), np.concatenate([p for _, p in lead]))
        for i in range(skipped - 1, -1, -1):
            alive = score + below[i] >= bar
            doc, score = doc[alive], score[alive]
            other, part = iterators[order[i]]
            at = np.minimum(np.searchsorted(other, doc), len(other) - 1)
            score = score + np.where(other[at] == doc, part[at], 0)
        alive = score >= bar
        return self.ids[doc[alive]], score[alive]


def _added(doc: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(doc, kind="stable")
    doc, part = doc[order], part[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return doc[first], np.add.reduceat(part, first)


def _ranked(sent, documents: int, terms: int, df: np.ndarray, k: int):
    weight = weights(documents, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        empty = np.empty(0, np.int64)
        top = [(empty, empty)] * len(asked.items)

        def answer(docs: list) -> None:
            lists = Lists(docs, weight, documents, terms)
            for at, own in enumerate(asked.terms):
                ids, scores = top[at]
                found, reached = lists.best(own, int(scores[-1]) if len(scores) == k else 1)
                if len(found):
                    ids, scores = np.concatenate([ids, found]), np.concatenate([scores, reached])
                    order = np.lexsort((ids, -scores))[:k]
                    top[at] = ids[order], scores[order]

        docs, held, most = [], 0, POSTINGS // 32  # a small first portion gives the bars a start
        for batch in batches:
            for start, texts in text_portions(batch.column(1), TEXT):
                ids = batch.column(0).slice(start, len(texts)).to_numpy(zero_copy_only=False)
                for doc, text in zip(ids.tolist(), texts, strict=True):
                    length, own, times = asked.counted(text)
                    if len(own):
                        docs.append((doc, length, own, times))
                        held += len(own)
                    if held >= most:
                        answer(docs)
                        docs, held, most = [], 0, POSTINGS
        if docs:
            answer(docs)
        sizes = [len(ids) for ids, _ in top]
        if any(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked.items, sizes)), pa.array(np.concatenate([i for i, _ in top])), pa.array(np.concatenate([s for _, s in top]))],
                names=["item", "doc", "score"])

    return run


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Rows (item, rank, doc, score): the k best documents of each item, score above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).alias("text"))
    pairs = stored(
        items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long"), F.col(item_text))
        .mapInArrow(_item_terms, "item long, term binary").distinct(), "item-terms")
    blocks = -(-pairs.count() // PAIRS)
    schema, path = "item long, doc long, score long", fresh_path(spark, "ranked")
    for block in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        if not part.num_rows:
            continue
        asked = Asked(part)
        sent = spark.sparkContext.broadcast(asked)
        sums = np.zeros(2 + len(asked.number), np.int64)
        for slot, n in texts.mapInArrow(_statistics(sent), "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
            sums[slot] = n
        if sums[0]:
            named = texts.where("doc is not null")
            named.mapInArrow(_ranked(sent, int(sums[0]), int(sums[1]), sums[2:], k), schema).write.mode("append").parquet(path)
        else:
            spark.createDataFrame([], schema).write.mode("append").parquet(path)
        sent.unpersist()
    hits = spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def op13_hybrid_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

QUERIES = {"op13_hybrid_ranked_search": op13_hybrid_ranked_search}
ORACLES = {
    "op13_hybrid_ranked_search": f"""
WITH d AS (SELECT doc_id, len(ts) AS n, ts FROM (SELECT doc_id, {_TERMS.format(text='text')} AS ts FROM documents WHERE text IS NOT NULL) WHERE len(ts) > 0),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format(text='text')}) AS term FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT row_number() OVER () AS rid, doc_id, n, ts FROM d), unnest(ts) AS u(term)
  GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM f, s),
p AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM t JOIN q USING (term) JOIN w USING (term), s WHERE doc_id IS NOT NULL GROUP BY item_id, rid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
