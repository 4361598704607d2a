"""Lexical ranking in bounded portions, and document frequencies without postings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidquarry.operators import best, lexical


def test_batches_are_read_in_portions_of_tokens(monkeypatch):
    monkeypatch.setattr(lexical, "TOKENS", 10)
    bags = [["t"] * n for n in (4, 4, 4, 0, 25, 1, 10, 11, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(bags, pa.list_(pa.string()))], names=["chunk_id", "tokens"])
    parts = list(lexical._portions(iter([batch.slice(1), batch.slice(0, 0)])))
    assert [p.column(0).to_pylist() for p in parts] == [[1, 2, 3], [4], [5], [6], [7], [8]] or all(
        p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 10 for p in parts)
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(1, 9))


def test_rows_over_the_bar_are_sorted_in_a_few_times(monkeypatch):
    monkeypatch.setattr(best, "CELLS", 4000)
    sorts = []
    lexsort = np.lexsort
    monkeypatch.setattr(best.np, "lexsort", lambda keys: sorts.append(1) or lexsort(keys))
    rng = np.random.default_rng(7)
    scores, ids = rng.integers(0, 50, (3000, 40)).astype(float), rng.permutation(3000)
    kept = best.Best(np.arange(40), 5)
    for at in range(0, 3000, 3):
        kept.meet(ids[at : at + 3], scores[at : at + 3])
    got = kept.rows().to_pydict()
    want = [(q, int(ids[i]), scores[i, q]) for q in range(40) for i in sorted(range(3000), key=lambda i: (-scores[i, q], ids[i]))[:5]]
    assert list(zip(got["query_id"], got["chunk_id"], got["score"], strict=True)) == want
    assert len(sorts) < 100


def test_frequencies_of_repeated_chunks_are_those_of_their_postings(spark, monkeypatch):
    rows = [(1, "Alpha alpha beta fooBar"), (2, "beta gamma"), (2, "beta gamma"), (3, "beta one more"), (3, "delta"), (None, "alpha"), (None, "omega"), (4, None), (5, "")]
    chunks = spark.createDataFrame([(i, t, "Beta title") for i, t in rows], "chunk_id long, page_content string, title string")
    want = {r.term: r.df for r in lexical.document_frequency(lexical.postings(chunks)).collect()}
    assert {r.term: r.df for r in lexical.term_frequency(chunks).collect()} == want
    monkeypatch.setattr(lexical, "REPEATED", 0)
    assert {r.term: r.df for r in lexical.term_frequency(chunks).collect()} == want


def test_wordings_are_ranked_in_one_pass(spark, monkeypatch):
    passes, scored = [], lexical._scored_block
    monkeypatch.setattr(lexical, "_scored_block", lambda *a: passes.append(1) or scored(*a))
    chunks = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common") for i in range(40)], "chunk_id long, page_content string")
    first = [(q, 0, f"w{q % 7} common") for q in (-3, 0, 4, 9)]
    second = [(-3, 1, "w2"), (0, 1, ""), (4, 1, "w1 w3"), (9, 1, None)]
    frame = spark.createDataFrame(first + second, "query_id long, variant int, question string")
    got = {tuple(r) for r in lexical.wordings_top_k(chunks, frame, 6, 2).select("query_id", "variant", "chunk_id", "lexical_score", "lexical_rank").collect()}
    assert len(passes) == 1
    want = set()
    for variant in (0, 1):
        asked = frame.where(F.col("variant") == variant)
        want |= {(r.query_id, variant, r.chunk_id, r.lexical_score, r.lexical_rank) for r in lexical.bm25_top_k(chunks, asked, 6).collect()}
    assert got == want and len(got) == 8 * 6
