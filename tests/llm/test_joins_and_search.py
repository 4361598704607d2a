"""The n-gram join, hard negatives and ranked search against brute force, with awkward rows."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidquarry.llm import hard_negatives, jaccard_join, ranked_search

SF = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if len(words) < 4:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute_classes(rows, per_cent):
    """(id, size, smallest id reachable) of each row; rows are documents of their own."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    least = {}
    for at, (i, _) in enumerate(rows):
        if i is not None:
            least[label[at]] = min(i, least.get(label[at], i))
    return sorted(((i, len(sets[at]), least.get(label[at]) if sets[at] else i) for at, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, groups=14, most=16):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"Common{i}" for i in range(30)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 150))]
        if rng.random() < 0.5:
            base[2:2] = passage
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) + 5, (" " if rng.random() < 0.5 else "\n").join(words).upper()))
    rows += [(1000 + i, t) for i, t in enumerate(["", " \n", None, None, "one two", "ONE  two", "a b c d", "long " * 40000, "x y " * 30000, "y x " * 30000])]
    rows += [(None, rows[3][1]), (None, "nobody else says these very words here"), (None, None), (3, rows[4][1]), (3, rows[40][1]), rows[7], rows[7]]
    return rows


@pytest.mark.parametrize("part, pivots, tokens", [(256, 16, 400_000), (3, 1, 400_000), (2, 0, 300)])
def test_token_groups_match_brute_force(spark, monkeypatch, part, pivots, tokens):
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard_join, "PART_TOKENS", tokens)
    monkeypatch.setattr(jaccard_join, "GROUP", 8)
    monkeypatch.setattr(jaccard_join, "QUERIES_A_TASK", 4)
    rows = near_copies(part)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, token string")
    got = jaccard_join.jaccard_classes(docs, per_cent=85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_classes(rows, 85)


def test_token_groups_at_another_threshold_and_empty(spark):
    rows = near_copies(11, groups=5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_classes(docs, per_cent=60).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_classes(rows, 60)
    assert jaccard_join.jaccard_classes(docs.limit(0)).count() == 0


def test_leading_tokens_of_similar_sets_share_enough():
    rng = np.random.default_rng(3)
    crowding = rng.integers(0, 5, jaccard_join.SLOTS).astype(np.uint8)
    for _ in range(300):
        size = int(rng.integers(6, 300))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.85, 1))], rng.integers(0, 2**63, int(size * rng.uniform(0, 0.15))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            assert len(np.intersect1d(jaccard_join.leading(a, crowding, 85), jaccard_join.leading(b, crowding, 85))) >= jaccard_join.LEAST
        union = jaccard_join.TokenUnion([a, b])
        assert union.overlaps(union.bounded(a)).tolist() == [len(a), both]


def brute_negatives(rows):
    whole = [(i, n, [math.floor(256 * x) for x in v]) for i, n, v in rows if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    out = []
    for i, n, v in {(i, n, tuple(v)) for i, n, v in whole if i % 50 == 0}:
        near = sorted((-dot(v, w), j) for j, m, w in whole if j != i and m == n and len(v) == len(w))[:5]
        for p, j in near:
            fitting = sorted((-dot(v, w), k) for k, m, w in whole if k != i and m != n and len(v) == len(w) and 50 * -p <= 100 * dot(v, w) <= 95 * -p)
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fitting[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, block", [(0.2, 2_000_000), (0.2, 60), (30.0, 2_000_000), (1e9, 2_000_000)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, scale, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_COMPONENTS", block)
    monkeypatch.setattr(hard_negatives, "ROWS", 32)
    monkeypatch.setattr(hard_negatives, "SLICE", 2)
    rng = np.random.default_rng(int(scale) + 1)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(0.3 * scale, scale, 16)]) for i in range(260)]
    for i in range(100, 140):
        rows[i] = (i, i % 3, rows[50][2])
    rows += [(300, None, [1.0] * 16), (350, 1, None), (None, 1, [1.0] * 16), (400, 1, [None] + [1.0] * 15), (401, 2, [float("nan")] * 16), (402, 2, [float("inf")] * 16)]
    rows += [(450, 0, [1.0] * 3), (451, 0, [2.0] * 3), (452, 1, [1.5] * 3), (500, 0, []), (501, 0, []), (502, 1, []), (550, 9, [-1.0] * 16), rows[50], (60, 1, rows[61][2]), (-50, 1, rows[3][2])]
    frame = spark.createDataFrame([(i, v, n, 1, "s") for i, n, v in rows], "vec_id long, embedding array<double>, label int, key int, place string").repartition(3)
    got = hard_negatives.mined(frame, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # ids that repeat with one vector count once as anchors and each as candidates
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert hard_negatives.mined(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_packed_products_are_exact_in_every_width():
    rng = np.random.default_rng(1)
    for size, most, kind in ((64, 256, np.float64), (64, 1500, np.int64), (40, 2**40, object)):
        rows, anchors = rng.integers(-most, most + 1, (53, size)), rng.integers(-most, most + 1, (7, size))
        bias = -int(anchors.min())
        packed = hard_negatives.Packed(rows, int(anchors.max()) + bias)
        assert packed.packed.dtype == kind and packed.fields >= 2
        exact = np.clip(anchors.astype(object) @ rows.T.astype(object), -(2**63), 2**63 - 1)
        assert (packed.scores(anchors + bias, bias) == exact).all()


def brute_ranking(docs, items, k):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = [(i, re.findall(pattern, lowered(t))) for i, t in docs]
    held = [(i, t) for i, t in terms if t]
    count, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, own in held:
        for term in set(own):
            df[term] = df.get(term, 0) + 1
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(re.findall(pattern, lowered(text)))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, own in held:
            if i is None:
                continue
            m = 100 - 90 + (90 * len(own) * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * own.count(t)) // (1000 * own.count(t) + 8 * m)) for t in wanted & set(own))
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("postings, pairs, short", [(2_000_000, 500_000, 64), (200, 40, 4), (64, 500_000, 1)])
def test_ranked_search_matches_brute_force(spark, monkeypatch, postings, pairs, short):
    monkeypatch.setattr(ranked_search, "POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "PAIRS", pairs)
    monkeypatch.setattr(ranked_search, "SHORT", short)
    monkeypatch.setattr(ranked_search, "PIECE", 4096)
    rng = random.Random(postings)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["Éa", "Ça b", "x_y", "A-B", "İ", "漢字"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(220)]
    docs += [(500, None), (501, ""), (502, " ,.-"), (None, "t1 t2 rare"), (503, "rare"), (504, "RARE"), (505, "rare"), (505, "rare"), (506, "t1 " * 30000 + "last"), docs[9]]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))) for i in range(15)]
    items += [(50, "rare Rare"), (51, None), (52, ""), (53, "unheard"), (None, "t1"), (54, "last"), (3, "rare"), (55, "t1 t1 t2")]
    frame = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, score int, term string").repartition(3)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    got = ranked_search.ranked(frame, asked, 10)
    assert sorted(map(tuple, got.collect())) == brute_ranking(docs, items, 10)
    assert ranked_search.ranked(frame.limit(0), asked).count() == 0
    assert ranked_search.ranked(frame, asked.limit(0)).count() == 0


@pytest.mark.parametrize("module", [hard_negatives, ranked_search, jaccard_join])
def test_queries_match_their_sql(spark, module):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    for name, query in module.QUERIES.items():
        frame = query(spark, SF)
        cursor = con.execute(module.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert columns == frame.columns
        want = sorted(cursor.fetchall())
        assert sorted(map(tuple, frame.collect())) == want and want
