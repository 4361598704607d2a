"""Support sets, the gate, bounded repair, stored scores and releases against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evidquarry.operators import gates, lexical, repair, support
from evidquarry.sources.score_store import ScoreStore, cached_frame
from evidquarry.sources.versions import VersionedTable


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_best_sets_match_all_combinations(spark, threshold):
    rng = random.Random(int(threshold * 10))
    evidence = [(c, s, rng.sample("abcdefghijkl", rng.randint(0, 5))) for c in range(6) for s in range(1, 8) if rng.random() < 0.9]
    claims = [(c, 1, p, rng.sample("abcdefghijklmn", rng.randint(0, 9))) for c in range(7) for p in range(6)]
    frame = spark.createDataFrame(claims, "conv_id long, turn long, pos int, terms array<string>")
    places = support.evidence_places(frame, F.lit(7))
    found = support.best_sets(places, spark.createDataFrame(evidence, "conv_id long, source long, words array<string>"), ["conv_id", "turn", "pos"], threshold).collect()
    want = {}
    for c, _, p, terms in claims:
        own = {s: set(w) & set(terms) for k, s, w in evidence if k == c}
        if not own:
            continue
        n = max(1, len(terms))
        best = None
        for size in (1, 2, 3):
            sets = sorted((-len(set().union(*(own[s] for s in m))), m) for m in itertools.combinations(sorted(own), size))
            if sets and -sets[0][0] >= threshold * n and best is None:
                best = (list(sets[0][1]), round(-sets[0][0] / n, 6))
        want[c, p] = best or (None, round(max(len(v) for v in own.values()) / n, 6))
    assert {(r.conv_id, r.pos): (r.members, r.score) for r in found} == want


def test_a_long_conversation_is_cut_to_its_nearest_sources(spark):
    claims = spark.createDataFrame([(1, 399, 0, ["x"])], "conv_id long, turn long, pos int, terms array<string>")
    places = support.evidence_places(claims, F.floor(F.col("turn") / 2) + 1)
    assert sorted(r.source for r in places.collect()) == list(range(189, 201))


def _facts(spark, rows):
    return spark.createDataFrame(rows, """conv_id long, source long, chunk_id long, fact_id string, entity string, field_path string, value string,
        source_category string, authority int, source_version string, observed_at string, access_policy_id string""")


def test_gate_reasons_come_from_facts_in_order(spark):
    def fact(conv, source, **other):
        row = dict(entity="e", field_path="f", value=f"v{source}", category="PAGE", authority=source, version="1", at="", policy="project:ALPHA") | other
        return (conv, source, source, f"fact:{conv}:{source}", row["entity"], row["field_path"], row["value"], row["category"], row["authority"], row["version"], row["at"], row["policy"])

    facts = _facts(spark, [
        fact(1, 1), fact(1, 2), fact(2, 1, policy="project:BETA"), fact(3, 1, category="CHAT"), fact(4, 1, authority=5), fact(4, 2, authority=5),
        fact(5, 1, version="", at=None), fact(6, 1), fact(7, 1), fact(8, 1), fact(9, 1, authority=5), fact(9, 2, authority=5, version="2"), fact(10, 1, field_path=None), fact(11, 1)])
    answers = spark.createDataFrame(
        [(i, 1, "Names A-1 here", i == 5, i == 6, ["B-2" if i == 6 else "A-1"]) for i in range(1, 13)],
        "conv_id long, turn long, answer string, latest boolean, all_items boolean, expected array<string>")
    texts = {7: "Inference ( ): so it is [SOURCE 1]", 8: "cites nothing known [SOURCE 9]", 11: "Inference (sum): so it is [SOURCE 1]"}
    claims = spark.createDataFrame([(i, 1, 0, texts.get(i, "a claim [SOURCE 1]")) for i in range(1, 12)], "conv_id long, turn long, pos int, claim string")
    found = gates.claim_support(claims, facts, ["conv_id", "turn", "pos"])
    checks = gates.gate_checks(answers, found, facts, ["conv_id", "turn"], "project:ALPHA", (), ("PAGE",))
    got = {r.conv_id: r.failure_reason for r in gates.output_gate(checks).collect()}
    assert got == {1: None, 2: gates.FAILURES[0], 3: gates.FAILURES[1], 4: gates.FAILURES[2], 5: gates.FAILURES[3], 6: gates.FAILURES[4],
                   7: gates.FAILURES[5], 8: gates.FAILURES[6], 9: None, 10: None, 11: None, 12: None}
    kinds = {r.conv_id: (r.claim_type, r.derivation_rule, r.fact_ids) for r in found.collect()}
    assert kinds[11] == ("DERIVED", "sum", ["fact:11:1"]) and kinds[7][1] is None and kinds[8] == ("DIRECT", None, [])


def plain_repair(spark, chunks, questions, needs, first):
    texts = {r.chunk_id: {w.lower() for w in r.page_content.split()} for r in chunks.collect()}
    out = {}

    def top(question, k):
        rows = lexical.bm25_top_k(chunks.drop("title", "reference", "locator"), spark.createDataFrame([(0, question)], "query_id long, question string"), k).orderBy("lexical_rank").collect()
        return [(r.chunk_id, r.lexical_score) for r in rows]

    for q, question in questions.items():
        kept, attempts = [c for c, _ in top(question, first)], 1
        lacking = lambda: [t for t in needs[q] if not any(t in texts[c] for c in kept)]  # noqa: B023, E731
        while lacking() and attempts <= repair.ROUNDS:
            attempts += 1
            fresh = [c for c, s in top(" ".join(lacking()), repair.CANDIDATES) if s > 0 and c not in kept]
            pins = []
            for term in lacking():
                pins += [c for c in fresh if term in texts[c]][:1]
            merged = list(dict.fromkeys([*pins, *kept, *fresh]))
            kept = merged[: repair.KEPT]
        out[q] = (attempts, " ".join(lacking()), ",".join(map(str, kept)))
    return out


def test_repair_asks_only_incomplete_questions_again(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}word" for a in "abcdefghij" for b in "klmno"]
    rows = [(i, " ".join(rng.choice(vocabulary[: 40]) for _ in range(12))) for i in range(60)] + [(90, "rareterm alone"), (91, "akword akword akword rareterm"), (92, "blword " * 9)]
    rows += [(100 + i, "aa bb cc dd " * (i + 1)) for i in range(4)]
    chunks = spark.createDataFrame([(i, t, "t", "r", "l") for i, t in rows], "chunk_id long, page_content string, title string, reference string, locator string")
    questions = {7: "aa bb cc dd rareterm", 1: "akword alword", 2: "akword akword amword rareterm", 3: "neverseen anywhere akword", 4: "blword", 5: "bkword blword bmword cnword dlword rareterm", 6: ""}
    asked = spark.createDataFrame(list(questions.items()), "query_id long, question string")
    needs = asked.select("query_id", F.posexplode(repair.term_requirements(F.col("question"))).alias("place", "term"))
    by_query = {q: [] for q in questions}
    for r in needs.orderBy("query_id", "place").collect():
        by_query[r.query_id].append(r.term)
    got = {r.query_id: (r.attempts, r.missing, r.chunks) for r in repair.repaired(chunks, asked, needs).collect()}
    want = plain_repair(spark, chunks, {q: t for q, t in questions.items() if t}, by_query, 3)
    assert {q: v for q, v in got.items() if q != 6} == want
    assert got[2][0] >= 1 and got[3][0] == 3 and "neverseen" in got[3][1] and any(v[0] == 2 and not v[1] for v in got.values()) and any(v[0] == 1 for v in got.values())


def test_scores_are_kept_evicted_and_only_missing_ones_scored(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path / "s"), "m", "1")
    rows = spark.createDataFrame([(i, f"text {i % 8}") for i in range(20)], "id int, text string")
    rows = rows.withColumn("digest", store.digest(F.col("text")))
    count = lambda f: (f.where("hit").select("digest").distinct().count(), f.where("not hit").select("digest").distinct().count(), f.count())
    assert count(store.scored(rows, F.length("text"), 1)) == (0, 8, 20)
    assert count(store.scored(rows.where("id % 8 < 3"), F.lit(-1), 2)) == (3, 0, 9)
    store.evict(3, capacity=5)
    third = store.scored(rows, F.lit(99), 4)
    assert count(third) == (5, 3, 20)
    values = {r.text: r.score for r in third.collect()}
    assert all(values[f"text {i}"] == 6 for i in range(3)) and sorted(values.values()).count(99.0) == 3
    store.evict(9, ttl=6)  # those of tick 1 have expired, those of tick 4 have not
    assert count(store.scored(rows, F.lit(1), 10)) == (3, 5, 20)
    other = ScoreStore(spark, str(tmp_path / "s2"), "m", "2")
    assert other.rows().count() == 0


def test_releases_are_switched_and_rolled_back_by_checksum(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        table.read()
    one = table.publish(spark.range(10).repartition(3))
    two = table.publish(spark.range(4))
    assert (one, two, table.version, table.read().count()) == (1, 2, 2, 4) and table.intact(1)
    table.roll_back(1)
    assert table.version == 1 and table.read().count() == 10
    assert table.publish(spark.range(2)) == 3
    spark.range(4, 8).write.mode("append").parquet(str(tmp_path / "t" / "data" / "version=2"))
    with pytest.raises(ValueError):
        table.roll_back(2)
    with pytest.raises(LookupError):
        table.roll_back(9)
    assert [(r.version, r.reason) for r in table.history().orderBy("seq").collect()] == [(1, "publish"), (2, "publish"), (1, "rollback"), (3, "publish")]
    frame, held = cached_frame(spark, str(tmp_path / "c"), "k", lambda: spark.range(3), 0, 5)
    assert (frame.count(), held) == (3, False)
    assert cached_frame(spark, str(tmp_path / "c"), "k", lambda: spark.range(9), 4, 5)[1]
    frame, held = cached_frame(spark, str(tmp_path / "c"), "k", lambda: spark.range(9), 5, 5)
    assert (frame.count(), held) == (9, False)


def test_repair_tokenizes_the_chunks_once(spark, monkeypatch):
    read, kept = [], lexical.bags
    for module in (lexical, repair):
        monkeypatch.setattr(module, "bags", lambda chunks: read.append(1) or kept(chunks), raising=False)
    chunks = spark.createDataFrame([(1, "Alpha_Beta gamma", "deltaword"), (2, "alpha gamma", "other"), (3, None, "x")], "chunk_id long, page_content string, symbol string")
    asked = spark.createDataFrame([(1, "gamma beta deltaword")], "query_id long, question string")
    needs = asked.select("query_id", F.posexplode(repair.term_requirements(F.col("question"))).alias("place", "term"))
    row = repair.repaired(chunks, asked, needs).first()
    assert len(read) == 1
    assert (row.attempts, row.missing) == (3, "deltaword") and row.chunks.split(",")[0] == "1"  # a symbol is searched but covers nothing
