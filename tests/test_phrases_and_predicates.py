"""Phrase scans and predicate trees against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from evidquarry.functions.text import normalized_words
from evidquarry.operators import phrases, predicates


@pytest.mark.parametrize("block", [1_000_000, 12])
def test_phrases_of_any_length_are_found_and_counted(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_CHARS", block)
    rng = random.Random(5)
    texts = {i: "".join(rng.choice("abAB .é") for _ in range(rng.randint(0, 40))) for i in range(150)} | {200: None, 201: "", 202: "aba" * 30000}
    needles = {i: "".join(rng.choice("abAB .é") for _ in range(rng.choice([1, 1, 2, 3, 4, 6]))) for i in range(40)} | {50: "", 51: None, 52: needles_of(texts[3]), 53: "aba", 54: "aba"}
    rows = spark.createDataFrame(list(texts.items()), "chunk_id int, body string")
    asked = spark.createDataFrame(list(needles.items()), "needle_id int, needle string")
    got = {tuple(r) for r in phrases.found_in(rows, "chunk_id", F.col("body"), asked).collect()}
    assert got == {(i, n, t.count(x)) for i, t in texts.items() if t is not None for n, x in needles.items() if x is not None and x in t}
    assert phrases.found_in(rows, "chunk_id", F.col("body"), asked.limit(0)).count() == 0
    assert phrases.found_in(rows.limit(0), "chunk_id", F.col("body"), asked).count() == 0


def needles_of(text):
    return text[1:9]


def holds(tree, row):
    for kind, test in (("all_of", all), ("any_of", any)):
        if kind in tree:
            return test(holds(child, row) for child in tree[kind])
    if tree.get("field") not in ("title", "path", "body"):
        return False
    actual = (row[tree["field"]] or "").lower()
    if "equals" in tree:
        return actual == tree["equals"].lower()
    expected = (tree.get("contains") or "").lower()
    loose = re.sub("[^a-z0-9]+", "", expected)
    return bool(expected) and (expected in actual or bool(loose) and loose in re.sub("[^a-z0-9]+", "", actual))


def test_predicate_trees_match_plain_evaluation(spark):
    rng = random.Random(9)
    words = ["Contract", "Spanish", "POS_START_SHIFT", "id 103", "—", "[x]", "e1", "", "Contrato Spanish"]
    rows = [{"chunk_id": i, "title": rng.choice([None, *words]), "path": f'["{rng.choice(words)} {rng.choice(words)}"]', "body": " ".join(rng.choices(words, k=3))} for i in range(80)]

    def tree(depth):
        if depth and rng.random() < 0.7:
            return {rng.choice(["all_of", "any_of"]): [tree(depth - 1) for _ in range(rng.randint(0, 3))]}
        return {"field": rng.choice(["title", "path", "body", "unknown"]), rng.choice(["equals", "contains", "contains"]): rng.choice([*words, "POS-START-SHIFT", "contrato spanish"])}

    cases = {i: tree(3) for i in range(60)}
    cases[100] = {"any_of": [{"all_of": [{"field": "title", "equals": "Contrato Spanish"}, {"field": "path", "contains": "POS_START_SHIFT"}]}]}
    frame = spark.createDataFrame([(r["chunk_id"], r["title"], r["path"], r["body"], 1) for r in rows], "chunk_id long, title string, path string, body string, node int")
    trees = spark.createDataFrame([(i, json.dumps(c)) for i, c in cases.items()] + [(200, None), (201, "{oops"), (202, "[]")], "case_id long, tree string")
    nodes = predicates.predicate_nodes(trees, "case_id", "tree")
    got = {tuple(r) for r in predicates.matching(frame, nodes, "chunk_id", ("title", "path", "body")).collect()}
    assert got == {(i, r["chunk_id"]) for i, c in cases.items() for r in rows if holds(c, r)}


def test_letters_beyond_latin_one_are_folded(spark):
    rows = spark.createDataFrame([("Őrült ŞİŞLİ čaj Ǆ",), ("café Ｘ",), ("Straße ﬁ",)], "t string")
    got = [r[0] for r in rows.select(F.array_join(normalized_words(F.col("t")), " ")).collect()]
    assert got[0].startswith("orult sisli caj") and got[1].startswith("cafe") and got[2].startswith("strasse")


def test_a_condition_of_many_cases_is_held_once(spark, monkeypatch):
    sizes = {}
    kept = predicates._stored

    def stored(df, label):
        out = kept(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(predicates, "_stored", stored, raising=False)
    rows = [(i, f"text {i:03} end", "EN") for i in range(300)] + [(None, "text 005 end", "en")]
    trees = [(c, json.dumps({"all_of": [{"field": "lang", "equals": "En"}, {"field": "body", "contains": f"text {c:03} "}]})) for c in range(50)]
    trees += [(70, json.dumps({"all_of": []})), (71, json.dumps({"field": "lang", "equals": "es"})), trees[3]]
    frame = spark.createDataFrame(rows, "chunk_id long, body string, lang string")
    nodes = predicates.predicate_nodes(spark.createDataFrame(trees, "case_id long, tree string"), "case_id", "tree")
    got = [tuple(r) for r in predicates.matching(frame, nodes, "chunk_id", ("body", "lang")).collect()]
    everywhere = [(70, i) for i in [*range(300), None]]
    assert sorted(got, key=str) == sorted([*((c, c) for c in range(50)), (5, None), *everywhere], key=str)
    # 300 and one English chunks once, not for each of the 50 cases
    assert sizes["held"] <= 301 + 301 + 51 + 50 and sizes["first"] <= 51
