"""Conversation state, spelling variants, populations and aliases on small cases and in plain Python."""

import random

import pytest

from evidquarry.operators import aliases, conversation as CV, members, spelling
from evidquarry.streaming.conversation import folded_stream

TURNS = "conv_id long, turn long, role string, text string"
CASES = [
    ("tell me more", True, "FOLLOWUP_PREFIX"), ("Dime mas sobre eso", True, "FOLLOWUP_PREFIX"), ("and the other app?", True, "FOLLOWUP_PREFIX"),
    ("y pagos?", True, "ELLIPTICAL_CONJUNCTION"), ("what is it?", True, "ANAPHORIC_PRONOUN"), ("please describe", True, "SHORT_VERB_ELLIPSIS"),
    ("from the product types", True, "LEADING_FRAGMENT_CONTINUATION"), ("from the product types, what is MC?", False, "EXPLICIT_SUBJECT"),
    ("these are the only fields available?", True, "DEMONSTRATIVE_ATTRIBUTE_FOLLOWUP"), ("what is cluster that you know?", False, "EXPLICIT_SUBJECT"),
    ("Give me the flow for checking a price for leche", False, "EXPLICIT_SUBJECT"), ("payment gateway retry", False, "EXPLICIT_SUBJECT"), ("", False, "NO_FOLLOWUP_SIGNAL"),
    (None, False, "NO_FOLLOWUP_SIGNAL"), ("what is the", False, "NO_FOLLOWUP_SIGNAL"),
]


def test_follow_ups_and_their_reasons(spark):
    rows = spark.createDataFrame([(i, 0, "user", t) for i, (t, _, _) in enumerate(CASES)], TURNS)
    got = {r.conv_id: (r.follow_up, r.reason) for r in CV.marked(rows).collect()}
    assert got == {i: (f, r) for i, (_, f, r) in enumerate(CASES)}


def plain_fold(marked):
    out = []
    for conv in sorted({r.conv_id for r in marked}):
        asked = told = None
        for r in sorted((r for r in marked if r.conv_id == conv), key=lambda r: r.turn):
            carried = asked or told
            asked, told = r.asked or asked, r.told or told
            if r.role == "user":
                text = r.text or ""
                out.append((conv, r.turn, r.follow_up, r.reason, asked or told or "", f"{text.rstrip()} (previous subject: {carried})" if r.follow_up and carried else text))
    return sorted(out)


@pytest.mark.parametrize("block", [256, 3])
def test_the_state_is_the_same_in_batch_stream_and_plain(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(CV, "BLOCK", block)
    rng = random.Random(block)
    texts = [t for t, _, _ in CASES] + ["Payment gateway AB-12 retries", "Shift report fields", "ok", "I need for POS"]
    rows = [(c, turn, "user" if turn % 2 == 0 else rng.choice(["assistant", "system"]), rng.choice(texts)) for c in range(5) for turn in range(rng.choice([1, 8, 23]))]
    frame = spark.createDataFrame(rows, TURNS)
    want = plain_fold(CV.marked(frame).collect())
    assert sorted(map(tuple, CV.folded(frame).collect())) == want and any(r[5].endswith(")") for r in want)
    for k, part in enumerate((rows[0::1][: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, TURNS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(TURNS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = folded_stream(stream).writeStream.format("memory").queryName(f"state{block}").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert job.awaitTermination(180)
    assert sorted(map(tuple, spark.table(f"state{block}").collect())) == want


def test_anchors_are_shared_tokens_then_sections(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Look at POS_START"), (1, 1, "assistant", "See DOC-7 and POS_START, ABC"), (1, 2, "user", "what of POS_START?"), (1, 3, "user", "more")], TURNS)
    assert {(r.turn, tuple(r.anchors)) for r in CV.anchors(rows).collect()} == {(2, ("POS_START", "DOC-7"))}


def osa(a, b):
    rows = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i, j] = min(rows[i - 1, j] + 1, rows[i, j - 1] + 1, rows[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i, j] = min(rows[i, j], rows[i - 2, j - 2] + (a[i - 1] != b[j - 1]))
    return rows[len(a), len(b)]


def test_corrections_match_a_scan_of_the_whole_vocabulary(spark):
    rng = random.Random(8)
    lexicon = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(250)})
    words = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(150)} - set(lexicon))
    want = {}
    for w in words:
        most = 1 if len(w) <= 5 else 2
        scored = sorted((osa(w, e), abs(len(e) - len(w)), e) for e in lexicon if abs(len(e) - len(w)) <= most)
        near = [s for s in scored if s[0] <= most and s[:2] == scored[0][:2]]
        if len(near) == 1:
            want[w] = near[0][2]
    found = spelling.corrections(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(e,) for e in lexicon], "entry string"))
    assert {r.word: r.correction for r in found.collect()} == want and want


def test_only_shouted_questions_with_unknown_plain_words_change(spark):
    lexicon = spark.createDataFrame([(w,) for w in ("what", "status", "payment", "of", "the")], "entry string")
    asked = [(1, "WAHT IS THE SATTUS OF PAYMNET"), (2, "waht is the sattus"), (3, "WHAT STATUS"), (4, "'SATTUS' `PAYMNET` A1SATTUS SATTUS_X"), (5, "SATTUS, PAYMNET! Of"), (6, None), (7, "")]
    got = {r.query_id: r.corrected for r in spelling.corrected_variants(spark.createDataFrame(asked, "query_id long, question string"), lexicon).collect()}
    assert got == {1: "WHAT IS THE STATUS OF PAYMENT", 5: "STATUS, PAYMENT! Of"}


def test_population_members_come_from_the_best_blocks(spark):
    registry = "# Shortcut registry\n| Key | Use |\n|---|---|\n| F1 | help |\n| F2 | save |\n# Other\n- plain item\n"
    controls = "# Controls\n| Name | Keys |\n|---|---|\n| Arrow keys | move |\n"
    more = "# Shortcut registry\n| Key | Use |\n|---|---|\n| F3 | open |\n| F1 | again |\n"
    rows = [(1, 1, controls, ""), (1, 2, registry, ""), (1, 3, more, ""), (2, 1, controls, ""), (3, 1, "no list here", ""), (3, 2, registry, ""), (4, 1, registry, ""), (5, 1, "", "")]
    evidence = spark.createDataFrame(rows, "query_id long, ord int, page_content string, path string")
    subjects = spark.createDataFrame([(1, 0, ["shortcuts", "shortcut"]), (1, 1, ["keys"]), (2, 0, ["shortcut"]), (2, 1, ["keys"]), (5, 0, ["x"])], "query_id long, place int, labels array<string>")
    got = sorted(map(tuple, members.evidence_members(evidence, subjects).collect()))
    assert [r for r in got if r[0] == 1] == [(1, 1, "F1"), (1, 2, "F2"), (1, 3, "F3")]
    assert not [r for r in got if r[0] in (2, 3, 5)] and [r[2] for r in got if r[0] == 4] == ["F1", "F2"]


def test_alias_classes_join_names_wires_and_symbols(spark):
    links = spark.createDataFrame([("POS_START", "pos.start.v1"), ("pos.start.v1", "StartShift"), ("StartShift", "shift-begin"), ("Other", "other"), ("--", "x"), (None, "y")] + [(f"n{i}", f"n{i + 1}") for i in range(20)], "left string, right string")
    classes = {r.alias: r.representative for r in aliases.alias_classes(links).collect()}
    assert {classes[a] for a in ("pos_start", "pos_start_v1", "start_shift", "shift_begin")} == {"pos_start"} and len({classes[f"n{i}"] for i in range(21)}) == 1
    asked = spark.createDataFrame([("ShiftBegin", 1), ("Unlinked", 2), ("", 3)], "symbol string, a int")
    known = spark.createDataFrame([("POS_START", 10), ("unlinked", 20), ("n3", 30)], "name string, b int")
    found = aliases.same_things(asked, known, aliases.alias_classes(links), "symbol", "name")
    assert {(r.a, r.b) for r in found.collect()} == {(1, 10), (2, 20)}
