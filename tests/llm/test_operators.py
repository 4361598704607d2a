"""The training-data operators against brute force, with awkward rows throughout.

Small tables hold nulls in every column, empty and very long texts, ties, repeated rows, and
columns whose names clash with the operators' own.
"""

import hashlib
import random
import re
import struct
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from evidquarry.llm import bpe, chat_format, decontamination, language_id, near_dedup, pii, sharding, token_counts, topk_search, warc
from evidquarry.llm.base import components
from evidquarry.llm.pretokens import Vocabulary
from evidquarry.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\t ", "a", "<|endoftext|>x<|endoftext|>", "A  B c\x1cd", "Σίσυφος ΣΑΣ İ é é", "'ll it'S 12,345 ՘ ꟎",
       "中文，字 😀", "a" * 5000, "ab" * 3000 + " end", "!?" * 2000, " " * 300 + "x"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_shingles(text):
    words = words_of(text)
    if len(words) < 5:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(texts, per_cent):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    ids = sorted(texts)
    changed = True
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 160))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[len(texts)] = (" " if rng.random() < 0.5 else "\n").join(words).upper()
    for odd in ["", " \n", None, "one two", "ONE  two", "one two three four five", "long " * 40000]:
        texts[len(texts)] = odd
    return texts


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark, copies):
    rows = [(i, t, 1, "x") for i, t in copies.items()] + [(None, "one two", 0, "n"), (None, None, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, bucket string")
    for per_cent in (80, 85):
        got = near_dedup.near_duplicates(docs, per_cent=per_cent).collect()
        assert len(got) == len(rows)
        want = brute_components(copies, per_cent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_with_blocks_of_two(spark, copies, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 3)
    docs = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, per_cent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(copies, 85)


def test_hyperminhash_estimate_is_close():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        pool = rng.integers(0, 2**63, 6000).astype(np.uint64) * np.uint64(2)
        cut = int(3000 * share)
        a, b = np.unique(pool[:3000]), np.unique(np.concatenate([pool[:cut], pool[3000 : 6000 - cut]]))
        x, y = near_dedup.registers([a, b])
        filled = ((x != near_dedup.EMPTY) | (y != near_dedup.EMPTY)).sum()
        estimate = (((x == y) & (x != near_dedup.EMPTY)).sum() - near_dedup.chance_collisions(np.array(3000), np.array(3000))) / filled
        assert abs(estimate - share / (2 - share)) < 0.15


def test_containment_matches_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    items = {i: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 40, 80]))) for i in range(30)}
    items |= {30: None, 31: "", 32: items[5], 33: "Lone  item"}
    docs = {0: None, 1: "", 2: " \n", 3: "lone ITEM", 4: "a lone item here in text"}
    for i in range(5, 120):
        text = [rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 300))]
        own = words_of(items[rng.randrange(34)])
        for _ in range(rng.choice([0, 0, 1, 1, 3])):
            if own:
                own[rng.randrange(len(own))] = "changed"
        at = rng.randint(0, len(text))
        docs[i] = " ".join(text[:at] + own + text[at:]).upper()
    docs[120] = "filler word " * 60000 + items[7] + " tail"
    doc_rows = spark.createDataFrame([(i, t, 5) for i, t in docs.items()] + [(None, items[7], 5)], "doc_id long, text string, item_id int")
    item_rows = spark.createDataFrame([(i, t, None) for i, t in items.items()], "item_id long, text string, doc_id string")
    want = set()
    for d, text in [*docs.items(), (None, items[7])]:
        own = plain_shingles(text)
        for i, item in items.items():
            need = plain_shingles(item)
            if need and 100 * len(need & own) >= 80 * len(need):
                want.add((d, i, len(need), len(need & own)))
    for block in (4_000_000, 40):
        monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", block)
        got = decontamination.contained_items(doc_rows, item_rows).collect()
        assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == want and len(got) == len(want)
        kept = decontamination.without_items(doc_rows, item_rows).collect()
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(docs) - {w[0] for w in want})
    assert decontamination.contained_items(doc_rows, item_rows.limit(0)).count() == 0
    assert decontamination.without_items(doc_rows.limit(0), item_rows).count() == 0


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = {i: [float(x) for x in rng.normal(0, 0.2, 24)] for i in range(140)}
    for i in range(60, 90):
        vectors[i] = vectors[7]
    vectors |= {200: None, 201: [None] + [0.5] * 23, 202: [float("nan")] + [0.5] * 23, 203: [float("inf")] * 24, 204: [1.0] * 3, 205: [], 206: [1e11] * 24}
    rows = [(i, v, i) for i, v in vectors.items()] + [(None, [1.0] * 24, 0), (8, vectors[8], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long").repartition(3)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for block in (2_000_000, 100):
        monkeypatch.setattr(topk_search, "BLOCK_COMPONENTS", block)
        monkeypatch.setattr(topk_search, "ROWS", 16)
        got = topk_search.exact_top_k(frame.where("vec_id % 4 = 0"), frame, 5).collect()
        want = set()
        for q in {i for i, _ in whole if i % 4 == 0}:
            own = dict(whole)[q]
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in whole if i != q and len(v) == len(own))
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:5], 1)}
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk_search.exact_top_k(frame.limit(0), frame, 5).count() == 0


def test_a_full_block_of_queries_meets_rows_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    queries = rng.integers(-256, 257, (20_000, 64))
    rows = rng.integers(-256, 257, (600, 64))
    tracemalloc.start()
    best = [topk_search.Best(np.arange(i, i + topk_search.SLICE), queries[i : i + topk_search.SLICE], 5) for i in range(0, 20_000, topk_search.SLICE)]
    for portion in topk_search.portions(np.arange(100_000, 100_600), rows, topk_search.WARM):
        for own in best[:4]:
            own.meet(portion)
    assert tracemalloc.get_traced_memory()[1] < 250 << 20
    tracemalloc.stop()
    exact = queries[:1024] @ rows.T
    for q in (0, 77, 1023):
        order = sorted((-exact[q, r], 100_000 + r) for r in range(600))[:5]
        assert [(-s, i) for at, s, i in best[0].rows.T.tolist() if at == q] == order


def plain_pii(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_patterns_match_the_plain_ones():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "1", "23", "4539", "256", ".", "-", " ", "+", "(", ")", "_", "é", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "x@y.z"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_pii(text), text
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []
    zeros = "0" * 5000
    assert pii.base_spans(f"v {zeros}.1.2.3 x") == [(2, 1, 5008)] and pii.base_spans(f"{zeros}256.1.2.3") == []
    assert pii.base_spans("7" * 9000 + " " + zeros) == []


def test_context_words_may_be_long_or_missing():
    text = "call " + "x" * 400 + " +1 555 123 4567 " + "y" * 400
    at = text.index("+")
    assert pii._patterns(text, at, at + 15) == ["M " + "x" * 160 + " _ " + "y" * 160]
    text = "call " + "x" * 100 + " " + "z" * 120 + "  +1 555 123 4567"
    at = text.index("+")
    assert pii._patterns(text, at, len(text)) == ["L " + "x" * 100 + " " + "z" * 120]
    assert pii._patterns("+1 555 123 4567", 0, 15) == []


def test_bootstrapping_finds_unseen_identifiers_by_context(spark):
    rows = [(i, f"some words mail me at user{i}@host{i}.example.org today {i}", 1) for i in range(30)]
    rows += [(100, "other words MAIL me at odd.person@intranet now", 1), (101, "see item 1234567 of the list", 1), (102, None, 1), (None, "", 1), (103, "me at nothing", 1)]
    rows += [rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value int")
    got = pii.digest_columns(pii.personal_data(docs)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    start = rows[30][1].index("odd.person")
    assert by_id[100].spans == f"email:{start}:{start + len('odd.person@intranet')}" and by_id[100].n_email == 0
    assert by_id[101].spans == by_id[102].spans == by_id[103].spans == by_id[None].spans == ""
    for i, text, _ in rows[:30]:
        shown = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_pii(text))
        assert by_id[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and by_id[i].spans == shown
    assert pii.digest_columns(pii.personal_data(docs.limit(0))).count() == 0
    assert pii.redacted_text("a x@y.zz b 1.2.3.4", pii.base_spans("a x@y.zz b 1.2.3.4")) == "a [EMAIL] b [IP]"


def test_virtual_slots(spark):
    rows = [(i, "x" * (i % 97), None) for i in range(4000)] + [(None, None, "a"), (None, "é", "a"), (5, "x" * 5, "a"), (9000, "y" * 5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.sharded(docs, 24).collect()
    assert len(got) == len(rows) and all(r.law == "bytes" and r.grown_shard is None for r in got)
    sums = [sum(r.size for r in got if r.shard == s) for s in range(24)]
    assert max(sums) - min(sums) <= 128
    for s in range(24):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert {r.size for r in got if r.doc_id is None} == {8, 10}
    plain = sorted(((i is None, i or 0), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in got) == plain
    assert sharding.sharded(docs.limit(0), 24).count() == 0


def test_a_stored_map_is_edited_for_more_records_and_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 20)
    rows = [(i, "x" * (i % 97)) for i in range(3000)] + [(7, "long " * 40_000)] + [(8, "same row")] * 2000 + [(9, None)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "map")
    first = sharding.sharded(docs, 6, map_path=path, next_shards=7).collect()
    assert len(first) == len(rows) and {r.map_version for r in first} == {1} and sharding.latest_version(spark, path) == 2
    moved = [r for r in first if r.next_shard != r.shard]
    assert moved and len(moved) < len(rows) / 3 and {r.next_shard for r in first} == set(range(7))
    sums = [sum(r.size for r in first if r.shard == s and r.size < 1000) for s in range(6)]
    assert max(sums) < 200_000 and len({r.virtual_slot for r in first if r.doc_id == 8}) > 1000
    again = sharding.sharded(docs, 7, map_path=path).collect()
    assert {r.map_version for r in again} == {2} and {(r.doc_id, r.shard) for r in again if r.doc_id not in (8, 9)} == {(r.doc_id, r.next_shard) for r in first if r.doc_id not in (8, 9)}
    for s in range(7):
        own = sorted(r.slot for r in again if r.shard == s)
        assert own == list(range(len(own)))


def test_slot_maps_are_versioned_and_edited_sparingly(spark, tmp_path):
    loads = {s: 1000 + s % 7 for s in range(2000)}
    first = sharding.balanced_map(loads, 10, 2000)
    grown = sharding.edited_map(first, loads, 11)
    moved = [s for s in first if first[s] != grown[s]]
    assert set(grown.values()) == set(range(11)) and all(grown[s] == 10 for s in moved) and len(moved) < 200
    shrunk = sharding.edited_map(grown, loads, 9)
    totals = [sum(loads[s] for s in shrunk if shrunk[s] == k) for k in range(9)]
    assert max(totals) - min(totals) <= 2 * max(loads.values()) and set(shrunk) == set(range(2000))
    for version, placed in enumerate((first, grown), 1):
        sharding.store_map(spark, str(tmp_path / "map"), version, placed)
    assert sharding.load_map(spark, str(tmp_path / "map")) == grown
    assert sharding.load_map(spark, str(tmp_path / "map"), 1) == first


def _text_frame(spark):
    rng = random.Random(8)
    alphabet = ODD + [" ", "\n", "the", "and", "é", "ß", "'s", "12", "."]
    texts = ODD + ["".join(rng.choice(alphabet[-9:] + ODD[:9]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x24F), rng.randint(0x250, 0xD7FF), rng.randint(0xE000, 0x3FFFF)])) for _ in range(25)) for _ in range(80)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, None, 1), (3, texts[3], 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_token_counts_match_the_library(spark):
    rows, docs = _text_frame(spark)
    library = tokenizers.Tokenizer.from_file(WORD)
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    got = token_counts.token_counts(docs, WORD, limit=3).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)
    assert token_counts.token_counts(docs.limit(0), WORD).count() == 0


def test_bpe_matches_the_library_both_ways(spark):
    rows, docs = _text_frame(spark)
    library = tokenizers.Tokenizer.from_file(BYTE)
    got = bpe.encoded(docs, BYTE, columns=("n_tokens", "token_ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encoded(docs.limit(0), BYTE).count() == 0


def test_trie_states_equal_plain_merging_and_memory_may_run_out(monkeypatch):
    with open(BYTE, encoding="utf-8") as file:
        vocabulary = Vocabulary(file.read())
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 50)
    rng = random.Random(6)
    words = {bytes(rng.choice(b" aehinorstd'.0\xc3\xa9") for _ in range(rng.randint(1, 24))) for _ in range(2000)}
    assert dict(bpe.TrieEncoder(vocabulary).encode(words)) == {w: vocabulary.merged(w) for w in words}
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    codec = bpe.Codec(vocabulary)
    texts = [unicodedata.normalize("NFC", f"word{i} and some more words {i}") for i in range(50)]
    assert [codec.decode(p) for t in texts for p in codec.encode_all([t])] == texts


def test_language_shares_equal_a_plain_forward_backward():
    rng = random.Random(2)
    sample = [(lang, [["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(40)]]) for lang, letters in (("aa", "abcdex"), ("bb", "xpqrst")) for _ in range(30)]
    model = language_id.fitted(sample)
    labeller = language_id.Labeller(model)
    texts = [" ".join(w for k in range(n) for w in sample[(k * 7 + n) % 60][1][0])[:size] for n in (1, 3, 20) for size in (5, 200, 9000)]
    counts, shares = labeller.shares(texts)
    for text, count, share in zip(texts, counts, shares, strict=True):
        words = language_id.WORDS.findall(text)
        assert count == len(words)
        plain, _ = language_id._messages(model.word_scores(words)[None], model.start, model.moves)
        assert np.allclose(plain[0].mean(0), share)


def test_language_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").withColumn("score", F.lit(9)).withColumn("_text2", F.lit(None).cast("string"))
    model = language_id.learned(docs, ~language_id.held_out())
    got = language_id.identified(docs, model, keep=("doc_id", "lang")).where(language_id.held_out()).collect()
    assert got and np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ½ ²!"), (None, "the and of"), (5, "word " * 100000), (5, "wordword" * 20000)], "doc_id long, text string")
    seen = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identified(odd, model).collect()]
    assert seen[:3] == [(i, "und", 0.0) for i in (1, 2, 3)] and all(p in model.languages for _, p, _ in seen[3:])
    assert language_id.learned(docs.limit(0), ~language_id.held_out()) is None
    assert {r.lang_pred for r in language_id.identified(odd, None).collect()} == {"und"}
    mixed = docs.where("lang = 'en'").limit(1).first().text + "\n" + docs.where("lang = 'de'").limit(1).first().text
    share = language_id.identified(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().score
    assert share < 0.99


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    html = ["", "<p>é</p>", "same", "WARC/1.1\r\nWARC-Type: x\r\n\r\nbody\r\n\r\n", "line\r\n\r\n\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "same", "", "same"]
    rows = [(i, f"http://h/{i}?a b\n", h, "u") for i, h in enumerate(html)] + [(50, None, None, None), (None, "http://n", "lonely", "u")]
    rows += [(2, "http://h/2?a b\n", "same", "u")] * 3 + [(60, "http://v", "twice", "u"), (60, "http://w", "twice", "u")] + [(61, "http://z", "thrice", "u")] * 3
    monkeypatch.setattr(warc, "SPREAD", 2)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    warc.write_archives(pages, str(tmp_path / "warc"))
    got = warc.read_transactions(spark, str(tmp_path / "warc")).collect()
    assert len(got) == len(rows) and len({r.capture for r in got}) == len(rows)
    page_of = lambda r: int(r.metadata.page_id) if r.metadata.page_id else None
    assert sorted(map(str, (page_of(r) for r in got))) == sorted(str(i) for i, *_ in rows)
    by_text = {}
    for i, url, h, _ in rows:
        by_text.setdefault(h or "", []).append((-1 if i is None else i, url or ""))
    for r in got:
        page = page_of(r)
        text = next(h or "" for i, _, h, _ in rows if i == page)
        assert r.response.digest == __import__("base64").b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert r.metadata.payload_length == len(text.encode()) and r.request.message.startswith("GET ")
        lead = max(by_text[text])[0]
        if r.response.type == "response":
            assert r.response.payload == text and r.metadata.refers_to_page == "" and (page is None or page == lead)
        else:
            assert r.response.type == "revisit" and r.metadata.refers_to_page == str(lead)
            leads = [x for x in got if x.response.record_id == r.response.refers_to]
            assert len(leads) == 1 and leads[0].response.type == "response" and page_of(leads[0]) == lead
    assert sum(r.response.type == "response" for r in got) == len(by_text)
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_transactions(spark, str(tmp_path / "none")).count() == 0


def test_reply_trees_give_the_best_branches(spark):
    rows = [
        (1, 1, None, "user", "root <turn>", 0.0, 0), (1, 2, 1, "assistant", "low", 1.0, 0), (1, 3, 1, "assistant", r"high \l </turn>", 2.0, 0),
        (1, 4, 3, None, None, 0.5, 0), (1, 5, 2, "user", "tail", 1.2, 0),
        (2, 7, 99, "user", "orphan", None, 0), (3, 1, 2, "user", "circle", 1.0, 0), (3, 2, 1, "user", "circle", 1.0, 0),
        (None, 1, None, "assistant", "no tree", 1.0, 0)]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double, place int")
    got = {(r.tree, r.branch): r for r in chat_format.formatted(frame, branches=2).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (None, 1)}
    assert chat_format.parsed(got[1, 1].text) == [("user", "root <turn>"), ("assistant", r"high \l </turn>"), ("", "")]
    assert chat_format.parsed(got[1, 2].text) == [("user", "root <turn>"), ("assistant", "low"), ("user", "tail")]
    span = got[1, 1].loss_spans[0]
    assert chat_format.unescaped(got[1, 1].text[span.start : span.end]) == r"high \l </turn>"
    assert chat_format.formatted(frame.limit(0)).count() == 0


def test_reply_paths_of_a_long_chain(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}\\b<>", 1.0) for i in range(300)]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").repartition(4)
    out = chat_format.formatted(frame).collect()
    assert len(out) == 1 and chat_format.parsed(out[0].text) == [(r[3], r[4]) for r in rows] and len(out[0].loss_spans) == 150


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    body = docs.where("lang = 'en'").first().text
    extra = [(900001, None, None, None, None), (900002, "12 34", "en", "s", 5), (900003, body + " mail a.b@c.org now", "en", "s", 1), (900004, "in the " * 30 + item + " of the", "en", "s", 2), (None, body, None, "s", 3)]
    (docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, DOCS)).withColumn("kept", F.lit(1))
     .write.parquet(str(tmp_path / "documents.parquet")))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect() if r.doc_id is not None}
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r for r in frame.collect() if r.doc_id is not None})
        if k < 4:
            assert frame.columns == list(corpus_pipeline.COLUMNS)
    language, dedup, clean, redacted, encoded = seen
    assert set(before) - set(language) == {900001, 900002}
    texts = {i: r.text for i, r in language.items()}
    want = brute_components(texts, 80)
    assert set(dedup) == {i for i, (_, label) in want.items() if label == i}
    assert frame.where("doc_id is null").count() == 0  # its text has a copy with an id
    items = [plain_shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = lambda own: any(s and 100 * len(s & own) >= 80 * len(s) for s in items)
    assert set(clean) == {i for i in dedup if not held(plain_shingles(texts[i]))} and 900004 not in clean
    library = tokenizers.Tokenizer.from_file(BYTE)
    for i, r in redacted.items():
        assert not plain_pii(r.text) and (r.text == texts[i]) == (not plain_pii(texts[i])) and r.n_chars is not None
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert encoded[i].token_ids == ids
    assert set(encoded) == set(redacted) == set(clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def test_repeated_ids_lose_no_text_and_repeated_rows_one_stays(spark, tmp_path):
    text, other = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, text), (2, text), (2, other), (3, other + " sixteen"), (4, "lone text"), (4, "lone text"), (None, "unseen words"), (None, "unseen words"), (5, None), (5, None), (6, "")]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline._near_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=str)
    assert got == sorted([(1, text), (2, other), (3, other + " sixteen"), (4, "lone text"), (None, "unseen words"), (5, None), (5, None), (6, "")], key=str)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        empty = stage(spark, spark.createDataFrame([], DOCS), "/root/testdata/sf0.001")
        assert empty.count() == 0 and empty.columns == list(corpus_pipeline.COLUMNS), name


def test_shingles_of_a_text_longer_than_a_piece(monkeypatch):
    from evidquarry.llm import shingles

    text = " ".join(f"w{i % 91}" for i in range(5000)) + "\tEnd"
    whole = shingle_set(text)
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert np.array_equal(shingle_set(text), whole) and len(whole) == len(plain_shingles(text))
