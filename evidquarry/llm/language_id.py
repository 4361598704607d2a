"""Language identification of code-switched text with a linear-chain conditional random field.

Features of a word are its prefixes and suffixes of one to three letters, the letter pairs
and triples inside it, and its entry in the lexicon of frequent training words. Transition
weights between the languages of neighbouring words are learned as well. As documents carry
one label each, training sequences are spliced from stretches of words of documents of
different languages, so the model sees switches; weights maximize the conditional
likelihood (forward-backward gradients, adaptive steps).

Training data is a bounded sample: at most ``SAMPLE`` documents a language (drawn by hashes of
the id), of each at most ``STRETCHES`` stretches of ``STRETCH`` words, for at most
``LANGUAGES`` languages. Prediction covers every word of every text: word scores are computed
once for each distinct word of a task (a table of bounded size), and forward-backward runs
over all texts of a portion at once. A text is cut into chunks; chunk transfer matrices
are multiplied up first, so each chunk starts from its exact forward and backward messages
and long texts cost no more for a word than short ones.

A document's language is the one with the largest expected share of its words, the score is
that share. Defined results: null, empty and letterless texts are ``und`` with score 0; if
nothing can be learned every text is ``und``; ties between languages go to the one first in
alphabetical order; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidquarry.llm.base import table, text_portions
from evidquarry.llm.shingles import mixed

UNKNOWN = "und"
SAMPLE, LANES, STRETCHES, STRETCH, LANGUAGES = 300, 30, 4, 60, 200
LEXICON_COUNT, FEATURE_COUNT = 4, 3
SEQUENCES, LENGTH, STEPS, RATE, DECAY = 2400, 48, 60, 0.5, 1e-3
CHUNK, PORTION, REMEMBERED = 64, 1_000_000, 200_000
WORDS = re.compile(r"[^\W\d_]+")


def _keys(*parts: np.ndarray) -> np.ndarray:
    total = np.full(parts[0].shape, np.uint64(len(parts)))
    for part in parts:
        total = mixed(total + part.astype(np.uint64))
    return total


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature key) of all features of lower-cased words, sorted by word.

    Letter pairs and triples of the word between its boundary marks (at the marks these are
    the prefixes and suffixes of one and two letters), prefix and suffix of three letters,
    and the word itself as lexicon entry. A key is a 64-bit hash of the letters.
    """
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), size)
    begin = np.cumsum(size) - size
    place = np.arange(len(letters)) - begin[owner]
    rest = size[owner] - place
    pad = np.concatenate([letters, np.zeros(3, np.uint32)])
    found = []
    for n in (2, 3, 4):
        at = np.flatnonzero(rest >= n) if n < 4 else np.flatnonzero((rest >= n) & ((place == 0) | (rest == n)))
        found.append((owner[at], _keys(*(pad[at + i] for i in range(n)))))
    own = np.add.reduceat(mixed(letters.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), begin)
    found.append((np.arange(len(words)), _keys(*[own] * 5)))
    owner, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(owner, kind="stable")
    return owner[order], keys[order]


class Model:
    """Weights of the field: word features by sorted key, start and transition scores."""

    def __init__(self, languages: list[str], keys: np.ndarray, weights: np.ndarray, start: np.ndarray, moves: np.ndarray):
        self.languages, self.keys, self.start, self.moves = languages, keys, start, moves
        self.weights = np.concatenate([weights, np.zeros((1, len(languages)))])  # the last row: unknown features

    def word_scores(self, words: list[str]) -> np.ndarray:
        owner, keys = features([w.lower() for w in words])
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = np.where(self.keys[at] == keys, at, len(self.keys))
        begin = np.searchsorted(owner, np.arange(len(words)))
        return np.add.reduceat(self.weights[at], begin, axis=0)


def _messages(scores: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals [n, length, languages] and expected moves, for sequences of one length."""
    local = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(moves)
    count, length, size = scores.shape
    ahead, back = np.empty_like(local), np.ones_like(local)
    ahead[:, 0] = np.exp(start) * local[:, 0]
    for t in range(1, length):
        ahead[:, t] = ((ahead[:, t - 1] / ahead[:, t - 1].sum(1, keepdims=True)) @ step) * local[:, t]
    for t in range(length - 2, -1, -1):
        back[:, t] = (local[:, t + 1] * back[:, t + 1]) @ step.T
        back[:, t] /= back[:, t].sum(1, keepdims=True)
    both = ahead * back
    pair = np.einsum("nti,ij,ntj->ntij", ahead[:, :-1], step, local[:, 1:] * back[:, 1:])
    pair /= pair.sum((2, 3), keepdims=True)
    return both / both.sum(2, keepdims=True), pair.sum((0, 1))


def fitted(sample: list[tuple[str, list[list[str]]]], seed: int = 11) -> Model | None:
    """A model from (language, stretches of words) of labelled documents."""
    languages = sorted({lang for lang, stretches in sample if stretches})
    if not languages:
        return None
    code = {lang: i for i, lang in enumerate(languages)}
    pool: list[list[list[str]]] = [[] for _ in languages]
    for lang, stretches in sample:
        pool[code[lang]] += stretches
    random = np.random.default_rng(seed)
    words, gold = [], []
    for _ in range(SEQUENCES):  # spliced sequences: stretches of documents of several languages
        row, label = [], []
        while len(row) < LENGTH:
            lang = int(random.integers(len(languages)))
            stretch = pool[lang][int(random.integers(len(pool[lang])))]
            run = int(random.integers(3, 24))
            at = int(random.integers(max(1, len(stretch) - run)))
            row += stretch[at : at + run]
            label += [lang] * len(stretch[at : at + run])
        words.append(row[:LENGTH])
        gold.append(label[:LENGTH])
    gold = np.array(gold)
    lexicon = Counter(w for row in words for w in row)
    types = sorted(lexicon)
    place = {w: i for i, w in enumerate(types)}
    owner, keys = features(types)
    names, used, counts = np.unique(keys, return_inverse=True, return_counts=True)
    common = np.array([lexicon[w] >= LEXICON_COUNT for w in types])[owner]
    kept = (counts[used] >= FEATURE_COUNT) | ((counts[used] == 1) & common)  # a word of its own occurs once among the types
    owner, names = owner[kept], keys[kept]
    names, used = np.unique(names, return_inverse=True)
    ids = np.array([[place[w] for w in row] for row in words])
    size = len(languages)
    weights, start, moves = np.zeros((len(names), size)), np.zeros(size), np.zeros((size, size))
    speed = [np.full_like(x, 1e-6) for x in (weights, start, moves)]
    truth = np.eye(size)[gold]
    true_moves = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])

    def gathered(values: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
        return np.stack([np.bincount(groups, values[:, k], count) for k in range(size)], axis=1)

    for _ in range(STEPS):
        scores = gathered(weights[used], owner, len(types))
        marginals, expected = _messages(scores[ids], start, moves)
        gap = truth - marginals
        by_type = gathered(gap.reshape(-1, size), ids.reshape(-1), len(types))
        slopes = (
            gathered(by_type[owner], used, len(names)) / SEQUENCES - DECAY * weights,
            gap[:, 0].sum(0) / SEQUENCES - DECAY * start,
            (true_moves - expected) / SEQUENCES - DECAY * moves,
        )
        for value, slope, total in zip((weights, start, moves), slopes, speed, strict=True):
            total += slope**2
            value += RATE * slope / np.sqrt(total)
    return Model(languages, names, weights, start, moves)


def _stretches(text: str) -> list[list[str]]:
    """At most STRETCHES runs of STRETCH words, evenly spread over the whole text."""
    words = [w.lower() for w in WORDS.findall(text)]
    starts = np.linspace(0, max(0, len(words) - STRETCH), STRETCHES).astype(int) if len(words) > STRETCH else [0]
    return [words[s : s + STRETCH] for s in sorted(set(starts)) if words]


def learned(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on the bounded sample of the documents that *allowed* admits."""
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.col(lang_col) != UNKNOWN))
    ids = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    lane = F.pmod(F.xxhash64("id", F.lit("lane")), F.lit(LANES))  # no task has to rank a whole language
    order = Window.partitionBy("lang", "lane").orderBy(F.xxhash64("id"), "id")
    chosen = (
        ids.withColumn("lane", lane).withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE // LANES)
        .orderBy("n", "lang", "lane").limit(SAMPLE * LANGUAGES)
        .select("id").distinct()
    )  # at most SAMPLE * LANGUAGES ids: small enough to send to every task

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([_stretches(t.as_py() or "") for t in batch.column(2)], pa.list_(pa.list_(pa.string())))],
                names=["id", "lang", "stretches"])

    kind = docs.schema[id_col].dataType.simpleString()
    sample = (
        rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id").mapInArrow(cut_out, f"id {kind}, lang string, stretches array<array<string>>").collect())
    sample.sort(key=lambda r: (r.lang, r.id, r.stretches))
    return fitted([(r.lang, r.stretches) for r in sample if r.stretches])


class Labeller:
    """Expected language shares of whole texts."""

    def __init__(self, model: Model):
        self.model = model
        self.step = np.exp(model.moves)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.languages)))
        self.lettered = np.empty(0, bool)

    def _learn(self, words: list[str]) -> None:
        scores = self.model.word_scores(words)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.table = np.concatenate([self.table, np.exp(scores - scores.max(1, keepdims=True))])
        self.lettered = np.concatenate([self.lettered, np.array([any(map(str.isalpha, w)) for w in words])])

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, expected share of each language) of every text."""
        lists = [WORDS.findall(t) for t in texts]
        words = [w for own in lists for w in own]
        if len(self.place) > REMEMBERED:
            self._forget()
        if new := list({w for w in words if w not in self.place}):
            self._learn(new)
        ids = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(texts)), [len(own) for own in lists])
        if len(ids) and not self.lettered[ids].all():
            owner, ids = owner[self.lettered[ids]], ids[self.lettered[ids]]
        counts = np.bincount(owner, minlength=len(texts))
        if not len(ids):
            return counts, np.zeros((len(texts), len(self.model.languages)))
        return counts, self._totals(self.table[ids], counts) / np.maximum(counts, 1)[:, None]

    def _totals(self, local: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of the word marginals of each text, from the words' own factors in *local*.

        Within a chunk factors are multiplied up without scaling: CHUNK steps stay far
        inside the range of a double.
        """
        size, step = local.shape[1], self.step
        per_text = -(-counts // CHUNK)
        owner = np.repeat(np.arange(len(counts)), per_text)
        start_of = np.cumsum(per_text) - per_text
        within = np.arange(len(owner)) - start_of[owner]
        length = np.minimum(CHUNK, counts[owner] - within * CHUNK)
        order = np.argsort(-length, kind="stable")  # chunks still running at a step come first
        rank = np.argsort(order)
        begin = ((np.cumsum(counts) - counts)[owner] + within * CHUNK)[order]
        running = np.searchsorted(-length[order], -np.arange(CHUNK))
        first = (within == 0)[order]
        opening = np.exp(self.model.start) / size
        begins = step.copy()[None].repeat(len(owner), axis=0)  # a text's first word has no word before it
        begins[first] = opening
        transfer = begins * local[begin][:, None, :]
        for t in range(1, CHUNK):
            n = running[t]
            if not n:
                break
            transfer[:n] = (transfer[:n].reshape(-1, size) @ step).reshape(n, size, size) * local[begin[:n] + t][:, None, :]
        transfer /= transfer.sum((1, 2), keepdims=True)
        entry, leave = np.ones((2, len(owner), size))
        for k in range(1, per_text.max()):  # messages between the chunks of all texts
            here = start_of[per_text > k] + k
            entry[here] = np.einsum("ni,nij->nj", entry[here - 1], transfer[rank[here - 1]])
            entry[here] /= entry[here].sum(1, keepdims=True)
        for k in range(per_text.max() - 1, 0, -1):
            here = start_of[per_text > k] + k - 1
            leave[here] = np.einsum("nij,nj->ni", transfer[rank[here + 1]], leave[here + 1])
            leave[here] /= leave[here].sum(1, keepdims=True)
        ahead = np.empty((CHUNK, len(owner), size))
        ahead[0] = np.einsum("ni,nij->nj", entry[order], begins) * local[begin]
        for t in range(1, CHUNK):
            n = running[t]
            np.multiply(ahead[t - 1, :n] @ step, local[begin[:n] + t], out=ahead[t, :n])
        sums = np.zeros((len(owner), size))
        state, back = leave[order], np.ascontiguousarray(step.T)
        for t in range(CHUNK - 1, -1, -1):
            n = running[t]
            both = ahead[t, :n] * state[:n]
            sums[:n] += both / both.sum(1, keepdims=True)
            state[:n] = (local[begin[:n] + t] * state[:n]) @ back
        totals = np.zeros((len(counts), size))
        np.add.at(totals, owner[order], sums)
        return totals


def identified(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The *keep* columns of every document with lang_pred and score."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value) if sent.value else None
        for batch in batches:
            for at, texts in text_portions(batch.column(0), PORTION):
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if labeller:
                    counts, shares = labeller.shares(texts)
                    best = np.round(shares, 12).argmax(1)
                    names = [labeller.model.languages[b] if n else UNKNOWN for b, n in zip(best, counts, strict=True)]
                    scores = np.where(counts > 0, np.clip(shares.max(1), 0, 1), 0.0)
                rest = [c.slice(at, len(texts)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names), pa.array(scores)], names=[*batch.schema.names[1:], "lang_pred", "score"])

    kept = docs.select(F.col(text_col).alias("_text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, learned(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_crf_language": op7_crf_language}
ORACLES: dict[str, str] = {}
