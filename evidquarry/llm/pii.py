"""Personal data: fixed patterns, and bootstrapped extraction of identifiers by their context.

Base. E-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers, leftmost and
non-overlapping for each kind; matches that fail their check are dropped without a retry.

Bootstrapping. Each base span is a labelled mention; each other run of digits with separators
(seven digits or more) and each other word with an ``@`` is an unlabelled one. A mention's
context gives lexical patterns: the two words before it, and the word before with the word
after (of a word over 160 code points the 160 nearest count, and none beyond it). Spark builds the bipartite graph of patterns and instances (distinct values) and
scores it in rounds: a pattern's confidence for a kind is positive / (positive + negative)
(Snowball's), given at least ``SUPPORT`` positive. Positive is the summed score of its instances;
negative are those labelled with another kind and those whose shape does not suit the kind. An
instance that suits it and is not found yet says little: what its score lacks of one counts
``UNSEEN`` of a negative, so a pattern with a third of its instances known can still find the
others, and one with a tenth cannot (as many random numbers pass a card's check). An unlabelled instance of suiting shape
scores one minus the product of one minus its patterns' confidences (Snowball's rule), so
instances found in one round support patterns in the next. After ``ROUNDS`` rounds, unlabelled
mentions with a pattern of confidence ``CONFIDENT`` or more whose shape suits the kind are added to the
spans; base spans always stay.

A pattern or instance that occurs very often is one graph edge for each distinct partner; the
edges are aggregated before they are shuffled and no group is ever collected.

Defined results: a null text counts as empty and has no spans; repeated rows each give a
row and count once as instances; empty tables give no rows; other columns are ignored. Offsets are
code points with exclusive ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidquarry.llm.base import cut, stored, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, CONFIDENT, UNSEEN = 3, 5, 0.8, 1 / 8
# The base patterns; the e-mail one is applied around each "@".
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9])*")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
CONTEXT = 160  # a context word is known by this many code points nearest the mention
_WORD = re.compile(rf"\s*(\S{{1,{CONTEXT}}})")


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of the e-mail pattern, found from each "@" outwards in linear time.

    The part before "@" is the whole run of its characters, back to the end of the last span.
    """
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans in order."""
    spans = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(spans)


def _loose(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like runs that touch no base span."""
    found = []
    at = text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        if end - start >= 5:
            found.append((start, end))
        at = text.find("@", end)
    for m in _RUN.finditer(text) if _DIGIT.search(text) else ():
        if m.end() - m.start() >= 7 and len(_NOT_DIGIT.sub("", m.group())) >= 7:
            found.append(m.span())
    reach, k = 0, 0
    for start, end in sorted(found):
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][2])
            k += 1
        if start >= reach:
            yield start, end
            reach = max(reach, end)


def _fits(kind: int, value: str) -> bool:
    """Whether an unlabelled value could be of a kind at all."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == 0:
        return "@" in value[1:-1]
    if "@" in value:
        return False
    if kind == 1:
        return value.count(".") == 3
    return 12 <= len(digits) <= 19 if kind == 2 else 7 <= len(digits) <= 15


def _words_before(text: str, at: int) -> list[str]:
    """The two words before a place; a longer word than CONTEXT is cut and hides what is before it."""
    words: list[str] = []
    while len(words) < 2:
        while at and text[at - 1].isspace():
            at -= 1
        end, floor = at, max(0, at - CONTEXT)
        while at > floor and not text[at - 1].isspace():
            at -= 1
        if at < end:
            words.insert(0, text[at:end])
        if not at or not text[at - 1].isspace():
            break
    return words


def _word_after(text: str, at: int) -> list[str]:
    found = _WORD.match(text, at)
    return [found.group(1)] if found else []


def _patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a mention, with digits folded; none where no words stand there."""
    fold = lambda w: _DIGIT.sub("0", w.lower())
    before = [fold(w) for w in _words_before(text, start)]
    after = [fold(w) for w in _word_after(text, end)]
    out = []
    if len(before) == 2:
        out.append("L " + " ".join(before))
    if before and after:
        out.append(f"M {before[-1]} _ {after[0]}")
    return out


MENTION = "struct<kind:int,start:int,end:int,value:string,fits:array<int>,patterns:array<string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([
        ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()),
        ("fits", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        spans, mentions = [], []
        for item in batch.column(1):
            text = item.as_py() or ""
            found = base_spans(text)
            seen = [(k, s, e, [k]) for s, k, e in found]
            seen += [(None, s, e, [k for k in range(len(KINDS)) if _fits(k, text[s:e])]) for s, e in _loose(text, found)]
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            mentions.append([
                {"kind": k, "start": s, "end": e, "value": hashlib.md5(text[s:e].lower().encode("utf-8", "surrogatepass")).hexdigest(),
                 "fits": fits, "patterns": _patterns(text, s, e)} for k, s, e, fits in seen])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, pa.list_(span)), pa.array(mentions, pa.list_(mention))], names=["id", "base", "mentions"])


def scored_instances(mentions: DataFrame) -> DataFrame:
    """Rows (value, kind, score) of unlabelled instances after the rounds of scoring.

    *mentions* has kind (null: unlabelled), value, fits (kinds its shape suits) and patterns.
    """
    suits = lambda k: F.array_contains("fits", k)
    edges = cut(
        mentions.select("value", "kind", "fits", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value").agg(F.min("kind").alias("kind"), F.max("fits").alias("fits"))
        .withColumn("fits", F.when(F.col("kind").isNull(), F.col("fits")).otherwise(F.array("kind"))))
    labelled = edges.where("kind is not null").select("pattern", "value", "kind", F.lit(1.0).alias("score"))
    open_edges = edges.where("kind is null").select("pattern", "value", "fits")
    sizes = edges.groupBy("pattern").agg(
        F.count("*").alias("instances"), F.array(*(F.count(F.when(suits(k), 1)) for k in range(len(KINDS)))).alias("suiting"))
    found = None
    for _ in range(ROUNDS):
        known = labelled if found is None else labelled.union(
            open_edges.join(found, "value").select("pattern", "value", "kind", "score"))
        sums = known.groupBy("pattern", "kind").agg(F.sum("score").alias("weight"))
        suiting = F.element_at("suiting", F.col("kind") + 1)
        against = F.col("instances") - suiting + UNSEEN * F.greatest(suiting - F.col("weight"), F.lit(0.0))
        patterns = (
            sums.where(F.col("weight") >= SUPPORT).join(sizes, "pattern")
            .select("pattern", "kind", (F.col("weight") / (F.col("weight") + against)).alias("confidence"))
            .where(F.col("confidence") >= CONFIDENT))
        miss = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        found = cut(
            open_edges.join(patterns, "pattern").where(suits(F.col("kind")))
            .groupBy("value", "kind").agg((1 - F.exp(miss)).alias("score")))
    return found


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, base, spans) per document: arrays of (start, kind, end) in order."""
    kind = docs.schema[id_col].dataType.simpleString()
    scanned = stored(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(_scan, f"id {kind}, base array<struct<start:int,kind:int,end:int>>, mentions array<{MENTION}>")
        .withColumn("uid", F.monotonically_increasing_id()),
        "mentions")
    each = scanned.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")
    found = scored_instances(each).where(F.col("score") >= CONFIDENT)
    added = (
        each.where("kind is null and size(fits) > 0").select("uid", "start", "end", "value", F.explode("fits").alias("kind"))
        .join(found, ["value", "kind"])
        .groupBy("uid", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        .groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added")))
    return scanned.select("uid", "id", "base").join(added, "uid", "left").select(
        F.col("id").alias(id_col), "base",
        F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"))


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")  # noqa: E731  (a second parameter would be the place in the array)
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def redacted_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch covered by spans replaced by the name of its first kind."""
    parts, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at, k = end, k + 1
    return "".join([*parts, text[at:]])


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(personal_data(table(spark, sf_dir, "documents")))


QUERIES = {"op3_bootstrapped_pii": op3_bootstrapped_pii}
ORACLES: dict[str, str] = {}
