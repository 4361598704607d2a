"""The rounds of bootstrapped extraction against a plain single-machine version."""

import hashlib
import math
import random

from evidquarry.llm import pii


def plain_found(mentions):
    """(value, kind) -> score after all rounds; mentions are (kind or None, value, fits, patterns)."""
    edges = {}
    for kind, value, fits, patterns in mentions:
        for pattern in patterns:
            old = edges.get((pattern, value), (None, []))
            kinds = [k for k in (old[0], kind) if k is not None]
            edges[pattern, value] = (min(kinds) if kinds else None, max(old[1], fits))
    edges = {key: (kind, fits if kind is None else [kind]) for key, (kind, fits) in edges.items()}
    size, suiting = {}, {}
    for (pattern, _), (_, fits) in edges.items():
        size[pattern] = size.get(pattern, 0) + 1
        for k in fits:
            suiting[pattern, k] = suiting.get((pattern, k), 0) + 1
    found = {}
    for _ in range(pii.ROUNDS):
        weight = {}
        for (pattern, value), (kind, _) in edges.items():
            for k in range(len(pii.KINDS)):
                score = float(kind == k) if kind is not None else found.get((value, k), 0.0)
                if score or kind == k:
                    weight[pattern, k] = weight.get((pattern, k), 0.0) + score
        sure = {}
        for (pattern, k), w in weight.items():
            if w >= pii.SUPPORT:
                fitting = suiting.get((pattern, k), 0)
                against = size[pattern] - fitting + pii.UNSEEN * max(fitting - w, 0.0)
                if w / (w + against) >= pii.CONFIDENT:
                    sure[pattern, k] = w / (w + against)
        miss = {}
        for (pattern, value), (kind, fits) in edges.items():
            for k in fits if kind is None else ():
                if (pattern, k) in sure:
                    miss[value, k] = miss.get((value, k), 0.0) + math.log(max(1 - sure[pattern, k], 1e-9))
        found = {key: 1 - math.exp(m) for key, m in miss.items()}
    return found


def plain_spans(texts):
    per_text, mentions = [], []
    for text in texts:
        base = pii.base_spans(text)
        own = [(k, s, e, [k]) for s, k, e in base] + [(None, s, e, [k for k in range(4) if pii._fits(k, text[s:e])]) for s, e in pii._loose(text, base)]
        named = [(k, s, e, hashlib.md5(text[s:e].lower().encode()).hexdigest(), fits, pii._patterns(text, s, e)) for k, s, e, fits in own]
        mentions += [(k, v, fits, patterns) for k, _, _, v, fits, patterns in named]
        per_text.append((base, named))
    found = {key: score for key, score in plain_found(mentions).items() if score >= pii.CONFIDENT}
    out = []
    for base, named in per_text:
        added = []
        for kind, start, end, value, fits, _ in named:
            best = [(found[value, k], -k) for k in fits if (value, k) in found] if kind is None else []
            if best:
                added.append((start, -max(best)[1], end))
        out.append(sorted([*base, *added]))
    return out


def test_added_spans_are_those_of_plain_rounds(spark):
    rng = random.Random(12)
    opening = ["call me at", "reach us on", "invoice number is", "part no", "server lives at", "mail to me", "see item"]
    closing = ["today", "or later", "thanks", ""]
    texts = []
    for i in range(400):
        lead = rng.choice(opening)
        digits = "".join(rng.choice("0123456789") for _ in range(10))
        value = {
            "call me at": rng.choice([f"+1 {digits}", f"+1 {digits}", digits]), "reach us on": rng.choice([f"+44 {digits}", digits, digits]),
            "invoice number is": digits, "part no": rng.choice([digits, f"+1 {digits}", f"+1 {digits}", f"+1 {digits}"]),
            "server lives at": rng.choice([f"10.0.{i % 256}.{i % 7}", f"10.300.{i}.1", f"1.2.{i}"]),
            "mail to me": rng.choice([f"u{i}@host.org", f"u{i}@host.org", f"u{i}@intranet"]), "see item": rng.choice([digits, f"x@{i}", "1234567"]),
        }[lead]
        texts.append(f"{rng.choice(['so', 'please', 'now then'])} {lead} {value} {rng.choice(closing)}")
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    want = plain_spans(texts)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, kind int")).collect()}
    assert got == dict(enumerate(want))
    assert sum(len(w) > len(pii.base_spans(t)) for w, t in zip(want, texts, strict=True)) > 20  # the rounds did add some
