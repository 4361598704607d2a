"""Citation markers ``[SOURCE n]``: extraction, validity, normal form, removal."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evidquarry.functions.markdown import material_claims

MARKER = r"\[SOURCE (\d+)\]"


def mentioned(answer: Column) -> Column:
    """Ordered distinct source numbers."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(answer, F.lit(MARKER), 1), lambda n: n.cast("bigint"))
    )


def all_claims_cited(lines: Column) -> Column:
    claims = material_claims(lines)
    return (F.size(claims) > 0) & F.forall(claims, lambda c: c["text"].rlike(MARKER))


def failure_reason(answer: Column, citations: Column, count: Column, lines: Column) -> Column:
    """First failing citation check, or null when the citations are valid."""
    marks = mentioned(answer)
    outside = F.exists(F.concat(marks, citations), lambda n: (n < 1) | (n > count))
    same = F.array_sort(F.array_distinct(citations)) == F.array_sort(marks)
    return (
        F.when(F.size(marks) == 0, "NO_MARKERS")
        .when(outside, "OUT_OF_RANGE")
        .when(~same, "MISMATCH")
        .when(~all_claims_cited(lines), "UNCITED_SENTENCE")
    )


def normalized(answer: Column) -> Column:
    """Grouped markers split, and markers moved before the closing punctuation."""
    split = F.regexp_replace(
        answer, r"(?i)(?<=\[SOURCE[^\[\]]{0,200})\s*,\s*(?:SOURCE\s+)?(?=\d[^\[\]]*\])", "] [SOURCE "
    )
    return F.regexp_replace(split, r"([.!?])\s*((?:\[SOURCE \d+\]\s*)*\[SOURCE \d+\])\s*", " $2$1")


def without_markers(answer: Column) -> Column:
    """The visible answer: markers removed and punctuation tidied."""
    steps = (
        (r"(?i)\s*\[SOURCE\s+\d+\]", ""),
        (r"[ \t]+([.,;:!?])", "$1"),
        (r"[,;:]+(?=[.!?])", ""),
        (r",{2,}", ","),
        (r"([.!?])(?:\s*\1)+", "$1"),
        (r"[ \t]{2,}", " "),
        (r"^\s+|\s+$", ""),
    )
    out = answer
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def uncited_keys(lines: Column) -> Column:
    """Keys of the material claims that carry no marker."""
    from evidquarry.functions.markdown import claim_key

    bare = F.filter(material_claims(lines), lambda c: ~c["text"].rlike(MARKER))
    return F.array_distinct(F.transform(bare, lambda c: claim_key(c["text"])))
