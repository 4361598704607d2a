"""HTML to text lines: block tags break lines, other tags vanish."""

from __future__ import annotations

import html as references

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Tags that start a new line.
BLOCKS = "br|div|h1|h2|h3|h4|h5|h6|li|p|pre|td|th|tr"


@pandas_udf(ArrayType(StringType()))
def _decoded(segments: pd.Series) -> pd.Series:
    """Named and numeric character references of every segment."""
    return segments.map(lambda own: None if own is None else [references.unescape(s) for s in own])


def _markup(segment: Column) -> Column:
    text = F.regexp_replace(segment, r"(?s)<!--.*?-->|<![^>]*>", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n")
    return F.regexp_replace(text, r"</?[A-Za-z][^>]*>", "")


def text_lines(html: Column) -> Column:
    """Non-empty lines with collapsed blanks.

    Script and style bodies are character data: their text is kept as it stands, and
    tags inside them are not markup.
    """
    segments = F.split(html, r"(?i)(?=<(?:script|style)\b)|(?<=</(?:script|style)>)")

    def raw(segment: Column) -> Column:
        return segment.rlike(r"(?i)^<(?:script|style)\b")

    marked = F.transform(segments, lambda s: F.when(raw(s), "").otherwise(_markup(s)))
    decoded = F.when(html.contains("&"), _decoded(marked)).otherwise(marked)  # only pages with a reference leave the JVM
    plain = F.zip_with(
        segments, decoded, lambda s, m: F.when(raw(s), F.regexp_replace(s, r"(?is)^<[^>]*>|</(?:script|style)>$", "")).otherwise(m))
    lines = F.split(F.array_join(plain, ""), r"\r\n|\r|\n")
    cleaned = F.transform(lines, lambda l: F.trim(F.regexp_replace(l, r"(?U)\s+", " ")))
    return F.filter(cleaned, lambda l: l != "")
