"""Markdown line structure: tables, fences, list items and material claims.

Telling a table row from prose needs the neighbouring lines and the fence state,
so one small per-text scan classifies lines in Arrow batches; everything built on
the classified lines is column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from evidquarry.functions.text import bound

# The shapes of Markdown lines and the limits of a readable table.
SEPARATOR = r"^\s*\|?[\s:|-]*-{2,}[\s:|-]*\|?\s*$"
HEADING = r"^#{1,6}\s"
LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s"
LIST_MARK = r"^\s*(?:[-*+]|\d+[.)])\s+"
FENCE = r"^\s*(`{3,}|~{3,})"
SENTENCE_GAP = r"(?<=[.!?])\s+"
EMPTY_CELLS = ("", "-", "--", "—", "n/a", "N/A")
MIN_CELLS, MAX_CELLS = 2, 12
MIN_CLAIM_WORDS = 4
LINE_TYPE = ArrayType(
    StructType([StructField(name, StringType()) for name in ("text", "kind", "header")])
)

_separator = re.compile(SEPARATOR)
_heading = re.compile(HEADING)
_item = re.compile(LIST_ITEM)
_fence = re.compile(FENCE)


def _is_pipe(line: str) -> bool:
    return "|" in line and not _separator.match(line.strip())


def _classify(text: str) -> list[tuple[str, str, str]]:
    lines = text.splitlines()
    rows: list[tuple[str, str, str]] = []
    fenced, table = False, None  # table: header text while inside a table body
    for i, line in enumerate(lines):
        mark = line.lstrip().startswith("```")
        if mark or fenced:
            fenced, table = fenced != mark, None
            rows.append((line, "CODE", ""))
            continue
        follows = lines[i + 1] if i + 1 < len(lines) else ""
        if table is not None and (_is_pipe(line) or rows[-1][1] == "TABLE_HEADER"):
            kind = "TABLE_SEPARATOR" if _separator.match(line) else "TABLE_ROW"
            rows.append((line, kind, table if kind == "TABLE_ROW" else ""))
            continue
        table = None
        if _is_pipe(line) and _separator.match(follows):
            table = line
            rows.append((line, "TABLE_HEADER", ""))
        elif _separator.match(line):
            rows.append((line, "TABLE_SEPARATOR", ""))
        elif _heading.match(line):
            rows.append((line, "HEADING", ""))
        elif _item.match(line):
            rows.append((line, "LIST_ITEM", ""))
        else:
            rows.append((line, "PROSE", ""))
    return rows


@pandas_udf(LINE_TYPE)
def _classified(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(
        lambda text: [{"text": a, "kind": b, "header": c} for a, b, c in _classify(text)]
    )


def classified_lines(text: Column) -> Column:
    """array<struct<text, kind, header>> with the seven line kinds."""
    return _classified(text)


def cells(row: Column) -> Column:
    """Trimmed cells of a pipe row without its outer pipes."""
    inner = F.regexp_replace(F.trim(row), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def _is_blank_cell(cell: Column) -> Column:
    return cell.isin(*EMPTY_CELLS)


def linearized_row(header: Column, row: Column) -> Column:
    """One table row as a sentence, each cell labelled with its column."""
    heads = F.transform(
        cells(header),
        lambda h, i: F.when(_is_blank_cell(h), F.concat(F.lit("column "), (i + 1).cast("string"))).otherwise(h),
    )
    values = cells(row)
    labelled = F.filter(
        F.zip_with(
            F.slice(values, 1, F.size(heads)), F.slice(heads, 1, F.size(values)),
            lambda v, h: F.when(~_is_blank_cell(v), F.concat(h, F.lit(": "), v)),
        ),
        lambda item: item.isNotNull(),
    )
    subject = F.element_at(values, 1)
    rest = F.array_join(F.slice(labelled, 2, F.greatest(F.size(labelled) - 1, F.lit(0))), "; ")
    return (
        F.when(F.size(labelled) == 0, F.lit(None).cast("string"))
        .when((F.size(labelled) > 1) & ~_is_blank_cell(subject), F.concat(subject, F.lit(" — "), rest, F.lit(".")))
        .otherwise(F.concat(F.array_join(labelled, "; "), F.lit(".")))
    )


def _table_spans(lines: list[str]):
    """Yield (start, end, rows) of every readable table; others as single lines."""
    i = 0
    while i < len(lines):
        j, rows = i, []
        while j < len(lines):
            stripped = lines[j].strip()
            if not (stripped.startswith("|") and stripped.count("|") >= 2):
                break
            if not _separator.match(lines[j]):
                body = stripped[1:-1] if stripped.endswith("|") and len(stripped) > 1 else stripped[1:]
                found = [c.strip() for c in body.split("|")]
                if not MIN_CELLS <= len(found) <= MAX_CELLS:
                    break
                rows.append(found)
            j += 1
        if len(rows) >= 2:
            yield i, j, rows
            i = j
        else:
            yield i, i + 1, None
            i += 1


def _sentences(rows: list[list[str]]) -> list[str]:
    heads = [h if h not in EMPTY_CELLS else f"column {n}" for n, h in enumerate(rows[0], 1)]
    out = []
    for row in rows[1:]:
        parts = [f"{h}: {v}" for h, v in zip(heads, row) if v not in EMPTY_CELLS]
        if parts:
            named = len(parts) > 1 and row[0] not in EMPTY_CELLS
            out.append((f"{row[0]} — " + "; ".join(parts[1:]) if named else "; ".join(parts)) + ".")
    return out


@pandas_udf(StringType())
def _linearize(texts: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        lines = text.splitlines()
        out: list[str] = []
        for start, end, rows in _table_spans(lines):
            out += lines[start:end] if rows is None else _sentences(rows)
        return "\n".join(out)

    return texts.fillna("").map(one)


def linearize_tables(text: Column) -> Column:
    """Every readable pipe table rewritten as one sentence per row."""
    return F.when(text.contains("|"), _linearize(text)).otherwise(F.regexp_replace(text, r"\n\z", ""))


@pandas_udf(BooleanType())
def _has_table(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(lambda t: any(rows for _s, _e, rows in _table_spans(t.splitlines())))


def contains_table(text: Column) -> Column:
    return F.when(text.contains("|"), _has_table(text)).otherwise(F.lit(False))


def _canonical_dialect(text: str) -> str:
    out: list[str] = []
    run: list[str] = []
    fence = None

    def flush() -> None:
        framed = run and run[0].strip().startswith("|") and len(run) > 1 and _separator.match(run[1])
        if len(run) < 2 or framed:
            out.extend(run)
        else:
            split = [[c.strip() for c in row.strip().strip("|").split("|")] for row in run]
            shown = ["| " + " | ".join(row) + " |" for row in split]
            width = shown[0].count("|") - 1
            out.extend([shown[0], "| " + " | ".join(["---"] * width) + " |", *shown[1:]])
        run.clear()

    for line in text.splitlines():
        mark = _fence.match(line)
        if fence is None and not mark and line.count("|") >= 2:
            run.append(line)
            continue
        flush()
        out.append(line)
        if mark:
            char = mark.group(1)[0]
            fence = char if fence is None else (None if char == fence else fence)
    flush()
    joined = "\n".join(out)
    return joined + ("\n" if text.endswith("\n") and joined else "")


@pandas_udf(StringType())
def _dialect(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(_canonical_dialect)


def normalize_table_dialect(text: Column) -> Column:
    """Separatorless pipe runs as Markdown tables; fenced content stays as it is."""
    return F.when(text.contains("|"), _dialect(text)).otherwise(text)


def sentences(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), SENTENCE_GAP), lambda s: s != "")


def material_claims(lines: Column) -> Column:
    """array<struct<text, kind, header>>: rows, items and sentences of four words or more."""

    def of(line: Column) -> Column:
        whole = F.array(F.struct(F.trim(line["text"]).alias("text"), line["kind"].alias("kind"), line["header"].alias("header")))
        prose = F.transform(
            F.filter(
                sentences(line["text"]),
                lambda s: F.regexp_count(s, F.lit(r"(?U)\w+")) >= MIN_CLAIM_WORDS,
            ),
            lambda s: F.struct(F.trim(s).alias("text"), line["kind"].alias("kind"), F.lit("").alias("header")),
        )
        nothing = F.array().cast("array<struct<text:string,kind:string,header:string>>")
        return (
            F.when(line["kind"].isin("TABLE_ROW", "LIST_ITEM"), whole)
            .when(line["kind"] == "PROSE", prose)
            .otherwise(nothing)
        )

    return F.flatten(F.transform(lines, of))


def claim_key(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def pruned(lines: Column, rejected: Column) -> Column:
    """The text without rejected claims; tables left without rows lose their header.

    *rejected* is an array of claim keys. It and the rewritten lines are bound: every line and
    its neighbours look at them.
    """
    return bound(rejected, lambda keys: bound(_rewritten(lines, keys), _without_bare_headers))


def _rewritten(lines: Column, rejected: Column) -> Column:
    kept = F.filter(
        lines,
        lambda l: ~(l["kind"].isin("TABLE_ROW", "LIST_ITEM") & F.array_contains(rejected, claim_key(l["text"]))),
    )

    def rewrite(l: Column) -> Column:
        parts = F.filter(sentences(l["text"]), lambda s: ~F.array_contains(rejected, claim_key(s)))
        return F.when(
            (l["kind"] == "PROSE") & (F.trim(l["text"]) != ""),
            F.array_join(F.transform(parts, lambda s: F.trim(s)), " "),
        ).otherwise(l["text"])

    return F.transform(kept, rewrite)


def _without_bare_headers(texts: Column) -> Column:
    def pipe(line: Column) -> Column:
        return F.coalesce(line.contains("|") & ~line.rlike(SEPARATOR), F.lit(False))

    def bare_header(i: Column) -> Column:
        return pipe(F.get(texts, i)) & F.coalesce(F.get(texts, i + 1).rlike(SEPARATOR), F.lit(False)) & ~pipe(F.get(texts, i + 2))

    cleaned = F.filter(
        texts, lambda _line, i: ~(bare_header(i) | ((i > 0) & bare_header(F.greatest(i - 1, F.lit(0)))))
    )
    return F.trim(F.regexp_replace(F.array_join(cleaned, "\n"), r"^\s+|\s+$", ""))


def member_label(line: Column) -> Column:
    """Leading single-token name of a registry row or list item, else empty."""
    text = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"^\s+|\s+$", "")
    first = F.regexp_replace(F.element_at(F.split(text, r"\|"), 1), LIST_MARK, "")
    name = F.regexp_replace(F.trim(first), r"^[`*_ ]+|[`*_ ]+$", "")
    name = F.regexp_replace(F.trim(F.element_at(F.split(name, ":"), 1)), "[,;]+$", "")
    bad = name.rlike(r"\s") | name.rlike(r"[.!?]$") | name.rlike(r"^\d+$")
    return F.when(bad, "").otherwise(name)


def row_text(line: Column) -> Column:
    """A registry row as one sentence that keeps every cell."""
    text = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"^\s+|\s+$", "")
    text = F.regexp_replace(text, LIST_MARK, "")
    shown = F.transform(
        F.split(text, r"\|"), lambda c: F.regexp_replace(F.trim(c), r"^[`*_ ]+|[`*_ ]+$", "")
    )
    return F.array_join(F.filter(shown, lambda c: c != ""), " — ")
