"""Numeric, date and identifier anchors of a claim, and negation words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month names in English and Spanish.
MONTHS = {
    "january": 1, "enero": 1, "february": 2, "febrero": 2, "march": 3, "marzo": 3,
    "april": 4, "abril": 4, "may": 5, "mayo": 5, "june": 6, "junio": 6,
    "july": 7, "julio": 7, "august": 8, "agosto": 8, "september": 9, "septiembre": 9,
    "setiembre": 9, "october": 10, "octubre": 10, "november": 11, "noviembre": 11,
    "december": 12, "diciembre": 12,
}
_NAMES = "|".join(MONTHS)
ISO_DATE = r"\b(\d{4})-(\d{2})-(\d{2})(?:T(?=\d{2}:)|\b)"
DAY_FIRST = rf"(?i)\b(\d{{1,2}})\s+(?:de\s+)?({_NAMES})\s+(?:de\s+)?(\d{{4}})\b"
MONTH_FIRST = rf"(?i)\b({_NAMES})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
NUMBER = r"(?U)(?<![\w])\d+(?:[.,]\d+)*(?![\w])"
# Words that negate a statement, in both languages.
NEGATION = (
    r"(?i)(?U)\b(?:no|not|never|none|without|zero|0|ni|nunca|jam[aá]s|ning[uú]n|ninguno|ninguna|"
    r"ningunos|ningunas|sin|tampoco|cero)\b"
)


def canonical_number(value: Column) -> Column:
    """Thousands groups lose their separators; other commas become points."""
    return F.when(value.rlike(r"^\d{1,3}(?:[.,]\d{3})+$"), F.regexp_replace(value, "[.,]", "")).otherwise(
        F.replace(value, F.lit(","), F.lit("."))
    )


def _dated(text: Column, pattern: str, year: int, month: int, day: int, named: bool) -> Column:
    """array<struct<match, date>> of the valid dates a pattern finds."""
    months = F.create_map(*[F.lit(v) for pair in MONTHS.items() for v in pair])

    def part(match: Column, group: int) -> Column:
        return F.regexp_extract(match, pattern.replace(r"(?:T(?=\d{2}:)|\b)", ""), group)

    def entry(match: Column) -> Column:
        m = months[F.lower(part(match, month))] if named else part(match, month).cast("int")
        iso = F.concat_ws("-", part(match, year), F.lpad(m.cast("string"), 2, "0"), F.lpad(part(match, day), 2, "0"))
        return F.struct(match.alias("match"), iso.try_cast("date").cast("string").alias("date"))

    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.filter(F.transform(found, entry), lambda e: e["date"].isNotNull())


def _remove(text: Column, entries: Column) -> Column:
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["match"], F.lit(" ")))


def numeric_anchors(text: Column) -> Column:
    """Whole dates (and their years) plus canonical numbers of the rest."""
    iso = _dated(text, ISO_DATE, 1, 2, 3, False)
    rest = _remove(text, iso)
    day_first = _dated(rest, DAY_FIRST, 3, 2, 1, True)
    rest = _remove(rest, day_first)
    month_first = _dated(rest, MONTH_FIRST, 3, 1, 2, True)
    rest = _remove(rest, month_first)
    dates = F.transform(F.concat(iso, day_first, month_first), lambda e: e["date"])
    years = F.transform(dates, lambda d: F.substring(d, 1, 4).cast("int").cast("string"))
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(NUMBER), 0), canonical_number)
    return F.array_distinct(
        F.concat(F.transform(dates, lambda d: F.concat(F.lit("date:"), d)), years, numbers)
    )


def anchors_supported(claim: Column, evidence: Column) -> Column:
    """Every number and date of the claim is in the evidence, and so is every
    back-quoted identifier, literally."""
    missing = F.array_except(numeric_anchors(claim), numeric_anchors(evidence))
    quoted = F.regexp_extract_all(claim, F.lit("`([^`]+)`"), 1)
    return (F.size(missing) == 0) & F.forall(quoted, lambda item: evidence.contains(item))


def negation_supported(claim: Column, evidence: Column) -> Column:
    return ~claim.rlike(NEGATION) | evidence.rlike(NEGATION)
