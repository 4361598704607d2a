"""Tokenizers, folding and small string functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The token alphabet and the identifier part boundaries.
TOKEN_PATTERN = "[A-Za-z0-9][A-Za-z0-9_./:#-]*"
PART_BOUNDARY = "[_./:#-]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
HAS_BOUNDARY = "[_./:#-][A-Za-z0-9]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"



def _latin_letters() -> tuple[str, str]:
    """Latin letters that decompose into one base letter and marks, and these base letters.

    Combining marks follow without a counterpart, so translating drops them.
    """
    marked, bases = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code):
            marked.append(chr(code))
            bases.append(parts[0])
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(bases)


ACCENTED, UNACCENTED = _latin_letters()


def _lit(value: str) -> Column:
    return F.lit(value)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* of a value that is computed once for the row, however often the body names it.

    An expression used inside a lambda, or several times, is otherwise copied into the plan and
    evaluated anew for every element and every mention.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def subtokens(token: Column) -> Column:
    """Lower-cased identifier parts of a token; empty when it is one plain word."""
    parts = F.transform(
        F.filter(
            F.split(token, PART_BOUNDARY),
            lambda part: (F.length(part) >= 2) & ~part.rlike("^[0-9]+$"),
        ),
        F.lower,
    )
    return F.when(
        token.rlike(HAS_BOUNDARY), F.when(F.size(parts) >= 2, parts)
    ).otherwise(F.array().cast("array<string>"))


def raw_tokens(value: Column) -> Column:
    """Tokens and identifier parts in their original case (lower them once exploded)."""
    found = F.regexp_extract_all(value, _lit(TOKEN_PATTERN), 0)
    expanded = F.flatten(
        F.transform(
            found,
            lambda token: F.concat(
                F.array(token), F.coalesce(subtokens(token), F.array().cast("array<string>"))
            ),
        )
    )
    # Prose without any compound token takes the cheap branch.
    return F.when(value.rlike(HAS_BOUNDARY), expanded).otherwise(found)


def token_bag(value: Column) -> Column:
    """The same tokens in any order: only compound tokens are looked at twice."""
    found = F.regexp_extract_all(value, _lit(TOKEN_PATTERN), 0)
    compound = F.filter(found, lambda token: token.rlike(HAS_BOUNDARY))
    parts = F.transform(compound, lambda token: F.coalesce(subtokens(token), F.array().cast("array<string>")))
    return F.when(value.rlike(HAS_BOUNDARY), F.concat(found, F.flatten(parts))).otherwise(found)


def token_count(value: Column) -> Column:
    """Number of tokens, without building them for text that has no compound token."""
    return F.when(value.rlike(HAS_BOUNDARY), F.size(token_bag(value))).otherwise(
        F.regexp_count(value, _lit(TOKEN_PATTERN))
    )


def tokens(value: Column) -> Column:
    """Whole tokens plus identifier parts, lower-cased, in order, with repeats."""
    return F.transform(raw_tokens(value), F.lower)


def fold_accents(value: Column) -> Column:
    """Case-fold and strip diacritics from Latin letters, composed or not."""
    folded = F.lower(F.translate(value, ACCENTED, UNACCENTED))
    return F.replace(folded, F.lit("ß"), F.lit("ss"))


def normalized_words(value: Column) -> Column:
    return F.regexp_extract_all(fold_accents(value), _lit("[a-z0-9]+"), 0)


def collapse_spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def casefold(value: Column) -> Column:
    """Python-style case folding for Latin text (sharp s expands)."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_present(*values: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[blank_to_null(value) for value in values])


def parse_values(value: Column) -> Column:
    """A JSON list or a comma string as a trimmed array without empty items."""
    text = F.trim(value)
    items = F.when(
        text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.split(text, ","))
    ).otherwise(F.split(text, ","))
    return F.filter(F.transform(items, lambda item: F.trim(item)), lambda item: item != "")


def list_field(value: Column) -> Column:
    """JSON list -> its items; any other non-empty string -> a single item."""
    return (
        F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>"))
        .when(value.startswith("["), F.coalesce(F.from_json(value, "array<string>"), F.array(value)))
        .otherwise(F.array(value))
    )


def normalized_values(items: Column, upper: bool = False) -> Column:
    change = F.upper if upper else casefold
    cleaned = F.transform(items, lambda item: change(F.trim(item)))
    return F.array_distinct(F.filter(cleaned, lambda item: item != ""))


def extensions(items: Column) -> Column:
    return F.array_distinct(
        F.transform(
            normalized_values(items),
            lambda item: F.when(item.startswith("."), item).otherwise(F.concat(F.lit("."), item)),
        )
    )


def member_identifiers(value: Column) -> Column:
    """Ordered distinct SCREAMING_SNAKE identifiers that contain an underscore."""
    found = F.regexp_extract_all(value, _lit(r"\b[A-Z][A-Z0-9_]{2,}\b"), 0)
    return F.array_distinct(F.filter(found, lambda item: item.contains("_")))


# The protected-token patterns, applied in this order.
IDENTIFIER_PATTERNS = (
    r"[A-Z][A-Z0-9]+-\d+",
    r"\b[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+\b",
    r"\b[A-Za-z][A-Za-z0-9_-]*::[A-Za-z0-9_:.-]+\b",
    r"\b[A-Z][A-Z0-9_.-]*\d[A-Z0-9_.-]*\b",
    r"['\"][^'\"]+['\"]",
)
LABEL_PATTERN = r"(?i)(?<![A-Za-z0-9])(?:\d+[a-z]{1,4}|v\d+(?:\.\d+)+)(?![A-Za-z0-9])"
QUOTED_PATTERN = r"`([^`]{2,80})`|[\"']([^\"']{2,80})[\"']"
TECHNICAL_PATTERN = r"\b[A-Za-z][A-Za-z0-9_.:/-]*\d[A-Za-z0-9_.:/-]*\b"
IGNORED_IDENTIFIERS = ("CODE", "API", "HTTP", "JSON", "SQL")


def protected_tokens(value: Column) -> Column:
    return F.array_distinct(
        F.concat(*[F.regexp_extract_all(value, _lit(p), 0) for p in IDENTIFIER_PATTERNS])
    )


def _quoted(value: Column) -> Column:
    whole = F.regexp_extract_all(value, _lit(QUOTED_PATTERN), 0)
    return F.transform(whole, lambda item: F.trim(F.substring(item, F.lit(2), F.length(item) - 2)))


def forced_anchor_tokens(value: Column) -> Column:
    labels = F.regexp_extract_all(value, _lit(LABEL_PATTERN), 0)
    return F.array_distinct(F.concat(labels, _quoted(value)))


def exact_identifier_tokens(value: Column, entities: tuple[str, ...] = ()) -> Column:
    ignored = [*IGNORED_IDENTIFIERS, *[entity.upper() for entity in entities]]
    members = F.filter(member_identifiers(value), lambda item: ~item.isin(ignored))
    return F.array_distinct(F.concat(members, forced_anchor_tokens(value)))


def exact_terms(value: Column) -> Column:
    """Lower-cased exact terms of a question and the parts of compound ones."""
    stripped = F.transform(
        protected_tokens(value), lambda item: F.regexp_replace(item, "^['\"]+|['\"]+$", "")
    )
    technical = F.regexp_extract_all(value, _lit(TECHNICAL_PATTERN), 0)
    exact = F.array_distinct(
        F.transform(
            F.filter(
                F.concat(stripped, technical, member_identifiers(value)),
                lambda item: F.length(item) >= 2,
            ),
            F.lower,
        )
    )
    parts = F.flatten(
        F.transform(exact, lambda item: F.coalesce(subtokens(item), F.array().cast("array<string>")))
    )
    return F.array_distinct(F.concat(exact, parts))


def exact_term_ratio(terms: Column, content: Column) -> Column:
    lowered = F.lower(content)
    hits = F.size(F.filter(terms, lambda term: lowered.contains(term)))
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(hits / F.size(terms))


def estimated_tokens(value: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(value) / F.lit(3))).cast("bigint")


def sanitize_evidence(value: Column) -> Column:
    """Drop control characters other than newline and tab; at most 16000 characters."""
    cleaned = F.regexp_replace(value, r"[\x00-\x08\x0B-\x1F]", "")
    return F.substring(cleaned, 1, 16000)


def looks_repeated(value: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of *needle* in *value*."""
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise(
        (F.length(value) - F.length(F.replace(value, needle, F.lit(""))))
        / F.length(needle)
    )


def slug(value: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9_-]+", "-"), "^[-_]+|[-_]+$", ""
    )


def collection_name(base: Column, project: Column) -> Column:
    """Deterministic per-project table name."""
    return F.concat_ws(
        "-",
        F.substring(slug(base), 1, 48),
        F.substring(slug(project), 1, 32),
        F.substring(F.sha2(project, 256), 1, 12),
    )
