"""Text expressions: Markdown to plain text, word counts, redaction, language hints, titles and anchors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markdown's marks and what stays of them; the order is part of the result.
MARKDOWN = (
    (r"(?s)```.*?```", ""), (r"`[^`]+`", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?md)^#{1,6}\s+", ""),
    (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"(?md)^[-*_]{3,}$", ""),
    (r"(?md)^\s*[-*+]\s+", ""), (r"(?md)^\s*\d+\.\s+", ""), (r"\n{3,}", "\n\n"), (r" {2,}", " "),
)
ENGLISH = ("the", "and", "is", "are", "was", "were", "have", "has")
REDACTIONS = (
    ("[EMAIL REDACTED]", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"), ("[PHONE REDACTED]", r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("[SSN REDACTED]", r"(?U)\b\d{3}-\d{2}-\d{4}\b"), ("[CARD REDACTED]", r"(?U)\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
)


def plain(markdown: Column) -> Column:
    for pattern, to in MARKDOWN:
        markdown = F.regexp_replace(markdown, pattern, to)
    return stripped(markdown)


def stripped(text: Column) -> Column:
    """Without white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def language_hint(text: Column) -> Column:
    """'en' if one of eight words stands anywhere in the first 1000 characters, even inside others; else null."""
    return F.when(F.lower(F.substring(text, 1, 1000)).rlike("|".join(ENGLISH)), F.lit("en"))


def redact(text: Column, custom: Iterable[tuple[str, str]] = ()) -> Column:
    """Custom patterns (replacement, pattern) first, then e-mail, phone, social security and card numbers."""
    for to, pattern in (*custom, *REDACTIONS):
        text = F.regexp_replace(text, pattern, to.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def title_case(text: Column) -> Column:
    """Each run of letters begins in upper case and goes on in lower case, whatever stands between runs."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def slug(text: Column) -> Column:
    """An anchor: lower case, words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s-]", ""), r"[\s_-]+", "-")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")
