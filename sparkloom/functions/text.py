"""String functions with the semantics of Java's split and trim, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII word characters, without empty tokens."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")


def java_split(text: Column, pattern: str) -> Column:
    """Java's ``split``: trailing empty parts go; an empty text is one empty part, one of separators alone none."""
    parts = F.split(text, pattern)
    last = F.aggregate(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.slice(parts, F.lit(1), last))


def whitespace_tokens(text: Column) -> Column:
    """Parts between single white space characters; inner and leading empty parts stay, case is kept."""
    return java_split(text, r"\s")


def routed_token(token: Column, longest: int = 5) -> Column:
    """``rejectWordCount`` for long tokens, the token itself, or ``error`` for an empty one."""
    return F.when(F.length(token) > longest, "rejectWordCount").when(F.length(token) > 0, token).otherwise("error")


def java_trim(text: Column) -> Column:
    """Without characters up to U+0020 at both ends (a no-break space is not one)."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(java_trim(text)) == 0)


def contains_all(text: Column, keywords: list[str]) -> Column:
    """All keywords occur, case-sensitive and as given (pad with spaces for whole words)."""
    out = F.lit(True)
    for k in keywords:
        out = out & text.contains(k)
    return out


def year_of(date: Column) -> Column:
    """Year of ``yyyy-...`` text, padded or not."""
    return F.substring(date, 1, 4).cast("int")


def in_year(date: Column, year: int) -> Column:
    """Of dates and timestamps: a range, which reaches the scan."""
    return (date >= F.lit(f"{year:04}-01-01").cast("date")) & (date < F.lit(f"{year + 1:04}-01-01").cast("date"))


def parse_pair(line: Column) -> tuple[Column, Column]:
    """Both numbers of ``(a,b)``."""
    parts = F.split(F.substring(line, F.lit(2), F.length(line) - 2), ",")
    return parts[0].cast("int"), parts[1].cast("int")


def whole_percent(part: Column, whole: Column) -> Column:
    """(part / whole) * 100, truncated, in that order of operations."""
    return (part / whole * 100).cast("int")
