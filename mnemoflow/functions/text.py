"""Text functions whose results equal Python's on the same strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space, its line boundaries and its word characters, as Java patterns.
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WORDS = r"[\p{L}\p{N}_]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """str.strip()."""
    return F.regexp_replace(_col(c), STRIP, "")


def lines(c: Column | str) -> Column:
    """str.splitlines(): no empty element after the last line's end."""
    parts = F.split(_col(c), LINES, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def filled_lines(c: Column | str) -> Column:
    """The stripped lines that are not empty."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def words(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORDS), F.lit(0))


def raw_words(c: Column | str) -> Column:
    """The same without lower-casing."""
    return F.regexp_extract_all(_col(c), F.lit(WORDS), F.lit(0))


def quarter_tokens(c: Column | str) -> Column:
    """Estimated tokens: a quarter of the characters, rounded down; null has none."""
    return F.coalesce(F.floor(F.length(_col(c)) / 4), F.lit(0)).cast("long")


def tagged(c: Column | str, tag: str) -> Column:
    """The stripped, non-empty contents of <tag>...</tag>, in order."""
    found = F.regexp_extract_all(_col(c), F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def propositions(c: Column | str) -> Column:
    """Contents of <proposition> tags, lower-cased, without full stops at the end."""
    return F.transform(tagged(c, "proposition"), lambda x: F.regexp_replace(F.lower(x), r"\.+$", ""))


def one_line(c: Column | str, width: int | None = None) -> Column:
    """White space collapsed to single spaces, stripped, and cut."""
    out = strip(F.regexp_replace(_col(c), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.left(out, F.lit(width)) if width is not None else out


def has_any(c: Column | str, keywords: list[str]) -> Column:
    """Whether any keyword is part of the text, whatever the case."""
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(_col(c)), k))


def key_value(c: Column | str) -> tuple[Column, Column]:
    """What stands before and after the first ': ', stripped; both null without one."""
    c = _col(c)
    at = F.instr(c, ": ")
    return F.when(at > 0, strip(F.substring_index(c, ": ", 1))), F.when(at > 0, strip(F.substring(c, at + 2, F.length(c))))


def capitalized(c: Column | str) -> Column:
    """str.capitalize() of a single word."""
    return F.initcap(_col(c))


def or_none(c: Column | str) -> Column:
    """Null as Python formats it."""
    return F.coalesce(_col(c), F.lit("None"))
