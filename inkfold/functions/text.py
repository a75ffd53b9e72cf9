"""Text expressions: all are JVM-side columns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Word characters of every script, for both regex engines that matter here.
WORD = r"[\p{L}\p{N}_]"


def cleaned(text: Column) -> Column:
    """Control characters become spaces, runs of whitespace one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), r" +", " "))


def pattern_counts(text: Column, patterns: list[str]) -> Column:
    """Matches of every pattern, non-overlapping within one and overlapping across them."""
    return reduce(lambda a, b: a + b, (F.regexp_count(text, F.lit(f"(?iu){p}")) for p in patterns)).cast("bigint")


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    """The matches themselves, pattern by pattern."""
    return F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?iu){p}"), F.lit(0)) for p in patterns)))


def ngram_text(text: Column) -> Column:
    """Lower case; what is neither a word character nor an apostrophe becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_']+", " "))


def masked_counts(text: Column, aliases: list[str], own: Column | None = None) -> tuple[list[Column], Column]:
    """Counts of each alias, longest first, each masked before the next is counted.

    Aliases in the array column ``own`` are masked and count as zero.
    """
    counts: dict[str, Column] = {}
    for alias in sorted(aliases, key=len, reverse=True):
        rest = F.replace(text, F.lit(alias), F.lit("#" * len(alias)))
        n = ((F.length(text) - F.length(F.replace(text, F.lit(alias), F.lit("")))) / len(alias)).cast("bigint")
        counts[alias] = n if own is None else F.when(F.array_contains(own, alias), F.lit(0).cast("bigint")).otherwise(n)
        text = rest
    return [counts[a].alias(a) for a in aliases], text


def snippet(text: Column, needle: Column, around: int = 90) -> Column:
    """``around`` characters on both sides of the first occurrence, whitespace collapsed."""
    at = F.position(needle, text)
    start = F.greatest(at - around, F.lit(1))
    return F.trim(F.regexp_replace(F.substring(text, start, at - start + F.length(needle) + around), r"\s+", " "))


def boilerplate(text: Column) -> Column:
    """Whether a paragraph is no prose: empty, a widget's word, a reading time, a date, or short and without a stop."""
    t = F.trim(text)
    low = F.lower(t)
    widget = low.isin("share", "copied", "tags", "written by", "subscribe", "sign up", "listen") | low.startswith("listen")
    number = low.rlike(r"^\d+\s*minutes?( read)?$") | low.rlike(r"^[a-z]+\.?\s+\d{1,2},?\s+\d{4}$")
    return (t == "") | widget | number | ((F.length(t) < 100) & ~t.rlike("[.!?]") & ~t.rlike(r"^[-‐-―]\s*\S"))


def slug(text: Column, most: int = 40) -> Column:
    """Runs of what is not a-z or 0-9 become one underscore; ends trimmed."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", ""), 1, most)


def json_in_answer(text: Column) -> Column:
    """The outermost braces of an answer, inside or outside a code fence."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


@F.pandas_udf(StringType())
def ascii_folded(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII; JVM functions have no such form."""
    return s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
