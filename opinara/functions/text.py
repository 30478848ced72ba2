"""Text expressions, all built-ins so that they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's notion of white space: the Unicode property plus the four
# information separators, which the property leaves out.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def plain_text(text: Column) -> Column:
    """Lower case with markup replaced by spaces.

    ``(?d)`` keeps ``.`` from stopping at ``\\r``; a tag may span ``\\r`` but not
    ``\\n``.  Most texts have no markup, so the tag pass only runs on those with a
    ``<``.
    """
    low = F.lower(text.cast("string"))
    return F.when(
        F.contains(low, F.lit("<")), F.regexp_replace(low, "(?d)<.*?>", " ")
    ).otherwise(low)


def clean_text(text: Column) -> Column:
    """Lower case, markup stripped, only a-z words with single spaces."""
    return clean_plain(plain_text(text))


def clean_plain(plain: Column) -> Column:
    """Cleaned text from a plain one: each run of other characters is one space."""
    return F.trim(F.regexp_replace(plain, "[^a-z]+", " "))


def words(plain: Column) -> Column:
    """The words of the cleaned text, split straight from the plain one.

    The first and the last element may be empty strings.
    """
    return F.split(plain, "[^a-z]+")


def word_count(text: Column) -> Column:
    """Number of white-space separated words of a raw text."""
    parts = F.split(text, _SPACE)
    empty_ends = (F.element_at(parts, 1) == "").cast("int") + (
        F.element_at(parts, -1) == ""
    ).cast("int")
    return F.greatest(F.size(parts) - empty_ends, F.lit(0))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(text, _OUTER_SPACE, "")


def star_glyphs(score: Column) -> Column:
    """1 to 5 star glyphs; any other score shows one."""
    return F.repeat(
        F.lit("⭐"), F.when(score.between(1, 5), score.cast("int")).otherwise(1)
    )


def joined_lines(rank: Column, line: Column, separator: str = "\n") -> Column:
    """Aggregate: the lines of a group in rank order as one string.

    Only for short ranked lists (top-k rows, months, years), never for reviews.
    """
    pairs = F.array_sort(F.collect_list(F.struct(rank.alias("r"), line.alias("l"))))
    return F.array_join(F.transform(pairs, lambda p: p["l"]), separator)
