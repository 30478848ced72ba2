"""Keyword counts and top-n lists.

``mentions`` counts occurrences, not reviews, so a share of all reviews can pass
100 %.  Equal counts are ordered by first occurrence: review order (reviews without an ``Id``
last), then position.  Words that first occur at one place of reviews with one ``Id``, or without
any, are ordered by the word itself, so a list never depends on how the rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.functions import text
from opinara.functions.numbers import percent, round_exact
from opinara.sources.tables import small_table

STOP_WORDS = frozenset(v.ENGLISH_STOP_WORDS) | frozenset(v.DOMAIN_STOP_WORDS)
STOP_WORD_LIMIT = 10_000  # longer lists are anti-joined instead

_REVIEW = " "  # stands for a review itself; never a word
_POSITIONS = 2**31  # positions per review; the order key is Id * 2^31 + position
_NO_ID = Decimal(2**63)  # stands for a missing Id, behind all others


def stop_word_table(spark: SparkSession, extra: Iterable[str] = ()) -> DataFrame:
    """The English list united with the domain list (and ``extra``) as a table."""
    english = word_table(spark, v.ENGLISH_STOP_WORDS)
    return english.union(word_table(spark, (*v.DOMAIN_STOP_WORDS, *extra))).distinct()


def word_table(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return small_table(spark, [(w,) for w in words], pa.schema([("word", pa.string())]))


def _token_rows(scored: DataFrame, words: Column, *keep: str) -> DataFrame:
    """``word, first`` per token; ``first`` orders tokens over all reviews.

    The order key is one decimal rather than a pair, because its minimum then fits the
    hash aggregate; a struct would force a sort of every token.
    """
    review = F.coalesce(F.col("Id").cast("decimal(20,0)"), F.lit(_NO_ID).cast("decimal(20,0)"))
    base = review * F.lit(_POSITIONS).cast("decimal(10,0)")
    rows = scored.select(
        *keep,
        base.cast("decimal(38,0)").alias("base"),
        F.posexplode(words).alias("pos", "word"),
    )
    first = (F.col("base") + F.col("pos")).cast("decimal(38,0)")
    return rows.select(*keep, "word", first.alias("first"))


def _plain(reviews: DataFrame) -> Column:
    if "PlainText" in reviews.columns:
        return F.col("PlainText")
    return text.plain_text(F.col("Text"))


def _without_stop_words(
    words: DataFrame, stop_words: Iterable[str] | DataFrame, keep: Column | None = None
) -> DataFrame:
    """Words of four letters or more that are not on the list, and rows to ``keep``."""
    long_enough = F.length("word") >= v.MIN_KEYWORD_LENGTH
    if not isinstance(stop_words, DataFrame):
        listed = sorted(stop_words)
        if len(listed) <= STOP_WORD_LIMIT:
            wanted = long_enough & ~F.col("word").isin(listed) if listed else long_enough
            return words.where(wanted if keep is None else wanted | keep)
        stop_words = word_table(words.sparkSession, listed)
    words = words.where(long_enough if keep is None else long_enough | keep)
    return words.join(stop_words.select("word"), "word", "left_anti")


def _count(words: DataFrame, *keys: str) -> DataFrame:
    return words.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mentions"), F.min("first").alias("first")
    )


def keyword_counts(
    scored: DataFrame,
    stop_words: Iterable[str] | DataFrame = STOP_WORDS,
    by_class: bool = True,
) -> DataFrame:
    """``word, mentions, first`` per class (or over all reviews).

    Tokens are counted in each task before the shuffle, which then carries about one
    row per distinct word and task; a word that makes up a third of all tokens costs no
    more than any other.  A stop list given as a table is anti-joined; Spark broadcasts it when
    it finds it small.
    """
    keep = ("Sentiment",) if by_class else ()
    words = _token_rows(scored, text.words(_plain(scored)), *keep)
    return _count(_without_stop_words(words, stop_words), *keep, "word")


REVIEWS, WORDS = "reviews", "words"


def review_counts(
    scored: DataFrame, stop_words: Iterable[str] | DataFrame = STOP_WORDS
) -> DataFrame:
    """Words per class and reviews per month, star and class, from one pass over the texts.

    Each review adds its words and one marker, which alone carries month and star.  One
    aggregate counts both, in each task first; ``kind`` tells them apart.
    """
    keys = [c for c in ("YearMonth", "Score") if c in scored.columns]
    words = F.concat(F.array(F.lit(_REVIEW)), text.words(_plain(scored)))
    marker = F.col("word") == _REVIEW
    rows = _without_stop_words(_token_rows(scored, words, "Sentiment", *keys), stop_words, keep=marker)
    rows = rows.select(
        "Sentiment", "word", "first", *[F.when(marker, F.col(c)).alias(c) for c in keys])
    kind = F.when(marker, REVIEWS).otherwise(WORDS).alias("kind")
    return _count(rows, "Sentiment", "word", *keys).select("*", kind)


def cube_and_words(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The class cube (``n`` reviews) and the keyword counts within :func:`review_counts`."""
    keys = [c for c in ("YearMonth", "Score") if c in counts.columns]
    cube = counts.where(F.col("kind") == REVIEWS).select(*keys, "Sentiment", F.col("mentions").alias("n"))
    words = counts.where(F.col("kind") == WORDS).select("Sentiment", "word", "mentions", "first")
    return cube, words


def top_keywords(
    reviews: DataFrame,
    sentiment: str | None = None,
    n: int = v.KEYWORDS_PER_LIST,
    stop_words: Iterable[str] | DataFrame = STOP_WORDS,
) -> DataFrame:
    """``rank, word, mentions, total`` of one class in a single pass over the texts.

    ``total`` counts all reviews: each adds one marker row, which sorts first.  The
    class picks the words inside the expression that splits them; as a filter it would be
    pushed down to the scan and the texts scored more than once.
    """
    words = text.words(_plain(reviews))
    if sentiment is not None:
        none = F.array().cast("array<string>")
        words = F.when(F.col("Sentiment") == sentiment, words).otherwise(none)
    marker = F.col("word") == _REVIEW
    rows = _token_rows(reviews, F.concat(F.array(F.lit(_REVIEW)), words))
    counts = _count(_without_stop_words(rows, stop_words, keep=marker), "word")
    order = (F.desc(marker), F.desc("mentions"), F.col("first"), F.col("word"))
    best = counts.orderBy(*order).limit(n + 1)
    everything = Window.orderBy(*order)  # n + 1 rows
    total = F.first("mentions").over(everything)
    return best.select(
        (F.row_number().over(everything) - 1).alias("rank"), "word", "mentions",
        total.alias("total"),
    ).where(~marker)


def over_all_classes(counts: DataFrame) -> DataFrame:
    """Counts per word from counts per class and word."""
    return counts.groupBy("word").agg(
        F.sum("mentions").alias("mentions"), F.min("first").alias("first")
    )


def top_words(
    counts: DataFrame, n: int = v.KEYWORDS_PER_LIST, sentiment: str | None = None
) -> DataFrame:
    """``rank, word, mentions`` of the ``n`` most frequent words.

    With counts per class, ``sentiment`` picks one.  It does so in the sort key, so that
    lists of several classes share one aggregate.
    """
    key = F.col("mentions")
    if sentiment is not None:
        key = F.when(F.col("Sentiment") == sentiment, key)
    order = (F.desc_nulls_last("key"), F.asc("first"), F.asc("word"))
    best = counts.select("word", key.alias("key"), "first").orderBy(*order).limit(n)
    return best.where(F.col("key").isNotNull()).select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),  # n rows
        "word", F.col("key").alias("mentions"),
    )


def top_words_by_class(
    counts: DataFrame, n: int = v.KEYWORDS_PER_LIST, classes: Iterable[str] = v.CLASSES
) -> DataFrame:
    """``Sentiment, rank, word, mentions``: :func:`top_words` of each class."""
    return reduce(DataFrame.unionByName, [
        top_words(counts, n, c).select(F.lit(c).alias("Sentiment"), "*") for c in classes
    ])


def top_lists(counts: DataFrame, overall: str, n: int = v.KEYWORDS_PER_LIST) -> DataFrame:
    """``Sentiment, rank, word, mentions``: the first words of each class and of all reviews.

    The counts are read once: a word's counts in all classes meet in one row, which goes to each
    list that it stands in.  Tasks keep ``n`` rows per list before the lists meet.
    """
    per_class = [F.struct(
        F.lit(c).alias("Sentiment"),
        F.sum(F.when(F.col("Sentiment") == c, F.col("mentions"))).alias("mentions"),
        F.min(F.when(F.col("Sentiment") == c, F.col("first"))).alias("first")) for c in v.CLASSES]
    everything = F.struct(F.lit(overall).alias("Sentiment"), F.sum("mentions").alias("mentions"),
                          F.min("first").alias("first"))
    rows = counts.groupBy("word").agg(F.array(*per_class, everything).alias("lists")).select(
        "word", F.inline("lists")).where(F.col("mentions").isNotNull())
    order = Window.partitionBy("Sentiment").orderBy(F.desc("mentions"), "first", "word")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        "Sentiment", "rank", "word", "mentions")


def word_lists(tops: DataFrame, n: int) -> DataFrame:
    """Per class, the first ``n`` words as one comma-separated string."""
    return tops.where(F.col("rank") <= n).groupBy("Sentiment").agg(
        text.joined_lines(F.col("rank"), F.col("word"), ", ").alias("words")
    )


def with_share(top: DataFrame, total: Column) -> DataFrame:
    """Add ``pct`` of all reviews."""
    return top.withColumn("pct", percent(F.col("mentions"), total))


def impact_bars(complaints: DataFrame, total: Column, n: int = v.IMPACT_BARS) -> DataFrame:
    """The first ``n`` complaint words with their share, rounded to one place."""
    share = round_exact(percent(F.col("mentions"), total), 1)
    return complaints.where(F.col("rank") <= n).withColumn("pct", share)
