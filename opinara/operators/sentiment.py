"""Polarity scoring and class labels.

``polarity = sum of lexicon polarities of matched tokens / matched tokens``, 0 when
nothing matches.  Polarities are numbers in [-1, 1] of up to six decimals and are summed as
whole millionths, so the result does not depend on the order of the rows.  A lexicon has one
value per word; a word listed with two values is an error, whichever way it is scored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import bands, text
from opinara.sources.sinks import stored
from opinara.sources.tables import small_table

UNIT = 1_000_000  # polarities are counted in millionths
LEXICON_BYTES = 2_000_000  # of words in a lexicon that is a constant in the plan; larger ones are joined

Lexicon = Mapping[str, "Decimal | float | str"] | DataFrame


def with_clean_text(reviews: DataFrame) -> DataFrame:
    """Add PlainText (lower case, no markup) and CleanText.

    Words come straight from PlainText, so a result that does not show CleanText does
    not pay for it.
    """
    plain = reviews.withColumn("PlainText", text.plain_text(F.col("Text")))
    return plain.withColumn("CleanText", text.clean_plain(F.col("PlainText")))


def score(reviews: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Add PlainText, CleanText, SentimentScore, Sentiment and ExpectedSentiment.

    The lexicon becomes a constant inside the scoring expression: no shuffle, no join.  One
    given as a table is fetched for that, after a check of its size.  A larger one is joined by
    :func:`score_by_join`, and its scores are joined to the reviews by a row number, with the
    same result; the reviews are stored for that, so that the numbers hold.
    """
    if isinstance(lexicon, DataFrame):
        if _bytes(lexicon) > LEXICON_BYTES:
            return _score_joined(reviews, lexicon)
        lexicon = _fetched(lexicon)
    elif sum(len(w.encode()) + 8 for w in lexicon) > LEXICON_BYTES:
        for value in lexicon.values():
            _millionths(value)
        schema = pa.schema([("word", pa.string()), ("polarity", pa.string())])
        rows = [(w, str(p)) for w, p in lexicon.items()]
        return _score_joined(reviews, small_table(reviews.sparkSession, rows, schema))
    cleaned = with_clean_text(reviews)
    words = text.words(F.col("PlainText"))
    return _labelled(cleaned.withColumn("SentimentScore", polarity(words, lexicon)))


def _bytes(lexicon: DataFrame) -> int:
    return lexicon.agg(F.sum(F.octet_length("word") + 8)).first()[0] or 0


def _fetched(lexicon: DataFrame) -> dict[str, Decimal]:
    """A lexicon table as a mapping; its size is known to be within the bound."""
    found: dict[str, Decimal] = {}
    for word, value in lexicon.select("word", F.col("polarity").cast("string")).collect():
        if found.setdefault(word, Decimal(value)) != Decimal(value):
            raise ValueError(f"two polarities for {word!r}")
    return found


def _score_joined(reviews: DataFrame, lexicon: DataFrame) -> DataFrame:
    rows = stored(reviews.withColumn("_review", F.monotonically_increasing_id()), "reviews")
    scores = score_by_join(rows, lexicon, ("_review",)).select("_review", "SentimentScore")
    return _labelled(with_clean_text(rows).join(scores, "_review").drop("_review"))


def score_with(reviews: DataFrame, scorer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """As :func:`score`, with the caller's own ``Series[str] -> Series[float]``."""

    @F.pandas_udf("double")
    def polarity_of(clean: pd.Series) -> pd.Series:
        return scorer(clean).astype("float64")

    cleaned = with_clean_text(reviews)
    return _labelled(cleaned.withColumn("SentimentScore", polarity_of("CleanText")))


def polarity(words: Column, lexicon: Mapping[str, Decimal | float | str]) -> Column:
    """Polarity of an array of words under a small lexicon.

    Words outside the lexicon are dropped by one set test each.  The rest look up their
    value in a small slot, addressed by a checksum of the word.  The slots are arrays and
    not maps: two map constants are never equal to Catalyst, which would keep branches of
    one query from sharing a scored table.
    """
    if not lexicon:
        return F.lit(0.0)
    slots = 1 << (2 * len(lexicon) - 1).bit_length()
    table: list[dict[str, list]] = [{"words": [], "values": []} for _ in range(slots)]
    for word, value in lexicon.items():
        slot = table[zlib.crc32(word.encode()) % slots]
        slot["words"].append(word)
        slot["values"].append(_millionths(value))
    lookup = F.from_json(
        F.lit(json.dumps(table)), "array<struct<words:array<string>,values:array<int>>>"
    )

    def millionths(word: Column) -> Column:
        slot = F.get(lookup, (F.crc32(word.cast("binary")) % slots).cast("int"))
        place = F.array_position(slot["words"], word).cast("int")
        return F.get(slot["values"], place - 1)

    matched = F.filter(words, lambda w: w.isin(list(lexicon)))
    return F.aggregate(
        matched,
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n")),
        lambda acc, w: F.struct(
            (acc["sum"] + millionths(w)).alias("sum"), (acc["n"] + 1).alias("n")
        ),
        lambda acc: F.when(acc["n"] > 0, acc["sum"] / F.lit(float(UNIT)) / acc["n"]).otherwise(0.0),
    )


def _millionths(value: Decimal | float | str) -> int:
    scaled = Decimal(str(value)) * UNIT
    if scaled != int(scaled) or abs(scaled) > UNIT:
        raise ValueError(f"polarity {value} is not a number of six decimals in [-1, 1]")
    return int(scaled)


MARKERS = 256  # words that stand for a review itself, so that none gets lost or is hot


def score_by_join(reviews: DataFrame, lexicon: DataFrame, keep: Sequence[str] = ("Id",)) -> DataFrame:
    """The columns in ``keep``, SentimentScore and the labels, for a lexicon of any size.

    One pass over the texts: each review becomes its words and one marker word, and what is
    shuffled is words with a row number and ``keep``, never a text.  The row number is made
    here, so repeated or null values of ``Id`` do not matter.
    """
    scaled = F.col("polarity").cast("decimal(38,12)") * UNIT
    bad = (scaled != F.round(scaled)) | (F.abs(scaled) > UNIT) | scaled.isNull()
    units = F.when(bad, F.raise_error(F.concat(
        F.lit("polarity is not a number of six decimals in [-1, 1]: "), F.col("word"))).cast("bigint")
    ).otherwise(scaled.cast("bigint"))
    values = lexicon.select("word", units.alias("units")).groupBy("word").agg(
        F.min("units").alias("units"), F.max("units").alias("other"))
    values = values.select("word", F.when(F.col("units") != F.col("other"), F.raise_error(F.concat(
        F.lit("two polarities for "), F.col("word"))).cast("bigint")).otherwise(F.col("units")).alias("units"),
        F.lit(1).alias("n"))
    marks = lexicon.sparkSession.range(MARKERS).select(
        F.concat(F.lit(" "), F.col("id").cast("string")).alias("word"),
        F.lit(0).cast("bigint").alias("units"), F.lit(0).alias("n"))
    kept = [c for c in dict.fromkeys((*keep, "Score")) if c in reviews.columns]
    rows = reviews.select(F.monotonically_increasing_id().alias("_row"), *kept,
                          text.words(text.plain_text(F.col("Text"))).alias("_words"))
    mark = F.concat(F.lit(" "), F.pmod("_row", F.lit(MARKERS)).cast("string"))
    words = rows.select("_row", *kept, F.explode(F.concat(
        F.array(mark), F.coalesce("_words", F.array().cast("array<string>")))).alias("word"))
    sums = words.join(values.unionByName(marks), "word").groupBy("_row", *kept).agg(
        F.sum("units").alias("_units"), F.sum("n").alias("_n"))
    score = F.when(F.col("_n") > 0, F.col("_units") / F.lit(float(UNIT)) / F.col("_n")).otherwise(0.0)
    labelled = _labelled(sums.withColumn("SentimentScore", score))
    return labelled.drop("_row", "_units", "_n", *(() if "Score" in keep else ("Score",)))


def _labelled(scored: DataFrame) -> DataFrame:
    labels = {"Sentiment": bands.sentiment_class(F.col("SentimentScore"))}
    if "Score" in scored.columns:
        labels["ExpectedSentiment"] = bands.star_class(F.col("Score"))
    return scored.withColumns(labels)


def review_facts(scored: DataFrame) -> DataFrame:
    """Everything but the long texts: a narrow table that the marts read."""
    wanted = ("Id", "ProductId", "Score", "Time", "YearMonth", "Year", "Summary",
              "SentimentScore", "Sentiment", "ExpectedSentiment")
    return scored.select(
        *[c for c in wanted if c in scored.columns],
        text.word_count(F.col("Text")).alias("ReviewLen"),
    )
