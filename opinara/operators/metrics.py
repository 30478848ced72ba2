"""Counts, shares, ratings and satisfaction.

Everything here reads the *class cube*: review counts per month, star score and
class.  It has at most months x 5 x 3 rows whatever the input size, takes one pass with
map-side aggregation, and the metrics of one report share its single shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.functions import bands
from opinara.functions.numbers import fixed, grouped, percent, round_exact

CUBE_KEYS = ("YearMonth", "Score", "Sentiment")


def class_cube(scored: DataFrame, *keys: str) -> DataFrame:
    """Review counts ``n`` by the given keys (all of them by default)."""
    present = [k for k in (keys or CUBE_KEYS) if k in scored.columns]
    return scored.groupBy(*present).agg(F.count(F.lit(1)).alias("n"))


def _sum_where(condition: Column | None = None) -> Column:
    n = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0)).cast("bigint")


def _over_all(aggregate: Column) -> Column:
    """Over the whole table: only for aggregates of a few rows."""
    return aggregate.over(Window.partitionBy())


def _class(name: str) -> Column:
    return F.col("Sentiment") == name


def avg_rating() -> Column:
    """Aggregate: mean star score, from an exact sum (stars of up to six decimals)."""
    return F.try_divide(F.sum(F.col("Score").cast("decimal(18,6)") * F.col("n")).cast("double"), F.sum("n"))


def rounded_share(part: Column, total: Column) -> Column:
    return round_exact(percent(part, total), 1)


def total_reviews(cube: DataFrame) -> DataFrame:
    return cube.agg(_sum_where().alias("total"))


def sentiment_distribution(cube: DataFrame) -> DataFrame:
    """Observed classes with count and share, most frequent first."""
    total = _over_all(F.sum("n"))
    return (
        cube.groupBy("Sentiment")
        .agg(_sum_where().alias("n"))
        .select("Sentiment", "n", percent(F.col("n"), total).alias("pct"))
        .orderBy(F.desc("n"), "Sentiment")
    )


def mode_rating(score: str, n: str) -> Column:
    """Aggregate over a star histogram: most frequent score, the smallest on a tie."""
    return F.max_by(score, F.struct(F.col(n), -F.col(score)))


def kpi(cube: DataFrame) -> DataFrame:
    """The headline figures as one row."""
    agree = bands.star_class(F.col("Score")) == F.col("Sentiment")
    per_star = cube.groupBy("Score").agg(
        _sum_where().alias("n"),
        _sum_where(_class(v.POSITIVE)).alias("positive"),
        _sum_where(_class(v.NEGATIVE)).alias("negative"),
        _sum_where(_class(v.NEUTRAL)).alias("neutral"),
        _sum_where(agree).alias("agreeing"),
    )

    def summed(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")

    counts = per_star.agg(
        summed("n").alias("total"),
        *[summed(c).alias(c) for c in ("positive", "negative", "neutral", "agreeing")],
        avg_rating().alias("avg_rating"),
        mode_rating("Score", "n").alias("mode_rating"),
    )
    total = F.col("total")
    return counts.select(
        "total", "positive", "negative", "neutral",
        percent(F.col("positive"), total).alias("positive_pct"),
        percent(F.col("negative"), total).alias("negative_pct"),
        percent(F.col("neutral"), total).alias("neutral_pct"),
        "avg_rating", "mode_rating",
        percent(F.col("positive"), total).alias("csat"),
        percent(F.col("agreeing"), total).alias("agreement_pct"),
    )


def kpi_cards(cube: DataFrame) -> DataFrame:
    """Five cards: ``ord, label, value`` (number) and ``shown`` (text)."""
    k = kpi(cube)

    def card(order: int, label: str, value: Column, shown: Column) -> Column:
        return F.struct(
            F.lit(order).alias("ord"), F.lit(label).alias("label"),
            value.cast("double").alias("value"), shown.alias("shown"),
        )

    pos, neg, rating = F.col("positive_pct"), F.col("negative_pct"), F.col("avg_rating")
    cards = F.array(
        card(1, "Total Reviews", F.col("total"), grouped(F.col("total"))),
        card(2, "Positive %", pos, F.concat(fixed(pos, 1), F.lit("%"))),
        card(3, "Negative %", neg, F.concat(fixed(neg, 1), F.lit("%"))),
        card(4, "Avg Rating", rating, F.concat(fixed(rating, 2), F.lit("/5"))),
        card(5, "CSAT Score", pos, F.concat(fixed(pos, 0), F.lit("%"))),
    )
    return k.select(F.inline(cards))


def star_label_agreement(cube: DataFrame) -> DataFrame:
    """How often the scored class equals the class the stars suggest."""
    agree = bands.star_class(F.col("Score")) == F.col("Sentiment")
    return cube.agg(_sum_where(agree).alias("agreeing"), _sum_where().alias("total")).select(
        "agreeing", "total", percent(F.col("agreeing"), F.col("total")).alias("agreement_pct")
    )


def star_histogram(cube: DataFrame) -> DataFrame:
    """Observed star scores with their counts, ascending."""
    return cube.groupBy("Score").agg(_sum_where().alias("n")).orderBy("Score")


def star_breakdown(cube: DataFrame) -> DataFrame:
    """Stars 1 to 5 with count and share, absent ones as zero."""
    spine = cube.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("star"))
    seen = (
        cube.groupBy(F.col("Score").alias("star"))
        .agg(_sum_where().alias("seen"))
        .withColumn("all", _over_all(F.sum("seen")))
    )
    n = F.coalesce("seen", F.lit(0)).cast("bigint")
    total = _over_all(F.max("all"))
    return (
        spine.join(seen, "star", "left")
        .select("star", n.alias("n"), percent(n, total).alias("pct"))
        .orderBy("star")
    )


def star_share(cube: DataFrame, star: int) -> DataFrame:
    """Count and share of one star score."""
    return cube.agg(
        _sum_where(F.col("Score") == star).alias("n"), _sum_where().alias("total")
    ).select("n", "total", percent(F.col("n"), F.col("total")).alias("pct"))


def rating_summary(cube: DataFrame) -> DataFrame:
    rating = F.col("avg_rating")
    return kpi(cube).select(
        "total", "avg_rating", "mode_rating",
        bands.industry_position(rating).alias("industry_position"),
        bands.rating_benchmark(rating).alias("benchmark"),
        bands.rating_advice(rating).alias("advice"),
    )


def csat(cube: DataFrame) -> DataFrame:
    return kpi(cube).select(
        "csat", "avg_rating",
        bands.csat_level(F.col("csat")).alias("level"),
        bands.csat_benchmark(F.col("csat")).alias("benchmark"),
    )


def urgency(cube: DataFrame) -> DataFrame:
    share = F.col("negative_pct")
    return kpi(cube).select(
        "negative", "negative_pct",
        bands.urgency(share).alias("priority"),
        bands.urgency_note(share).alias("note"),
    )


def yearly(cube: DataFrame) -> DataFrame:
    """Reviews, mean rating, class counts and shares per year."""
    positive, negative = _sum_where(_class(v.POSITIVE)), _sum_where(_class(v.NEGATIVE))
    per_year = (
        cube.where(F.col("YearMonth").isNotNull())
        .groupBy(F.year("YearMonth").alias("year"))
        .agg(
            _sum_where().alias("reviews"), avg_rating().alias("avg_rating"),
            positive.alias("positive"), negative.alias("negative"),
        )
    )
    return per_year.select(
        "*",
        percent(F.col("positive"), F.col("reviews")).alias("positive_pct"),
        percent(F.col("negative"), F.col("reviews")).alias("negative_pct"),
    ).orderBy("year")
