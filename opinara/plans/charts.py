"""Chart-ready tables; drawing is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.operators import keywords, metrics, trend
from opinara.plans.marts import Marts


def sentiment_bars(cube: DataFrame) -> DataFrame:
    return metrics.sentiment_distribution(cube).select("Sentiment", "n")


def trend_chart(cube: DataFrame) -> DataFrame:
    """Lines over time: ``series, point_date, value, unit``.

    Class lines count reviews.  The forecast line is a percentage, so it starts at the
    last observed negative *share* and its unit says so; its three points are dated at
    month ends.
    """
    per_class = (
        trend.monthly_by_class(cube)
        .unpivot(["month"], list(v.CLASSES), "series", "value")
        .select(
            "series", F.col("month").alias("point_date"),
            F.col("value").cast("double").alias("value"), F.lit("reviews").alias("unit"),
        )
    )
    fit = trend.trend_fit(trend.monthly_negative(cube))
    start = fit.select(
        F.lit("Forecast").alias("series"), F.col("last_month").alias("point_date"),
        F.col("last_neg_pct").alias("value"), F.lit("percent").alias("unit"),
    )
    ahead = trend.forecast(fit).select(
        F.lit("Forecast").alias("series"), F.last_day("month").alias("point_date"),
        F.col("neg_pct").alias("value"), F.lit("percent").alias("unit"),
    )
    return per_class.unionByName(start).unionByName(ahead)


def yearly_bars(cube: DataFrame) -> DataFrame:
    return metrics.yearly(cube).select("year", "positive_pct", "negative_pct", "reviews")


def chart_marts(marts: Marts) -> dict[str, DataFrame]:
    """All chart tables by name; those that need ``Time`` only when it is there."""
    cube = marts.cube
    charts = {
        "kpi_cards": metrics.kpi_cards(cube),
        "sentiment_bars": sentiment_bars(cube),
        "sentiment_share": metrics.sentiment_distribution(cube),
        "star_histogram": metrics.star_histogram(cube),
        "complaint_words": marts.complaints,
        "praise_words": marts.praise,
        "complaint_impact": keywords.impact_bars(marts.complaints, marts.total),
    }
    if marts.has_time:
        charts["sentiment_trend"] = trend_chart(cube)
        charts["yearly_sentiment"] = yearly_bars(cube)
    return charts
