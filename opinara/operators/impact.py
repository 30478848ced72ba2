"""Business impact of complaint keywords."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.functions.numbers import fixed, percent, round_exact
from opinara.sources.tables import small_table


def impact_table(
    spark: SparkSession, impacts: Mapping[str, str] = v.IMPACT_BY_KEYWORD
) -> DataFrame:
    schema = pa.schema([("keyword", pa.string()), ("impact", pa.string())])
    return small_table(spark, impacts.items(), schema)


def default_impact(mentions: Column, total: Column) -> Column:
    return F.concat(
        F.lit("Raised in "), mentions.cast("string"),
        F.lit(" negative reviews ("), fixed(percent(mentions, total), 1),
        F.lit("% of all reviews); look into it soon."),
    )


def insight(word: Column, mentions: Column, pct: Column, impact: Column) -> Column:
    """One line about a complaint."""
    return F.concat(
        F.lit("'"), word, F.lit("': "), mentions.cast("string"),
        F.lit(" mentions ("), fixed(pct, 1), F.lit("% of all reviews) - "), impact,
    )


def listed_impact(keywords: DataFrame, impact: DataFrame) -> DataFrame:
    """Add ``listed``: the table's text, null for a word that it lacks."""
    # One text per keyword, so a keyword listed twice does not repeat a line.
    known = impact.groupBy(F.lower("keyword").alias("_keyword")).agg(F.min("impact").alias("listed"))
    joined = keywords.join(known, F.lower("word") == F.col("_keyword"), "left")
    return joined.select(*keywords.columns, "listed")


def with_impact(keywords: DataFrame, impact: DataFrame, total: Column) -> DataFrame:
    """Add ``impact``: the table's text, or a default naming count and share."""
    default = default_impact(F.col("mentions"), total)
    return listed_impact(keywords, impact).select(
        *keywords.columns, F.coalesce("listed", default).alias("impact"))


def insight_lines(
    complaints: DataFrame, impact: DataFrame, total: Column, n: int = v.INSIGHT_LINES
) -> DataFrame:
    """``rank, word, mentions, pct, impact, line`` of the first ``n`` complaints."""
    share = round_exact(percent(F.col("mentions"), total), 1)
    best = with_impact(complaints.where(F.col("rank") <= n), impact, total)
    best = best.withColumn("pct", share)
    line = insight(F.col("word"), F.col("mentions"), F.col("pct"), F.col("impact"))
    return (
        best.select("rank", "word", "mentions", "pct", "impact", line.alias("line"))
        .orderBy("rank")
    )
