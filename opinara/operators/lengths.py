"""Review length in words; input needs ``ReviewLen``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.functions import text


def with_length(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("ReviewLen", text.word_count(F.col("Text")))


def _stats() -> list[Column]:
    return [
        F.avg("ReviewLen").alias("avg_words"),
        F.count_if(F.col("ReviewLen") < v.SHORT_REVIEW_WORDS).alias("short_reviews"),
        F.count_if(F.col("ReviewLen") > v.LONG_REVIEW_WORDS).alias("long_reviews"),
    ]


def review_length(reviews: DataFrame) -> DataFrame:
    return reviews.agg(*_stats())


def length_figures(reviews: DataFrame) -> DataFrame:
    """Both tables in one value and one pass: the statistics, and ``longest`` (ReviewLen, Score)."""
    # The first review in Id order has the least Id; one without comes before all others.
    place = F.struct("ReviewLen", F.col("Id").isNull(), -F.col("Id"), -F.col("Score"))
    return reviews.agg(F.struct(
        *_stats(), F.max_by(F.struct("ReviewLen", "Score"), place).alias("longest")).alias("lengths"))


def longest_review(reviews: DataFrame) -> DataFrame:
    """The longest review, the first in ``Id`` order on a tie."""
    return (
        reviews.select("Id", "Score", "ReviewLen")
        .orderBy(F.desc("ReviewLen"), "Id")
        .limit(1)
    )
