"""Product rankings from one aggregate per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.functions.numbers import percent


def product_stats(scored: DataFrame) -> DataFrame:
    """Reviews, class counts and mean rating per product.

    Sums are built in each task first, so a product with a third of all reviews
    sends one row per task like any other.
    """
    return (
        scored.where(F.col("ProductId").isNotNull())
        .groupBy("ProductId")
        .agg(
            F.count(F.lit(1)).alias("reviews"),
            F.count_if(F.col("Sentiment") == v.POSITIVE).alias("positive"),
            F.count_if(F.col("Sentiment") == v.NEGATIVE).alias("negative"),
            (F.sum(F.col("Score").cast("decimal(18,6)")).cast("double") / F.count("Score")).alias(
                "avg_rating"),
        )
    )


def top_products(stats: DataFrame, n: int = v.TOP_PRODUCTS) -> DataFrame:
    """Most reviewed products; equal counts by product id."""
    order = (F.desc("reviews"), F.col("ProductId"))
    return stats.orderBy(*order).limit(n).select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        "ProductId", "reviews", "avg_rating",
        percent(F.col("positive"), F.col("reviews")).alias("positive_pct"),
    )


def complained_products(stats: DataFrame, n: int = v.COMPLAINED_PRODUCTS) -> DataFrame:
    """Products with most negative reviews; the rating covers all their reviews."""
    order = (F.desc("negative"), F.col("ProductId"))
    return stats.where(F.col("negative") > 0).orderBy(*order).limit(n).select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        "ProductId", "negative", "avg_rating",
    )


def product_lists(stats: DataFrame) -> DataFrame:
    """Both lists in one value from one read of the products: ``most`` and ``worst``.

    Each product stands for both lists; tasks keep a list's first rows before they meet.
    """
    lists = F.array(
        F.struct(F.lit("most").alias("list"), F.col("reviews").alias("by")),
        F.struct(F.lit("worst").alias("list"),
                 F.when(F.col("negative") > 0, F.col("negative")).alias("by")))
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("by"), "ProductId"))
    rows = stats.select("*", F.inline(lists)).where(F.col("by").isNotNull())
    first = rows.withColumn("rank", place).where(F.col("rank") <= max(v.TOP_PRODUCTS, v.COMPLAINED_PRODUCTS))
    entry = F.struct("rank", "ProductId", "reviews", "negative", "avg_rating",
                     percent(F.col("positive"), F.col("reviews")).alias("positive_pct"))

    def of(name: str, n: int) -> Column:
        mine = (F.col("list") == name) & (F.col("rank") <= n)
        return F.array_sort(F.collect_list(F.when(mine, entry))).alias(name)

    return first.agg(F.struct(of("most", v.TOP_PRODUCTS), of("worst", v.COMPLAINED_PRODUCTS)).alias("products"))
