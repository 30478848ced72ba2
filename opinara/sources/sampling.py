"""Exact-size repeatable samples: rows in the order of a seeded hash of ``Id``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import fixed_values as v

_BUCKET_DIGITS = 4  # 65,536 hash buckets


def sample_key(seed: int) -> Column:
    row = F.coalesce(F.col("Id").cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), row).cast("binary"))


def sample_rows(df: DataFrame, n: int, seed: int = v.SAMPLE_SEED) -> DataFrame:
    """``n`` rows without replacement, all rows when there are no more than ``n``.

    A first pass over ``Id`` alone counts rows per hash bucket and finds the bucket in
    which the ``n``-th row falls.  Rows of the buckets before it are taken where they are; only
    the one bucket is put in order, for the rest of ``n``.
    """
    bucket = F.substring(sample_key(seed), 1, _BUCKET_DIGITS)
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    so_far = F.sum("rows").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    )
    edge = (
        counts.select("bucket", "rows", so_far.alias("so_far"))
        .where(F.col("so_far") >= n)
        .agg(F.min_by(F.struct("bucket", (n - F.col("so_far") + F.col("rows")).alias("rest")), "bucket"))
        .scalar()
    )
    last = F.coalesce(edge["bucket"], F.lit("g"))  # "g": behind all hexadecimal digits
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", "Id"))
    at_edge = df.withColumns({"_bucket": bucket, "_key": sample_key(seed)}).where(F.col("_bucket") == last)
    rest = at_edge.withColumn("_place", place).where(F.col("_place") <= edge["rest"])
    return df.where(bucket < last).unionByName(rest.select(df.columns))


def quote_lists(
    reviews: DataFrame,
    lists: Mapping[str, Column],
    n: int = v.QUOTES_PER_ANSWER,
    seed: int = v.QUOTE_SEED,
) -> DataFrame:
    """Up to ``n`` reviews for each named condition: ``list, ord, Id, Score, Summary``.

    One pass for all lists: every review is dealt to the lists it belongs to, and each task
    keeps ``n`` rows per list.  The outer form keeps Spark from testing the conditions in a
    filter of their own, which would score the texts once more.
    """
    if "Summary" not in reviews.columns:
        reviews = reviews.withColumn("Summary", F.lit(None).cast("string"))
    member = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in lists.items()]))
    rows = reviews.select("Id", "Score", "Summary", sample_key(seed).alias("key"),
                          F.explode_outer(member).alias("list")).where(F.col("list").isNotNull())
    place = F.row_number().over(Window.partitionBy("list").orderBy("key", "Id"))
    return rows.withColumn("ord", place).where(F.col("ord") <= n).select(
        "list", "ord", "Id", "Score", "Summary")


def sample_quotes(
    reviews: DataFrame,
    condition: Column,
    n: int = v.QUOTES_PER_ANSWER,
    seed: int = v.QUOTE_SEED,
) -> DataFrame:
    """Up to ``n`` reviews that meet ``condition``: ``ord, Id, Score, Summary``."""
    return quote_lists(reviews, {"": condition}, n, seed).drop("list")
