"""All figures of the report and the answers in one row, from one read of each mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.functions import bands
from opinara.functions.numbers import percent, round_scaled
from opinara.operators import impact, metrics, trend
from opinara.plans.marts import OVERALL, Marts

STARS = range(1, 6)


def cube_figures(cube: DataFrame) -> DataFrame:
    """One row: headline figures, ``stars`` 1 to 5, and with a ``YearMonth`` column ``years``, the
    months' summary and the trend line.

    One aggregate gives the sums per star, per month and per year; the few rows it leaves are
    put into one.
    """
    timed = "YearMonth" in cube.columns
    rows = cube.withColumn("Year", F.year("YearMonth")) if timed else cube
    levels = ("Score", "YearMonth", "Year") if timed else ("Score",)
    n = F.col("n")

    def of(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")

    sums = rows.groupingSets([[c] for c in levels], *levels).agg(
        *[(F.grouping(c) == 0).alias(f"by_{c}") for c in levels],
        F.sum("n").cast("bigint").alias("n"),
        *[of(F.col("Sentiment") == c).alias(c.lower()) for c in v.CLASSES],
        of(bands.star_class(rows["Score"]) == F.col("Sentiment")).alias("agreeing"),
        F.sum(rows["Score"].cast("decimal(18,6)") * n).alias("stars"),
    )
    star = F.col("by_Score")

    def total(name: str, where: Column = star) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(name))), F.lit(0)).cast("bigint")

    columns = {
        "total": total("n"),
        **{c: total(c) for c in ("positive", "negative", "neutral", "agreeing")},
        "avg_rating": F.try_divide(F.sum(F.when(star, F.col("stars"))).cast("double"),
                                   F.sum(F.when(star, n))),
        "mode_rating": F.max_by("Score", F.when(star, F.struct(n, -F.col("Score")))),
        **{f"star_{k}": total("n", star & (F.col("Score") == k)) for k in STARS},
    }
    if timed:
        month, year = F.col("by_YearMonth"), F.col("by_Year") & F.col("Year").isNotNull()
        month = month & F.col("YearMonth").isNotNull()
        share = percent(F.col("negative"), n)
        index = F.row_number().over(Window.partitionBy(month).orderBy("YearMonth")) - 1
        # The sums have one row per star, month and year.
        sums = sums.select("*", F.when(month, share).alias("neg_pct"), F.when(month, index).alias("t"))
        last = F.when(month, F.col("YearMonth"))
        columns |= {
            "n_months": F.count("t"), "slope": F.regr_slope("neg_pct", "t"),
            "intercept": F.regr_intercept("neg_pct", "t"), "last_t": F.max("t"),
            "first_month": F.min(last), "last_month": F.max(last),
            "worst_month": F.max_by("YearMonth", F.when(month, F.struct("neg_pct", -F.col("t")))),
            "best_month": F.min_by("YearMonth", F.when(month, F.struct("neg_pct", "t"))),
            "years": F.array_sort(F.collect_list(F.when(year, F.struct(
                F.col("Year").alias("year"), F.col("n").alias("reviews"),
                F.try_divide(F.col("stars").cast("double"), n).alias("avg_rating"),
                percent(F.col("positive"), n).alias("positive_pct"),
                percent(F.col("negative"), n).alias("negative_pct"))))),
        }
    found = sums.agg(*[c.alias(name) for name, c in columns.items()])
    every = F.col("total")
    found = found.select(
        "*",
        *[percent(F.col(c), every).alias(f"{c}_pct") for c in ("positive", "negative", "neutral")],
        percent(F.col("positive"), every).alias("csat"),
        percent(F.col("agreeing"), every).alias("agreement_pct"),
        F.array(*[F.struct(F.lit(k).alias("star"), F.col(f"star_{k}").alias("n"),
                           percent(F.col(f"star_{k}"), every).alias("pct")) for k in STARS]).alias("stars"),
    )
    if not timed:
        return found
    slope = F.col("slope")
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(v.FORECAST_MONTHS)),
        lambda step: trend.forecast_step(step, slope, F.col("intercept"), F.col("last_t"), F.col("last_month")))
    enough = F.col("n_months") >= v.MIN_MONTHS_FOR_FORECAST
    return found.select(
        "*", F.when(enough, round_scaled(slope, 3)).alias("slope_rounded"),
        F.when(enough, bands.trend_direction(slope)).alias("direction"),
        F.when(enough, ahead).alias("ahead"))


def word_figures(marts: Marts) -> Column:
    """The lists ``complaints``, ``praise`` and ``common``, each of ``rank, word, mentions, listed``
    (the impact that the table lists), as one value."""
    entry = F.struct("rank", "word", "mentions", "listed")
    lists = {"complaints": v.NEGATIVE, "praise": v.POSITIVE, "common": OVERALL}
    rows = impact.listed_impact(marts.tops, marts.impact)
    return rows.agg(F.struct(*[
        F.array_sort(F.collect_list(F.when(F.col("Sentiment") == of, entry))).alias(name)
        for name, of in lists.items()])).scalar()


def insights(complaints: Column, total: Column) -> Column:
    """The first complaints with ``impact`` and ``line`` (see impact.insight)."""
    def one(c: Column) -> Column:
        said = F.coalesce(c["listed"], impact.default_impact(c["mentions"], total))
        share = metrics.rounded_share(c["mentions"], total)
        return F.struct(c["rank"].alias("rank"), c["word"].alias("word"), c["mentions"].alias("mentions"),
                        said.alias("impact"),
                        impact.insight(c["word"], c["mentions"], share, said).alias("line"))

    return F.transform(F.slice(complaints, 1, v.INSIGHT_LINES), one)


def figures(marts: Marts) -> DataFrame:
    """The cube's figures and the word lists side by side."""
    words = word_figures(marts)
    return cube_figures(marts.cube).select("*", words.alias("words"))
