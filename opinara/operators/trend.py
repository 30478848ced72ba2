"""Monthly negative share, least-squares line, forecast and scenarios.

Input is the class cube, so each table has one row per observed month at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.functions import bands
from opinara.functions.dates import month_label
from opinara.functions.numbers import clamp, percent, round_scaled


def monthly_by_class(cube: DataFrame) -> DataFrame:
    """Review counts per month, one column per class, absent ones zero."""
    return (
        cube.where(F.col("YearMonth").isNotNull())
        .groupBy(F.col("YearMonth").alias("month"))
        .pivot("Sentiment", list(v.CLASSES))
        .agg(F.sum("n").cast("bigint"))
        .na.fill(0, list(v.CLASSES))
        .orderBy("month")
    )


def monthly_negative(cube: DataFrame) -> DataFrame:
    """Negative share per observed month; ``t`` numbers the months from 0.

    Months without reviews are not filled in.
    """
    negative = F.coalesce(
        F.sum(F.when(F.col("Sentiment") == v.NEGATIVE, F.col("n"))), F.lit(0)
    )
    monthly = (
        cube.where(F.col("YearMonth").isNotNull())
        .groupBy(F.col("YearMonth").alias("month"))
        .agg(F.sum("n").cast("bigint").alias("reviews"), negative.alias("negative"))
    )
    index = F.row_number().over(Window.orderBy("month")) - 1  # one row per month
    return monthly.select(
        "month", "reviews", "negative",
        percent(F.col("negative"), F.col("reviews")).alias("neg_pct"),
        index.alias("t"),
    ).orderBy("month")


def trend_fit(monthly: DataFrame) -> DataFrame:
    """Slope, intercept and direction; no row for fewer than four months."""
    line = monthly.agg(
        F.count(F.lit(1)).alias("n_months"),
        F.regr_slope("neg_pct", "t").alias("slope"),
        F.regr_intercept("neg_pct", "t").alias("intercept"),
        F.max("t").alias("last_t"),
        F.max("month").alias("last_month"),
        F.max_by("neg_pct", "t").alias("last_neg_pct"),
    ).where(F.col("n_months") >= v.MIN_MONTHS_FOR_FORECAST)
    return line.select(
        "*",
        round_scaled(F.col("slope"), 3).alias("slope_rounded"),
        bands.trend_direction(F.col("slope")).alias("direction"),
    )


def forecast_step(
    step: Column, slope: Column, intercept: Column, last_t: Column, last_month: Column
) -> Column:
    """``step, month, label, neg_pct, risk`` of one month ahead."""
    line = slope * (last_t + step) + intercept
    month = F.add_months(last_month, step)
    predicted = round_scaled(clamp(line, 0.0, 100.0), 1)
    return F.struct(
        step.alias("step"), month.alias("month"), month_label(month).alias("label"),
        predicted.alias("neg_pct"), bands.forecast_risk(predicted).alias("risk"),
    )


def forecast(fit: DataFrame, months: int = v.FORECAST_MONTHS) -> DataFrame:
    """Predicted negative share of the next months.

    The line runs over observed months, the labels over calendar months.
    """
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(months)),
        lambda step: forecast_step(step, F.col("slope"), F.col("intercept"), F.col("last_t"),
                                   F.col("last_month")),
    )
    return fit.select(
        F.inline(ahead), "direction", "slope_rounded",
        bands.trend_advice(F.col("slope_rounded")).alias("advice"),
    ).orderBy("step")


def cases(last: Column) -> Column:
    """Best, base and worst case from the last forecast share: array of ``ord, scenario, neg_pct``."""
    return F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("best").alias("scenario"),
                 F.greatest(F.lit(0.0), last - 3).alias("neg_pct")),
        F.struct(F.lit(2).alias("ord"), F.lit("base").alias("scenario"),
                 last.alias("neg_pct")),
        F.struct(F.lit(3).alias("ord"), F.lit("worst").alias("scenario"),
                 F.least(F.lit(100.0), last + 5).alias("neg_pct")),
    )


def scenarios(predicted: DataFrame, months: int = v.FORECAST_MONTHS) -> DataFrame:
    """Best, base and worst case from the last forecast month."""
    action = bands.scenario_action(F.col("slope_rounded"))
    return (
        predicted.where(F.col("step") == months)
        .select(action.alias("action"), F.inline(cases(F.col("neg_pct"))))
        .select("ord", "scenario", "neg_pct", "action")
    )


def trend_summary(monthly: DataFrame) -> DataFrame:
    """First and last month, worst and best month; the earlier wins a tie."""
    worst = F.max_by("month", F.struct(F.col("neg_pct"), -F.col("t")))
    best = F.min_by("month", F.struct(F.col("neg_pct"), F.col("t")))
    return monthly.agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        worst.alias("worst_month"), best.alias("best_month"),
        F.count(F.lit(1)).alias("n_months"),
    )


def spike_months(monthly: DataFrame, above: float = v.SPIKE_PCT) -> DataFrame:
    return monthly.where(F.col("neg_pct") > above).select(
        "month", "reviews", "negative", "neg_pct"
    )
