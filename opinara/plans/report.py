"""The headline report as rows: ``section, ord, label, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.functions.numbers import fixed, grouped
from opinara.plans.figures import figures, insights
from opinara.plans.marts import Marts


def report(marts: Marts) -> DataFrame:
    """From one row of figures, so the marts are read once each."""

    def line(section: str, order: Column, label: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), order.cast("int").alias("ord"),
                        label.alias("label"), value.alias("value"))

    def count_and_share(count: str, share: str) -> Column:
        return F.concat(grouped(F.col(count)), F.lit(" ("), fixed(F.col(share), 1), F.lit("%)"))

    summary = F.array(*[
        line("summary", F.lit(i), F.lit(label), value)
        for i, (label, value) in enumerate((
            ("Total", grouped(F.col("total"))),
            (v.POSITIVE, count_and_share("positive", "positive_pct")),
            (v.NEGATIVE, count_and_share("negative", "negative_pct")),
            (v.NEUTRAL, count_and_share("neutral", "neutral_pct")),
            ("Avg Rating", F.concat(fixed(F.col("avg_rating"), 2), F.lit("/5"))),
        ), 1)
    ])
    complaints = F.transform(insights(F.col("words")["complaints"], F.col("total")), lambda c: line(
        "complaints", c["rank"], c["word"],
        F.concat(c["mentions"].cast("string"), F.lit("x - "), c["impact"])))
    praise = F.transform(F.slice(F.col("words")["praise"], 1, v.INSIGHT_LINES), lambda p: line(
        "praise", p["rank"], p["word"], p["mentions"].cast("string")))
    parts = [summary, complaints, praise]
    if marts.has_time:
        parts.append(F.transform("ahead", lambda s: line(
            "forecast", s["step"], s["label"], F.concat(fixed(s["neg_pct"], 1), F.lit("%")))))
    lines = F.concat(*[F.coalesce(p, F.filter(summary, lambda _: F.lit(False))) for p in parts])
    return figures(marts).select(F.inline(lines))
