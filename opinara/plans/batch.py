"""The whole batch job: load, score, store, write every mart."""

from __future__ import annotations

from pyspark.sql import DataFrame

from opinara.operators import sentiment, trend
from opinara.operators.products import complained_products, top_products
from opinara.plans.answers import answer_table
from opinara.plans.charts import chart_marts
from opinara.plans.marts import Marts
from opinara.plans.report import report
from opinara.sources.reviews import load_reviews
from opinara.sources.sinks import write_marts


def all_marts(marts: Marts) -> dict[str, DataFrame]:
    tables = dict(chart_marts(marts))
    tables["report"] = report(marts)
    tables["answers"] = answer_table(marts)
    tables["review_length"] = marts.lengths
    tables["longest_review"] = marts.longest
    if marts.has_time:
        tables["monthly_negative"] = marts.monthly
        tables["spike_months"] = trend.spike_months(marts.monthly)
        tables["yearly"] = marts.yearly
        tables["forecast"] = marts.forecast
        tables["scenarios"] = trend.scenarios(marts.forecast)
    if marts.has_products:
        tables["top_products"] = top_products(marts.products)
        tables["complained_products"] = complained_products(marts.products)
    return tables


def run(
    raw: DataFrame,
    lexicon: sentiment.Lexicon,
    out: str,
    sample_size: int | None = None,
    impact_table: DataFrame | None = None,
    spread: int | None = None,
) -> Marts:
    """Two passes over the texts, then every table under ``out``; returns the marts."""
    scored = sentiment.score(load_reviews(raw, sample_size, spread=spread), lexicon)
    marts = Marts.build(scored, impact_table)
    write_marts(all_marts(marts), out)
    return marts
