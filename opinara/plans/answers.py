"""Answer texts: one row per intent, joined to routed questions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.functions import bands
from opinara.functions.dates import month_label
from opinara.functions.numbers import fixed, grouped, percent
from opinara.functions.text import joined_lines, star_glyphs
from opinara.operators import lengths, products, trend
from opinara.plans import answer_texts as t
from opinara.plans.figures import figures, insights
from opinara.plans.marts import Marts
from opinara.plans.questions import route
from opinara.sources.sampling import quote_lists

_NONE = "n/a"


def fill(template: str, **columns: Column | str) -> Column:
    """``template`` with each ``{name}`` replaced by a column.

    A name that is not passed is the column of that name.
    """
    pattern, used = "", []
    for text, name, _, _ in Formatter().parse(template):
        pattern += text.replace("%", "%%")
        if name:
            pattern += "%s"
            used.append(columns.get(name, name))
    return F.format_string(pattern, *used) if used else F.lit(template)


def number(value: Column | str, places: int) -> Column:
    return F.coalesce(fixed(_column(value), places), F.lit(_NONE))


def count(value: Column | str) -> Column:
    return F.coalesce(grouped(_column(value)), F.lit(_NONE))


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _lines(rows: Column, template: str, separator: str = "\n", **columns: Callable[[Column], Column]) -> Column:
    """One line for each struct of a short array; a name not passed is the field of that name."""
    names = [name for _, name, _, _ in Formatter().parse(template) if name]

    def line(row: Column) -> Column:
        return fill(template, **{n: columns[n](row) if n in columns else row[n] for n in names})

    return F.coalesce(F.array_join(F.transform(rows, line), separator), F.lit(""))


def _quotes(reviews: DataFrame, lists: Mapping[str, Column]) -> Column:
    """The quotes of every list as one text each, by name, from one pass."""
    if "Summary" not in reviews.columns:
        return F.create_map(F.lit(""), F.lit(""))
    summary = F.coalesce("Summary", F.lit(""))
    line = fill(t.QUOTE, stars=star_glyphs(F.col("Score")), summary=summary)
    texts = quote_lists(reviews, lists).groupBy("list").agg(
        joined_lines(F.col("ord"), line).alias("text"))
    return texts.agg(F.map_from_entries(F.collect_list(F.struct("list", "text")))).scalar()


def _word_list(top: Column, n: int) -> Column:
    return _lines(F.slice(top, 1, n), "{word}", ", ")


def _words(top: Column, template: str) -> Column:
    return _lines(top, template, pct=lambda w: number(percent(w["mentions"], F.col("total")), 1))


def _forecast_texts(marts: Marts) -> tuple[Column, Column, Column]:
    """Trend answer, scenario answer, and the outlook line of the recommendations."""
    if not marts.has_time:
        return F.lit(t.NO_TIME), F.lit(t.NO_FORECAST), F.lit("")
    months = {name: month_label(F.col(f"{name}_month"))
              for name in ("first", "last", "worst", "best")}
    steps = _lines(F.col("ahead"), t.FORECAST_STEP, pct=lambda s: number(s["neg_pct"], 1))
    slope, known = F.col("slope_rounded"), F.col("ahead").isNotNull()
    cases = trend.cases(F.element_at("ahead", v.FORECAST_MONTHS)["neg_pct"])
    scenarios = F.concat(
        fill(t.FORECAST, steps=steps),
        fill(t.SCENARIOS, cases=_lines(cases, t.SCENARIO, pct=lambda c: number(c["neg_pct"], 1)),
             action=bands.scenario_action(slope)))
    outlook = fill(t.OUTLOOK, direction=F.lower("direction"), note=bands.recommendation_note(slope))
    ahead = fill(t.TREND_OUTLOOK, steps=steps, advice=bands.trend_advice(slope))
    return (
        F.concat(fill(t.TREND, **months), F.when(known, ahead).otherwise("")),
        F.when(known, scenarios).otherwise(t.NO_FORECAST),
        F.when(known, outlook).otherwise(""),
    )


def _product_texts(marts: Marts) -> tuple[Column, Column]:
    if not marts.has_products:
        return F.lit(t.NO_PRODUCTS), F.lit(t.NO_PRODUCTS)
    rating = {"rating": lambda p: number(p["avg_rating"], 1), "product": lambda p: p["ProductId"]}
    most = _lines(F.col("products")["most"], t.PRODUCT, **rating,
                  pct=lambda p: number(p["positive_pct"], 0))
    worst = _lines(F.col("products")["worst"], t.COMPLAINED_PRODUCT, **rating)
    return (F.concat(F.lit("Products by number of reviews:\n"), most),
            F.concat(F.lit("Products by negative reviews:\n"), worst))


def _years(marts: Marts) -> Column:
    if not marts.has_time:
        return F.lit(t.NO_YEARS)
    return F.concat(F.lit("Year by year:\n"), _lines(
        F.col("years"), t.YEAR, rating=lambda y: number(y["avg_rating"], 1),
        pos=lambda y: number(y["positive_pct"], 1), neg=lambda y: number(y["negative_pct"], 1)))


def _figures(marts: Marts) -> DataFrame:
    """One row with every text and number that a template names.

    Cube and words are read once each, the facts three times: for quotes, products and lengths.
    """
    quotes = _quotes(marts.facts, {
        "quotes_pos": F.col("Sentiment") == v.POSITIVE,
        "quotes_neg": F.col("Sentiment") == v.NEGATIVE,
        "quotes_top": F.col("Score") == 5,
        "quotes_low": F.col("Score") == 1,
    })
    known = {"found_quotes": quotes, "lengths": lengths.length_figures(marts.facts).scalar()}
    if marts.has_products:
        known["products"] = products.product_lists(marts.products).scalar()
    row = figures(marts).select("*", *[c.alias(n) for n, c in known.items()])

    def count_share(name: str) -> Column:
        return fill("{n} ({pct}%)", n=count(name), pct=number(f"{name}_pct", 1))

    def star(k: int) -> dict[str, Column]:
        found = F.element_at("stars", k)
        return {"n": count(found["n"]), "pct": number(found["pct"], 1)}

    trend_text, scenario_text, outlook = _forecast_texts(marts)
    most_reviewed, most_complained = _product_texts(marts)
    rating, negative = F.col("avg_rating"), F.col("negative_pct")
    complaints, praise = F.col("words")["complaints"], F.col("words")["praise"]
    size = F.col("lengths")
    texts = {
        "total": count("total"),
        "pos": count_share("positive"),
        "neg": count_share("negative"),
        "neu": count_share("neutral"),
        "neg_count": count("negative"),
        "neg_pct": number("negative_pct", 1),
        "rating": number("avg_rating", 2),
        "mode": F.coalesce(F.col("mode_rating").cast("string"), F.lit(_NONE)),
        "csat": number("csat", 1),
        "agreement": number("agreement_pct", 1),
        "csat_level": bands.csat_level(F.col("csat")),
        "csat_benchmark": bands.csat_benchmark(F.col("csat")),
        "industry": bands.industry_position(rating),
        "rating_benchmark": bands.rating_benchmark(rating),
        "rating_advice": bands.rating_advice(rating),
        "retention": bands.retention_note(rating),
        "urgency": bands.urgency(negative),
        "urgency_note": bands.urgency_note(negative),
        **{name: F.coalesce(F.col("found_quotes")[name], F.lit(""))
           for name in ("quotes_pos", "quotes_neg", "quotes_top", "quotes_low")},
        "five_star": fill("{n} ({pct}%)", **star(5)),
        "one_star": fill("{n} ({pct}%)", **star(1)),
        "five_pct": star(5)["pct"],
        "one_pct": star(1)["pct"],
        "star_lines": _lines(F.col("stars"), t.STAR, stars=lambda s: star_glyphs(s["star"]),
                             n=lambda s: count(s["n"]), pct=lambda s: number(s["pct"], 1)),
        "complaint_lines": _lines(insights(complaints, F.col("total")), t.COMPLAINT),
        "complaint_list": _word_list(complaints, 3),
        "praise_lines": _words(F.slice(praise, 1, v.INSIGHT_LINES), t.PRAISE),
        "praise_list": _word_list(praise, 3),
        "first_praise": _word_list(praise, 1),
        "common_lines": _words(F.col("words")["common"], t.COMMON_WORD),
        "trend": trend_text,
        "scenarios": scenario_text,
        "outlook": outlook,
        "most_reviewed": most_reviewed,
        "most_complained": most_complained,
        "years": _years(marts),
        "lengths": fill(t.LENGTHS, average=number(size["avg_words"], 0), short=count(size["short_reviews"]),
                        long=count(size["long_reviews"])),
        "longest": F.coalesce(F.when(size["longest"].isNotNull(), fill(
            t.LONGEST, words=size["longest"]["ReviewLen"], score=size["longest"]["Score"])), F.lit(_NONE)),
    }
    return row.select(*[text.alias(name) for name, text in texts.items()])


def answer_table(marts: Marts) -> DataFrame:
    """``intent, answer``: 25 rows, whatever the size of the data."""
    rows = F.array(*[
        F.struct(F.lit(intent).alias("intent"), fill(template).alias("answer"))
        for intent, template in t.TEMPLATES.items()
    ])
    return _figures(marts).select(F.inline(rows))


def answer(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Route and answer a table (or stream) of ``question_id, question``.

    Every question is answered: an intent that the answer table lacks gets the fallback.
    """
    known = answers.groupBy("intent").agg(F.min("answer").alias("answer"))
    text = F.coalesce("answer", F.lit(t.TEMPLATES[v.FALLBACK_INTENT])).alias("answer")
    return route(questions).join(known, "intent", "left").select(
        "question_id", "question", "intent", "intent_name", text
    )
