
from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_queries  # noqa: E402
from opinara import fixed_values as v  # noqa: E402
from opinara.functions.text import clean_text, star_glyphs  # noqa: E402
from opinara.operators import (  # noqa: E402
    impact,
    keywords,
    lengths,
    metrics,
    products,
    sentiment,
    trend,
)
from opinara.plans import charts, questions as ask, report as headline  # noqa: E402
from opinara.plans.answers import answer, answer_table  # noqa: E402
from opinara.plans.marts import Marts  # noqa: E402
from opinara.sources import reviews as source  # noqa: E402
from opinara.sources.sampling import quote_lists, sample_rows  # noqa: E402
from opinara.sources.sinks import (  # noqa: E402
    new_folder,
    stored,
    table_stream,
    write_csv,
    write_marts,
)
from opinara.sources.tables import small_table  # noqa: E402
from opinara.streaming.serve import serve  # noqa: E402

# Words of the invented test texts, with polarities that give all three classes.
LEXICON = {
    "orantion": "0.60", "inoran": "0.40", "thatin": "0.50", "rewh": "0.30",
    "elle": "0.30", "keit": "0.40", "thre": "0.20", "thing": "-0.70",
    "thor": "-0.50", "ononst": "-0.30", "hehely": "-0.60", "sich": "-0.40",
    "orre": "-0.50", "pour": "-0.20",
}

# The invented texts hold none of the real complaint words, so some of theirs are added.
IMPACTS = v.IMPACT_BY_KEYWORD | {
    "thing": "Stand-in impact for thing.",
    "hehely": "Stand-in impact for hehely.",
}

# The operators for training data and their pipeline are optional: without their folder, without a
# package that they need, and without the file of the pipeline, everything else still works.
try:
    from opinara.llm import queries as llm_queries  # noqa: E402
except ImportError:
    llm_queries = None
try:
    import corpus_pipeline  # noqa: E402
except ImportError:
    corpus_pipeline = None
_LLM = llm_queries is not None
_PIPELINE = _LLM and corpus_pipeline is not None

Query = Callable[[SparkSession, str], DataFrame]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.reviews_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews; a session may ask openly for them to be dealt out to so many tasks."""
    spread = spark.conf.get("spark.opinara.spread", None)
    return source.load_reviews(_raw(spark, sf_dir), spread=spread and int(spread))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.score(_reviews(spark, sf_dir), LEXICON)


def _marts(spark: SparkSession, sf_dir: str) -> Marts:
    return Marts.build(_scored(spark, sf_dir), impact.impact_table(spark, IMPACTS))


def _user_turns(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.col("role") == "user").select(
        F.concat_ws(":", "conv_id", "turn").alias("question_id"),
        F.col("text").alias("question"),
    )


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations, the shortcut questions, every trigger, and the phrases
    that an earlier intent decides."""
    asked = _user_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    phrases = [*oracle_queries.trigger_questions(), *oracle_queries.overridden_questions()]
    schema = pa.schema([("question_id", pa.string()), ("question", pa.string())])
    canned = ask.canned_questions(spark).select(
        F.concat(F.lit("canned:"), "question_id").alias("question_id"), "question")
    return asked.unionByName(canned).unionByName(small_table(spark, phrases, schema))


def _cube_query(fn: Callable[[DataFrame], DataFrame], *keys: str) -> Query:
    return lambda spark, d: fn(metrics.class_cube(_scored(spark, d), *keys))


def _word_query(fn: Callable[[DataFrame], DataFrame], name: str) -> Query:
    """``fn(rank, word, mentions, total)`` of the top words of one class."""
    return lambda spark, d: fn(keywords.top_keywords(_scored(spark, d), name)).drop("total")


def _share(top: DataFrame) -> DataFrame:
    return keywords.with_share(top, F.col("total"))


def _load_stats(spark, d):
    return source.load_stats(_raw(spark, d))


def _load_stats_sampled(spark, d):
    return source.load_stats(_raw(spark, d), sample_size=300)


def _csv_reviews(spark, d):
    """The reviews written as CSV and read back: quotes, line breaks, null tokens."""
    folder = new_folder(spark, "csv")
    write_csv(_raw(spark, d), folder)
    return source.load_reviews(source.read_csv(spark, folder)).select(
        "Id", "ProductId", "Score", "Time", "Summary", "Text", "YearMonth"
    )


def _reviews_dated(spark, d):
    return _reviews(spark, d).select("Id", "Score", "Date", "YearMonth", "Year", "Month")


def _sample_fixed_n(spark, d):
    return sample_rows(_raw(spark, d), 300).select("Id", "ProductId", "Score")


def _clean_text(spark, d):
    return _reviews(spark, d).select("Id", clean_text(F.col("Text")).alias("CleanText"))


def _clean_markup(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", clean_text(F.col("html")).alias("CleanText"))


def _sentiment_scored(spark, d):
    return _scored(spark, d).select(
        "Id", "SentimentScore", "Sentiment", "ExpectedSentiment",
        (F.col("Sentiment") == F.col("ExpectedSentiment")).alias("agrees"),
    )


def _sentiment_joined(spark, d):
    """The scoring for lexicons too large for a constant."""
    schema = pa.schema([("word", pa.string()), ("polarity", pa.string())])
    table = small_table(spark, LEXICON.items(), schema)
    scored = sentiment.score_by_join(_reviews(spark, d), table)
    return scored.select("Id", "SentimentScore", "Sentiment")


def _sentiment_plugin(spark, d):
    """The caller's own scorer as an Arrow batch function."""
    lexicon = {w: round(float(p) * 100) for w, p in LEXICON.items()}

    def scorer(clean):
        found = clean.reset_index(drop=True).str.split().explode().map(lexicon).dropna()
        per_text = found.groupby(level=0).agg(["sum", "count"]).reindex(range(len(clean)))
        return (per_text["sum"] / 100 / per_text["count"]).fillna(0.0)

    return sentiment.score_with(_reviews(spark, d), scorer).select(
        "Id", "SentimentScore", "Sentiment"
    )


def _complaint_insights(spark, d):
    table = impact.impact_table(spark, IMPACTS)
    return _word_query(
        lambda top: impact.insight_lines(top, table, F.col("total")), v.NEGATIVE)(spark, d)


def _common_words(spark, d):
    return _share(keywords.top_keywords(_reviews(spark, d))).drop("total")


def _keyword_lists(spark, d):
    counts = keywords.keyword_counts(_scored(spark, d))
    tops = keywords.top_words_by_class(counts, classes=(v.NEGATIVE, v.POSITIVE))
    return keywords.word_lists(tops, 3)


def _keyword_table(spark, d):
    """Every keyword of every class, not only the top of the list."""
    counts = keywords.keyword_counts(_scored(spark, d))
    return counts.select("Sentiment", "word", "mentions")


def _stop_words_joined(spark, d):
    """The stop list as a table, anti-joined to the tokens."""
    table = keywords.stop_word_table(spark)
    counts = keywords.keyword_counts(_reviews(spark, d), table, by_class=False)
    return counts.select("word", "mentions")


def _trend(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _cube_query(lambda cube: fn(trend.monthly_negative(cube)), "YearMonth", "Sentiment")


def _trend_fit(monthly: DataFrame) -> DataFrame:
    return trend.trend_fit(monthly).select(
        "n_months", "slope_rounded", "direction", "last_t", "last_month"
    )


def _products(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: fn(products.product_stats(_scored(spark, d)))


def _lengths(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: fn(lengths.with_length(_reviews(spark, d)))


def _star_quotes(spark, d):
    """Quoted reviews of the 5-star and 1-star intents."""
    lists = {str(star): F.col("Score") == star for star in (5, 1)}
    return quote_lists(_reviews(spark, d), lists).select(
        "ord", "Id", "Score", "Summary", star_glyphs(F.col("Score")).alias("stars")
    )


def _class_quotes(spark, d):
    """Quoted reviews of the positive and negative intents."""
    lists = {name: F.col("Sentiment") == name for name in (v.POSITIVE, v.NEGATIVE)}
    return quote_lists(_scored(spark, d), lists).withColumnRenamed("list", "Sentiment")


def _answer_table(spark, d):
    return answer_table(_marts(spark, d))


def _answers(spark, d):
    return answer(_questions(spark, d), _answer_table(spark, d))


def _canned_answers(spark, d):
    return answer(ask.canned_questions(spark), _answer_table(spark, d))


def _answers_streamed(spark, d):
    """User turns as a stream of files, each answered as it arrives."""
    stream = table_stream(spark, d, "conversations.parquet")
    answers = stored(_answer_table(spark, d), "answers")
    out = new_folder(spark, "answered")
    query = serve(_user_turns(stream), answers, out, f"{out}-checkpoint", once=True)
    query.awaitTermination()
    columns = "question_id string, question string, intent int, intent_name string, answer string"
    return spark.read.schema(columns).parquet(out)


def _answers_without_columns(spark, d):
    """The answers to reviews that have neither Time nor ProductId nor Summary."""
    few = _raw(spark, d).select("Id", "Score", "Text")
    scored = sentiment.score(source.load_reviews(few), LEXICON)
    return answer_table(Marts.build(scored, impact.impact_table(spark, IMPACTS)))


def _chart_tables(spark, d):
    """Chart tables written to a folder and read back, as rows of one table."""
    marts, folder = _marts(spark, d), new_folder(spark, "charts")
    tables = charts.chart_marts(marts)
    write_marts(tables, folder)

    def back(name, label, value):
        schema = tables[name].schema
        return spark.read.schema(schema).parquet(f"{folder}/{name}").select(
            F.lit(name).alias("chart"), F.concat_ws(" ", *label.split()).alias("label"),
            F.col(value).cast("double").alias("value"))

    parts = [back("kpi_cards", "label", "value"), back("sentiment_bars", "Sentiment", "n"),
             back("sentiment_share", "Sentiment", "pct"), back("sentiment_trend", "series point_date", "value"),
             back("star_histogram", "Score", "n"), back("complaint_words", "word", "mentions"),
             back("praise_words", "word", "mentions"), back("complaint_impact", "word", "pct"),
             back("yearly_sentiment", "year", "positive_pct")]
    return reduce(DataFrame.unionByName, parts)


def _found_by_workers(query: Query) -> Query:
    """The query with this folder on the path of Python workers, which need the package too. On a
    cluster it is shipped as usual (--py-files); a path that does not exist there is ignored."""
    def run(spark, d):
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent))
        return query(spark, d)

    return run


def queries() -> dict[str, Query]:
    return {
        "load_stats": _load_stats,
        "load_stats_sampled": _load_stats_sampled,
        "csv_reviews": _csv_reviews,
        "reviews_dated": _reviews_dated,
        "sample_fixed_n": _sample_fixed_n,
        "clean_text": _clean_text,
        "clean_markup": _clean_markup,
        "sentiment_scored": _sentiment_scored,
        "sentiment_joined": _sentiment_joined,
        "sentiment_plugin": _sentiment_plugin,
        "star_label_agreement": _cube_query(metrics.star_label_agreement, "Score", "Sentiment"),
        "sentiment_distribution": _cube_query(metrics.sentiment_distribution, "Sentiment"),
        "sentiment_bars": _cube_query(charts.sentiment_bars, "Sentiment"),
        "kpi": _cube_query(metrics.kpi, "Score", "Sentiment"),
        "kpi_cards": _cube_query(metrics.kpi_cards, "Score", "Sentiment"),
        "rating_summary": _cube_query(metrics.rating_summary, "Score", "Sentiment"),
        "star_histogram": lambda s, d: metrics.star_histogram(
            metrics.class_cube(_reviews(s, d), "Score")),
        "star_breakdown": lambda s, d: metrics.star_breakdown(
            metrics.class_cube(_reviews(s, d), "Score")),
        "five_star": lambda s, d: metrics.star_share(
            metrics.class_cube(_reviews(s, d), "Score"), 5),
        "one_star": lambda s, d: metrics.star_share(
            metrics.class_cube(_reviews(s, d), "Score"), 1),
        "csat": _cube_query(metrics.csat, "Score", "Sentiment"),
        "urgency": _cube_query(metrics.urgency, "Score", "Sentiment"),
        "top_complaints": _word_query(_share, v.NEGATIVE),
        "top_praise": _word_query(_share, v.POSITIVE),
        "common_words": _common_words,
        "keyword_table": _keyword_table,
        "stop_words_joined": _stop_words_joined,
        "keyword_lists": _keyword_lists,
        "complaint_impact_pct": _word_query(
            lambda top: keywords.impact_bars(top, F.col("total")), v.NEGATIVE),
        "complaint_insights": _complaint_insights,
        "monthly_negative": _trend(lambda monthly: monthly),
        "monthly_by_class": _cube_query(trend.monthly_by_class, "YearMonth", "Sentiment"),
        "trend_summary": _trend(trend.trend_summary),
        "trend_fit": _trend(_trend_fit),
        "forecast": _trend(lambda m: trend.forecast(trend.trend_fit(m))),
        "scenarios": _trend(lambda m: trend.scenarios(trend.forecast(trend.trend_fit(m)))),
        "spike_months": _trend(trend.spike_months),
        "trend_chart": _cube_query(charts.trend_chart, "YearMonth", "Sentiment"),
        "yearly": _cube_query(metrics.yearly),
        "yearly_bars": _cube_query(charts.yearly_bars, "YearMonth", "Score", "Sentiment"),
        "top_products": _products(products.top_products),
        "complained_products": _products(products.complained_products),
        "review_length": _lengths(lengths.review_length),
        "longest_review": _lengths(lengths.longest_review),
        "star_quotes": _star_quotes,
        "class_quotes": _class_quotes,
        "report": lambda s, d: headline.report(_marts(s, d)),
        "route_questions": lambda s, d: ask.route(_questions(s, d)),
        "answers": _answers,
        "answers_without_columns": _answers_without_columns,
        "canned_answers": _canned_answers,
        "chart_tables": _chart_tables,
        "answers_streamed": _answers_streamed,
        **({k: _found_by_workers(q) for k, q in llm_queries.QUERIES.items()} if _LLM else {}),
        **({"pipeline": _found_by_workers(corpus_pipeline.run)} if _PIPELINE else {}),
    }


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: overall sentiment on the smallest tables."""
    return queries()["sentiment_distribution"](spark, "/root/testdata/sf0.001")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries, written independently of the Spark code."""
    return {
        **oracle_queries.build(LEXICON, IMPACTS),
        **(llm_queries.ORACLE if _LLM else {}),
        **({"pipeline": corpus_pipeline.ORACLE_SQL}
           if _PIPELINE and corpus_pipeline.ORACLE_SQL else {}),
    }
