"""What the physical plans must look like."""

import pytest

import __spark_entry__ as entry
from opinara.operators import keywords, metrics, sentiment
from opinara.plans.answers import answer_table
from opinara.plans.marts import Marts
from opinara.plans.report import report
from opinara.sources import reviews as source

QUERIES = entry.queries()
SCORING = "aggregate(filter(split("


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", [
    "sentiment_distribution", "kpi", "top_complaints", "common_words", "keyword_lists",
    "complaint_insights", "monthly_negative", "forecast", "trend_chart", "yearly",
    "top_products", "review_length", "longest_review", "sentiment_scored", "sentiment_joined",
    "class_quotes", "star_quotes",
])
def test_texts_are_read_and_scored_once(spark, sf, name):
    plan = final_plan(QUERIES[name](spark, sf))
    assert plan.count("FileScan") == 1
    assert plan.count(SCORING) <= 1
    assert "EvalPython" not in plan


@pytest.mark.parametrize("name", [
    "star_breakdown", "complaint_insights", "trend_chart", "route_questions", "sample_fixed_n",
])
def test_no_pairs_of_everything(spark, sf, name):
    plan = final_plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scoring_moves_no_data(spark, sf):
    raw = source.reviews_from_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    scored = sentiment.score(source.load_reviews(raw), entry.LEXICON)
    assert "Exchange" not in final_plan(scored.select("Id", "Sentiment", "CleanText"))
    counted = final_plan(metrics.class_cube(scored))
    assert counted.count("Exchange hashpartitioning") == 1 and "partial_count" in counted


def test_joined_scoring_moves_no_text(spark, sf):
    plan = QUERIES["sentiment_joined"](spark, sf)._jdf.queryExecution().executedPlan()
    for line in plan.toString().split("== Initial Plan ==")[0].splitlines():
        assert "Exchange" not in line or "text#" not in line.lower()


def test_columns_and_null_filters_reach_the_scan(spark, sf):
    plan = final_plan(QUERIES["star_histogram"](spark, sf))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "[text#" in scan and "n_chars#" in scan and "doc_id#" not in scan
    assert "IsNotNull(n_chars)" in scan and "IsNotNull(text)" in scan


def test_word_joins_send_the_word_list_not_the_tokens(spark, sf):
    for name in ("sentiment_joined", "stop_words_joined"):
        plan = final_plan(QUERIES[name](spark, sf))
        assert "BroadcastHashJoin [word#" in plan and "BuildRight" in plan


def test_answers_read_each_mart_once(spark, sf):
    raw = source.reviews_from_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    marts = Marts.build(sentiment.score(source.load_reviews(raw), entry.LEXICON))
    plans = {name: table(marts)._jdf.queryExecution().optimizedPlan().toString()
             for name, table in (("answers", answer_table), ("report", report))}
    reads = {name: [line for line in plan.splitlines() if "Relation [" in line and "parquet" in line]
             for name, plan in plans.items()}
    facts = [line for line in reads["answers"] if "ReviewLen" in line or "[Id#" in line]
    assert len(facts) <= 3 and len(reads["answers"]) - len(facts) == 2
    assert len(reads["report"]) == 2 and not any("n_chars" in plan for plan in plans.values())


def test_cube_and_words_come_from_one_pass(spark, sf):
    raw = source.reviews_from_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = final_plan(keywords.review_counts(sentiment.score(source.load_reviews(raw), entry.LEXICON)))
    assert plan.count("FileScan") == 1 and plan.count(SCORING) == 1
    assert plan.count("Exchange") == 1 and "partial_count" in plan
