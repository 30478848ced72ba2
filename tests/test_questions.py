"""Routing, canned questions, answers in batch and as a stream."""

import pytest

from opinara import fixed_values as v
from opinara.operators import sentiment
from opinara.plans import answer_texts
from opinara.plans.answers import answer, answer_table, fill
from opinara.plans.marts import Marts
from opinara.plans.questions import canned_questions, route
from opinara.streaming.serve import answer_stream, serve

from test_operators import LEXICON, ROWS, reviews


def routed(spark, questions):
    df = spark.createDataFrame(list(enumerate(questions)), "question_id bigint, question string")
    return [r.intent for r in route(df).orderBy("question_id").collect()]


def first_match(question):
    asked = question.lower().strip()
    for intent in sorted(v.TRIGGERS):
        if any(p in asked for p in v.TRIGGERS[intent]):
            return intent
    return v.FALLBACK_INTENT


def test_every_trigger_decides_its_question(spark):
    phrases = [(i, p) for i, ps in v.TRIGGERS.items() for p in ps]
    got = routed(spark, [f"  So {p.upper()} now?\n" for _, p in phrases])
    assert got == [first_match(f"so {p} now?") for _, p in phrases]
    assert routed(spark, [p for _, p in phrases]) == [i for i, _ in phrases]


@pytest.mark.parametrize("question, intent", [
    # phrases that an earlier or shorter phrase decides
    ("what are complaints", 7), ("what do customers love", 8), ("what is praised", 8),
    ("top praise", 8), ("lowest review product", 6), ("lowest rated product", 6),
    ("product complaints", 7), ("predict", 11), ("forecast", 11), ("future", 11),
    ("next month", 11), ("projection", 11), ("predictive", 11), ("business impact", 16),
    ("why does it matter", 16), ("what is the impact", 16), ("why important", 16),
    ("how to improve", 17), ("areas to improve", 17), ("improvement areas", 17),
    ("key actions", 17), ("model accuracy", 19), ("year by year", 11),
    ("yearly breakdown", 11),
    # whole questions
    ("Lowest review product?", 6), ("Predictive forecast?", 11),
    ("Why do complaints matter?", 7), ("what will happen next period", 15),
    ("will sentiment improve?", 15), ("how satisfied are they", 14), ("hello", 25), ("", 25),
    ("why", 16), ("What's the sentiment", 1),
])
def test_routing(spark, question, intent):
    assert routed(spark, [question]) == [intent]


def test_canned_questions(spark):
    got = [r.intent for r in route(canned_questions(spark)).orderBy("question_id").collect()]
    assert got == [1, 7, 8, 17, 5, 6, 9, 14, 12, 6, 11, 7]


def test_null_question_falls_back(spark):
    assert routed(spark, [None]) == [25]


def test_fill(spark):
    row = spark.range(1).select(fill("100% of {id} {x}", x=fill("{id}!")).alias("t")).first()
    assert row.t == "100% of 0 0!"
    assert spark.range(1).select(fill("50%").alias("t")).first().t == "50%"


@pytest.fixture(scope="module")
def answers(spark):
    scored = sentiment.score(reviews(spark, ROWS), LEXICON)
    return answer_table(Marts.build(scored)).persist()


def test_every_intent_has_one_answer(answers):
    got = answers.collect()
    assert sorted(r.intent for r in got) == list(range(1, 26)) == sorted(answer_texts.TEMPLATES)
    assert all(r.answer and "{" not in r.answer for r in got)


def test_every_question_is_answered(spark, answers):
    asked = spark.createDataFrame([("a", "what are the top complaints"), ("b", "hello"), ("c", None)],
                                  "question_id string, question string")
    few = answers.where("intent <> 7 AND intent <> 25")
    got = {r.question_id: r.answer for r in answer(asked, few).collect()}
    assert got == dict.fromkeys("abc", answer_texts.TEMPLATES[25])


def test_stream_gives_the_batch_answers(spark, answers, tmp_path):
    questions = canned_questions(spark)
    questions.repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(questions.schema).json(str(tmp_path / "in"))
    query = serve(stream, answers, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(str, got)) == sorted(map(str, answer(questions, answers).collect()))
    with pytest.raises(ValueError):
        answer_stream(questions, answers)
