"""Single expressions against expected values written in plain Python."""

import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinara.functions import bands, dates, numbers, text


def column(spark, values, kind, expression):
    rows = [(i, x) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def expected_clean(s):
    low = s.lower()
    tags = re.sub(r"<.*?>", " ", low)
    return " ".join(re.findall(r"[a-z]+", tags))


TEXTS = [
    "", "   ", "Plain words", "it's <b>bold</b> & <br/>new", "<b\nr> kept", "<q\rr> gone",
    "a < b > c", "<<x>> y", "<open", "close> <", "Café naïve ÉTÉ", "12345 67", "tab\tand\x0bvt",
    "nb space em", "x<a b>y", "x<a\u0085b>y", "don't can't", "UPPER lower",
]


def test_clean_text(spark):
    assert column(spark, TEXTS, "string", text.clean_text) == [expected_clean(s) for s in TEXTS]


def test_words_match_the_cleaned_text(spark):
    got = column(spark, TEXTS, "string", lambda c: text.words(text.plain_text(c)))
    assert [[w for w in ws if w] for ws in got] == [expected_clean(s).split() for s in TEXTS]


def test_clean_text_is_idempotent(spark):
    once = column(spark, TEXTS, "string", text.clean_text)
    assert column(spark, once, "string", text.clean_text) == once


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=string.ascii_letters + " <>/\n\r\t.'é ", max_size=30),
                min_size=20, max_size=40))
def test_text_functions_on_random_input(spark, texts):
    assert column(spark, texts, "string", text.clean_text) == [expected_clean(s) for s in texts]
    assert column(spark, texts, "string", text.word_count) == [len(s.split()) for s in texts]


def test_word_count(spark):
    texts = [*TEXTS, "one", " two words ", "a\x1cb\x1fc d", "　wide　", "a\u0085b"]
    assert column(spark, texts, "string", text.word_count) == [len(s.split()) for s in texts]


def test_strip_and_stars(spark):
    assert column(spark, ["  a b\n", " x\t"], "string", text.strip) == ["a b", "x"]
    assert column(spark, [1, 5, 0, 9], "int", text.star_glyphs) == [
        "⭐", "⭐⭐⭐⭐⭐", "⭐", "⭐"]


ROUNDED = [0.25, 12.35, 0.05, 0.35, 2.675, 99.95, 1234.5678, 0.0, 100.0, 33.333333333333336]


def test_round_exact_equals_python(spark):
    got = column(spark, ROUNDED, "double", lambda c: numbers.round_exact(c, 1))
    assert got == [round(x, 1) for x in ROUNDED]


def test_round_scaled_equals_numpy(spark):
    import numpy as np

    for places in (1, 3):
        got = column(spark, ROUNDED, "double", lambda c, p=places: numbers.round_scaled(c, p))
        assert got == [float(np.round(x, places)) for x in ROUNDED]


def test_fixed_equals_python(spark):
    for places in (0, 1, 2):
        got = column(spark, ROUNDED, "double", lambda c, p=places: numbers.fixed(c, p))
        assert got == [f"{x:.{places}f}" for x in ROUNDED]
    assert column(spark, [0, 999, 1234567], "bigint", numbers.grouped) == [
        "0", "999", "1,234,567"]


def test_percent_of_nothing_is_null(spark):
    assert column(spark, [5], "bigint", lambda c: numbers.percent(c, F.lit(0))) == [None]


def test_clamp(spark):
    assert column(spark, [-3.0, 50.0, 140.0], "double",
                  lambda c: numbers.clamp(c, 0.0, 100.0)) == [0.0, 50.0, 100.0]


def test_dates(spark):
    import datetime as dt

    seconds = [0, -1, 1351728000, 1351727999, 951782400, None]
    utc = [None if s is None else dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)
           for s in seconds]
    assert column(spark, seconds, "bigint", dates.epoch_timestamp) == utc
    months = [t and t.date().replace(day=1) for t in utc]
    assert column(spark, seconds, "bigint", dates.epoch_month) == months


@pytest.mark.parametrize("expression, values, expected", [
    (bands.sentiment_class, [0.1, 0.1000001, -0.1, -0.1000001, 0.0],
     ["Neutral", "Positive", "Neutral", "Negative", "Neutral"]),
    (bands.star_class, [1.0, 2.0, 3.0, 4.0, 5.0],
     ["Negative", "Negative", "Neutral", "Positive", "Positive"]),
    (bands.csat_level, [75.0, 75.1, 60.0, 60.1],
     ["Good", "Excellent", "Needs Improvement", "Good"]),
    (bands.csat_benchmark, [70.0, 69.9], ["above benchmark", "below benchmark"]),
    (bands.industry_position, [3.5, 3.51], ["below", "above"]),
    (bands.rating_benchmark, [4.0, 3.99], ["Above", "Below"]),
    (bands.urgency, [30.0, 30.1, 15.0, 15.1], ["MODERATE", "HIGH", "LOW", "MODERATE"]),
    (bands.trend_direction, [0.1, 0.11, -0.1, -0.11],
     ["Stable", "Rising", "Stable", "Falling"]),
    (bands.forecast_risk, [20.0, 20.1, 10.0, 10.1], ["Medium", "High", "Low", "Medium"]),
    (bands.recommendation_note, [0.1, 0.2],
     ["the course is improving", "act before it gets worse"]),
    (bands.scenario_action, [0.0, 0.001],
     ["Keep the present course; the trend is improving.",
      "Step in now to stop the decline."]),
])
def test_band_edges(spark, expression, values, expected):
    assert column(spark, values, "double", expression) == expected
