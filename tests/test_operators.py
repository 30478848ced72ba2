"""Operators on small hand-written tables, against brute force in plain Python."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.operators import impact, keywords, metrics, products, sentiment, trend
from opinara.plans import answer_texts
from opinara.plans.answers import answer_table
from opinara.plans.batch import run
from opinara.plans.charts import trend_chart
from opinara.plans.marts import Marts
from opinara.plans.report import report
from opinara.sources import reviews as source
from opinara.sources.sampling import sample_quotes, sample_rows

LEXICON = {"fine": 0.5, "nice": "0.10", "awful": Decimal("-0.7"), "meh": -0.1}
SCHEMA = "Id bigint, ProductId string, Score int, Time bigint, Summary string, Text string"


def month(i):
    return int(dt.datetime(2012 + i // 12, i % 12 + 1, 5, tzinfo=dt.UTC).timestamp())


def reviews(spark, rows, columns=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return source.load_reviews(df.select(columns) if columns else df)


def make(n, seed=1, months=8):
    rng = random.Random(seed)
    words = ["fine", "nice", "awful", "meh", "stale", "crisp", "bread", "very", "tea", "coffee"]
    return [(i, rng.choice(["a", "b", "c", None]), rng.randint(1, 5),
             month(rng.randrange(months)), f"s{i}",
             " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n)]


def polarity(text):
    lex = {w: Decimal(str(p)) for w, p in LEXICON.items()}
    hit = [lex[w] for w in text.split() if w in lex]
    return float(sum(hit)) / len(hit) if hit else 0.0


def label(p):
    return "Positive" if p > 0.1 else "Negative" if p < -0.1 else "Neutral"


ROWS = make(300)


@pytest.fixture(scope="module")
def scored(spark):
    return sentiment.score(reviews(spark, ROWS), LEXICON).persist()


def test_score_matches_brute_force(scored):
    got = {r.Id: (r.SentimentScore, r.Sentiment) for r in scored.collect()}
    assert got == {r[0]: (polarity(r[5]), label(polarity(r[5]))) for r in ROWS}


def test_polarity_at_the_edges_is_neutral(spark):
    rows = [(1, "a", 3, 0, "", "nice"), (2, "a", 3, 0, "", "meh"), (3, "a", 3, 0, "", "")]
    got = sentiment.score(reviews(spark, rows), LEXICON).select("Sentiment").distinct().collect()
    assert [r[0] for r in got] == ["Neutral"]


def test_lexicon_kinds_agree(spark):
    """One meaning whichever way the lexicon comes: repeated and null ids, repeated words, three
    decimals."""
    entries = [*LEXICON.items(), ("fine", 0.5), ("stale", -0.125)]
    table = spark.createDataFrame([(w, Decimal(str(p))) for w, p in entries],
                                  "word string, polarity decimal(6,4)")
    rows = [*ROWS, *ROWS[:40], *((None, *r[1:]) for r in ROWS[:40])]
    base = reviews(spark, rows)
    want = Counter((r.Id, r.SentimentScore) for r in sentiment.score(base, dict(entries)).collect())
    assert sum(want.values()) == len(rows)
    for scored in (sentiment.score(base, table), sentiment.score_by_join(base, table)):
        assert Counter((r.Id, r.SentimentScore) for r in scored.collect()) == want
    labelled = sentiment.score_by_join(base, table, ("Id", "ProductId"))
    assert labelled.columns == ["Id", "ProductId", "SentimentScore", "Sentiment", "ExpectedSentiment"]


def test_a_lexicon_too_large_for_the_plan_gives_the_same(spark, monkeypatch):
    """As a mapping or a table, with the same columns, so that all marts can be built on it."""
    rows = [*ROWS[:60], *ROWS[:10], *((None, *r[1:]) for r in ROWS[:10])]
    base = reviews(spark, rows)
    table = spark.createDataFrame([(w, str(p)) for w, p in LEXICON.items()], "word string, polarity string")
    plain = sentiment.score(base, LEXICON)
    want = Counter(map(str, plain.collect()))
    monkeypatch.setattr(sentiment, "LEXICON_BYTES", 10)
    for lexicon in (LEXICON, table):
        joined = sentiment.score(base, lexicon)
        assert joined.columns == plain.columns and Counter(map(str, joined.collect())) == want
    assert len(answer_table(Marts.build(joined)).collect()) == 25
    with pytest.raises(ValueError):
        sentiment.score(base, LEXICON | {"x": 2})


def test_a_word_with_two_values_is_refused(spark):
    table = spark.createDataFrame([("fine", "0.8"), ("fine", "0.2")], "word string, polarity string")
    with pytest.raises(ValueError, match="two polarities"):
        sentiment.score(reviews(spark, ROWS), table)
    with pytest.raises(Exception, match="two polarities"):
        sentiment.score_by_join(reviews(spark, ROWS), table).collect()


def test_large_lexicon_lookup(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [a + b + c for a in letters for b in letters for c in letters[:5]][:3000]
    words = {name: (i % 201 - 100) / 100 for i, name in enumerate(names)}
    texts = random.Random(3).choices(list(words), k=40)
    rows = [(i, "a", 3, 0, "", w) for i, w in enumerate(texts)]
    got = {r.Id: r.SentimentScore for r in sentiment.score(reviews(spark, rows), words).collect()}
    assert got == {i: words[w] for i, w in enumerate(texts)}


def test_bad_polarity_is_refused(spark):
    for bad in (1.5, 0.1234567):
        with pytest.raises(ValueError):
            sentiment.score(reviews(spark, ROWS[:1]), {"x": bad})


def test_empty_lexicon(spark):
    got = sentiment.score(reviews(spark, ROWS[:5]), {}).select("Sentiment").distinct().collect()
    assert [r[0] for r in got] == ["Neutral"]


def test_result_does_not_depend_on_partitions(spark):
    base = reviews(spark, ROWS)
    results = []
    for n in (1, 8):
        s = sentiment.score(base.repartition(n), LEXICON)
        results.append((sorted(map(str, metrics.kpi(metrics.class_cube(s)).collect())),
                        keywords.top_keywords(s, v.NEGATIVE).collect()))
    assert results[0] == results[1]


def brute_top(rows, n, name=None):
    counter = Counter()  # insertion order breaks ties
    for r in sorted(rows):
        if name is None or label(polarity(r[5])) == name:
            counter.update(w for w in r[5].split()
                           if len(w) > 3 and w not in keywords.STOP_WORDS)
    return counter.most_common(n)


@pytest.mark.parametrize("name", [None, "Positive", "Negative", "Neutral"])
def test_top_keywords(scored, name):
    got = keywords.top_keywords(scored, name).orderBy("rank").collect()
    assert [(r.word, r.mentions) for r in got] == brute_top(ROWS, 8, name)
    assert {r.total for r in got} == {len(ROWS)}


def test_top_words_of_stored_counts(scored):
    counts = keywords.keyword_counts(scored)
    tops = keywords.top_words_by_class(counts).orderBy("rank").collect()
    for name in v.CLASSES:
        assert [(r.word, r.mentions) for r in tops if r.Sentiment == name] == brute_top(
            ROWS, 8, name)
    overall = keywords.top_words(keywords.over_all_classes(counts)).orderBy("rank").collect()
    assert [(r.word, r.mentions) for r in overall] == brute_top(ROWS, 8)


def test_keyword_ties_keep_first_seen_order(spark):
    rows = [(2, "a", 1, 0, "", "zebra apple"), (1, "a", 1, 0, "", "mango zebra apple mango"),
            (-5, "a", 1, 0, "", "quince")]
    base = sentiment.with_clean_text(reviews(spark, rows).repartition(3))
    got = [r.word for r in keywords.top_keywords(base).orderBy("rank").collect()]
    assert got == ["mango", "zebra", "apple", "quince"]


def test_keyword_ties_of_repeated_and_missing_ids(spark):
    """One list however the rows are dealt out: first occurrence, then the word."""
    names = [f"word{a}{b}" for a in "qxcmzb" for b in "pkd"]
    words = random.Random(8).sample(names, len(names))
    letters = str.maketrans("0123456789", "abcdefghij")
    for ids in ([7] * len(words), [None] * len(words), [None, 3, 3] * 6):
        rows = [(i, "a", 1, month(0), "", f"awful {w}") for i, w in zip(ids, words, strict=True)]
        rows += [(i, "a", 1, month(0), "", f"well {w}".translate(letters)) for i, w in zip(ids, words, strict=True)]
        found, known = set(), {i: [] for i in (3, 7, None)}
        for i, w in zip(ids, words, strict=True):
            known[i].append(w)
        for parts in (1, 8):
            scored = sentiment.score(reviews(spark, rows).repartition(parts), LEXICON)
            lists = [keywords.top_keywords(scored, n) for n in (None, "Negative")]
            lists.append(keywords.top_words(keywords.over_all_classes(keywords.keyword_counts(scored))))
            found.add(tuple(tuple(r.word for r in x.orderBy("rank").collect()) for x in lists))
        assert len(found) == 1
        (tied,) = found
        want = sorted(known[3]) + sorted(known[7]) + sorted(known[None])
        assert [w for w in tied[1] if w in want] == [w for w in want if w in tied[1]]


def test_stop_words_as_table(spark, scored):
    table = keywords.stop_word_table(spark, ["bread"])
    listed = keywords.keyword_counts(scored, keywords.STOP_WORDS | {"bread"})
    joined = keywords.keyword_counts(scored, table)
    joined = joined.select(listed.columns)
    assert sorted(map(str, listed.collect())) == sorted(map(str, joined.collect()))
    got = keywords.top_keywords(scored, stop_words=table).collect()
    assert "bread" not in {r.word for r in got} and got[0].total == len(ROWS)


def test_stop_words_hold_what_is_left_of_contractions():
    assert {"didn", "doesn", "wasn", "amazon", "good"} <= keywords.STOP_WORDS
    assert not any("'" in w for w in keywords.STOP_WORDS)


def test_impact_is_case_insensitive_with_default(spark):
    top = spark.createDataFrame([(1, "stale", 4), (2, "bread", 2)],
                                "rank int, word string, mentions bigint")
    table = impact.impact_table(spark, {"STALE": "old"})
    got = impact.insight_lines(top, table, F.lit(8)).collect()
    assert got[0].line == "'stale': 4 mentions (50.0% of all reviews) - old"
    assert got[1].impact.startswith("Raised in 2 negative reviews (25.0%")


def test_counts_add_up(scored):
    k = metrics.kpi(metrics.class_cube(scored)).first()
    assert k.total == len(ROWS) == k.positive + k.negative + k.neutral
    assert k.avg_rating == pytest.approx(np.mean([r[2] for r in ROWS]))
    counts = Counter(r[2] for r in ROWS)
    assert k.mode_rating == min(s for s in counts if counts[s] == max(counts.values()))


def test_mode_takes_the_smallest_on_a_tie(spark):
    rows = [(i, "a", s, 0, "", "") for i, s in enumerate([5, 5, 1, 1, 3])]
    s = sentiment.score(reviews(spark, rows), LEXICON)
    assert metrics.kpi(metrics.class_cube(s)).first().mode_rating == 1


def test_absent_stars_and_classes_are_zero(spark):
    rows = [(i, "a", 5, month(0), "", "fine") for i in range(4)]
    cube = metrics.class_cube(sentiment.score(reviews(spark, rows), LEXICON))
    assert [r.n for r in metrics.star_breakdown(cube).collect()] == [0, 0, 0, 0, 4]
    k = metrics.kpi(cube).first()
    assert (k.positive, k.negative, k.neutral, k.csat) == (4, 0, 0, 100.0)
    assert [r.Sentiment for r in metrics.sentiment_distribution(cube).collect()] == ["Positive"]
    by_class = trend.monthly_by_class(cube).first()
    assert (by_class.Positive, by_class.Negative, by_class.Neutral) == (4, 0, 0)


def monthly_rows(shares, gap=()):
    """Ten reviews per month, ``share`` of them negative; months in ``gap`` left out."""
    rows, m = [], 0
    for share in shares:
        while m in gap:
            m += 1
        rows += [(len(rows) + i, "a", 3, month(m), "", "awful" if i < share else "fine")
                 for i in range(10)]
        m += 1
    return rows


def monthly_of(spark, rows):
    scored = sentiment.score(reviews(spark, rows), LEXICON)
    return trend.monthly_negative(metrics.class_cube(scored))


def test_no_forecast_for_three_months(spark):
    monthly = monthly_of(spark, monthly_rows([1, 2, 3]))
    assert trend.forecast(trend.trend_fit(monthly)).count() == 0


def test_forecast_counts_observed_months_and_labels_calendar_months(spark):
    shares = [1, 4, 2, 5, 6]
    monthly = monthly_of(spark, monthly_rows(shares, gap={2}))
    slope, start = np.polyfit(range(5), [s * 10.0 for s in shares], 1)
    fit = trend.trend_fit(monthly).first()
    assert fit.slope == pytest.approx(slope) and fit.direction == "Rising"
    got = trend.forecast(trend.trend_fit(monthly)).collect()
    want = [round(float(min(100, max(0, slope * (4 + i) + start))), 1) for i in (1, 2, 3)]
    assert [r.neg_pct for r in got] == pytest.approx(want)
    assert [r.label for r in got] == ["2012-07", "2012-08", "2012-09"]


def test_forecast_stays_within_bounds(spark):
    up = trend.forecast(trend.trend_fit(monthly_of(spark, monthly_rows([1, 5, 9, 10]))))
    assert [r.neg_pct for r in up.collect()] == [100.0, 100.0, 100.0]
    assert [r.neg_pct for r in trend.scenarios(up).collect()] == [97.0, 100.0, 100.0]
    down = trend.forecast(trend.trend_fit(monthly_of(spark, monthly_rows([9, 5, 1, 0]))))
    assert [r.neg_pct for r in trend.scenarios(down).collect()] == [0.0, 0.0, 5.0]


def test_first_month_wins_ties_and_spikes_are_strict(spark):
    monthly = monthly_of(spark, monthly_rows([2, 5, 5, 1, 1]))
    s = trend.trend_summary(monthly).first()
    assert (str(s.worst_month), str(s.best_month)) == ("2012-02-01", "2012-04-01")
    assert [str(r.month) for r in trend.spike_months(monthly).collect()] == [
        "2012-02-01", "2012-03-01"]


def test_trend_chart_keeps_units_apart(spark):
    cube = metrics.class_cube(sentiment.score(reviews(spark, monthly_rows([1, 2, 3, 4])), LEXICON))
    got = trend_chart(cube).collect()
    line = sorted((str(r.point_date), r.value) for r in got if r.series == "Forecast")
    assert line == [("2012-04-01", 40.0), ("2012-05-31", 50.0), ("2012-06-30", 60.0),
                    ("2012-07-31", 70.0)]
    assert {r.unit for r in got if r.series != "Forecast"} == {"reviews"}


def test_products_match_per_product_scans(scored):
    stats = products.product_stats(scored)
    by = {}
    for r in ROWS:
        if r[1]:
            by.setdefault(r[1], []).append(r)
    top = products.top_products(stats).collect()
    want = sorted(by, key=lambda p: (-len(by[p]), p))[:5]
    assert [r.ProductId for r in top] == want
    for r in top:
        rows = by[r.ProductId]
        assert r.reviews == len(rows)
        assert r.avg_rating == pytest.approx(np.mean([x[2] for x in rows]))
        good = sum(label(polarity(x[5])) == "Positive" for x in rows)
        assert r.positive_pct == good / len(rows) * 100
    worst = products.complained_products(stats).collect()
    bad = {p: sum(label(polarity(x[5])) == "Negative" for x in by[p]) for p in by}
    assert [r.ProductId for r in worst] == sorted(by, key=lambda p: (-bad[p], p))[:3]


def test_sample_is_exact_and_repeatable(spark):
    df = reviews(spark, ROWS)
    for n in (1, 10, 299, 300, 1000):
        ids = [r.Id for r in sample_rows(df, n).collect()]
        assert len(ids) == len(set(ids)) == min(n, len(ROWS))
        assert sorted(ids) == sorted(r.Id for r in sample_rows(df.repartition(5), n).collect())
    assert {r.Id for r in sample_rows(df, 50, 1).collect()} != {
        r.Id for r in sample_rows(df, 50, 2).collect()}


def test_sample_keeps_rows_without_id(spark):
    df = spark.createDataFrame([(None, "x")] * 3 + [(1, "y")], "Id bigint, Text string")
    assert sample_rows(df, 10).count() == 4 and sample_rows(df, 2).count() == 2


def test_a_large_sample_stays_spread_out(spark):
    df = spark.createDataFrame(make(5000), SCHEMA).repartition(8)
    plan = sample_rows(df, 4000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan
    assert sum(1 for p in sample_rows(df, 4000).rdd.glom().collect() if p) > 4


def test_a_keyword_listed_twice_gives_one_line(spark):
    top = spark.createDataFrame([(1, "stale", 4)], "rank int, word string, mentions bigint")
    table = spark.createDataFrame([("stale", "b"), ("STALE", "a")], "keyword string, impact string")
    got = impact.insight_lines(top, table, F.lit(8)).collect()
    assert [r.impact for r in got] == ["a"]


def test_quotes_meet_their_condition(spark):
    df = reviews(spark, ROWS)
    got = sample_quotes(df, F.col("Score") == 2).collect()
    assert [r.ord for r in got] == [1, 2, 3] and {r.Score for r in got} == {2}
    assert sample_quotes(df, F.col("Score") == 9).count() == 0
    assert sample_quotes(df, F.col("Id") == 7).count() == 1


def test_empty_input(spark):
    scored = sentiment.score(reviews(spark, []), LEXICON)
    marts = Marts.build(scored, store=False)
    k = metrics.kpi(marts.cube).first()
    assert k.total == 0 and k.positive_pct is None and k.avg_rating is None
    assert marts.forecast.count() == 0 and marts.complaints.count() == 0
    answers = {r.intent: r.answer for r in answer_table(marts).collect()}
    assert len(answers) == 25 and all(a is not None for a in answers.values())
    assert answers[15] == answer_texts.NO_FORECAST


def test_optional_columns(spark):
    base = reviews(spark, ROWS, ["Id", "Score", "Text"])
    marts = Marts.build(sentiment.score(base, LEXICON))
    answers = {r.intent: r.answer for r in answer_table(marts).collect()}
    assert answers[11] == answer_texts.NO_TIME
    assert answers[12] == answers[13] == answer_texts.NO_PRODUCTS
    assert answers[21] == answer_texts.NO_YEARS
    assert answers[2].endswith("Examples:\n")
    assert report(marts).where("section = 'forecast'").count() == 0


def test_rows_without_time_count_but_have_no_month(spark):
    rows = [*monthly_rows([1, 2]), (900, "a", 3, None, "", "fine")]
    cube = metrics.class_cube(sentiment.score(reviews(spark, rows), LEXICON))
    assert metrics.kpi(cube).first().total == 21
    assert trend.monthly_negative(cube).agg(F.sum("reviews")).first()[0] == 20
    assert [r.reviews for r in metrics.yearly(cube).collect()] == [20]


def test_hot_key(spark):
    """A product and a word with a third of everything give whole results."""
    rows = [(i, "hot" if i % 3 == 0 else f"p{i % 50}", 1 + i % 5, month(i % 6), "",
             "bread " * 5 + f"word{chr(97 + i % 26)}" + " awful") for i in range(3000)]
    scored = sentiment.score(reviews(spark, rows), LEXICON)
    top = products.top_products(products.product_stats(scored)).first()
    assert (top.ProductId, top.reviews) == ("hot", 1000)
    first = keywords.top_keywords(scored, v.NEGATIVE).orderBy("rank").first()
    assert (first.word, first.mentions, first.total) == ("bread", 15000, 3000)


def test_batch_writes_every_table(spark, tmp_path):
    raw = spark.createDataFrame(ROWS, SCHEMA)
    run(raw, LEXICON, str(tmp_path / "out"), sample_size=200)
    written = {p.name for p in (tmp_path / "out").iterdir()}
    assert {"report", "answers", "kpi_cards", "sentiment_trend", "top_products",
            "complaint_impact", "yearly_sentiment", "scenarios"} <= written
    cards = spark.read.parquet(str(tmp_path / "out" / "kpi_cards"))
    assert cards.where("ord = 1").first().value == 200.0
