"""DuckDB SQL for the registered queries, on the same parquet tables.

The SQL restates each result from the definitions; it shares only the fixed values and
the answer templates with the Spark code.
"""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from opinara import fixed_values as v
from opinara.plans import answer_texts as t


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(x):
        return text(x) if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def filled(template: str, **columns: str) -> str:
    """SQL text expression for a template; a name not passed is a column."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(text(literal))
        if name:
            parts.append(f"CAST({columns.get(name, name)} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def f1(x: str) -> str:
    return f"printf('%.1f', {x})"


def grouped(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def lines(order: str, line: str) -> str:
    return f"string_agg({line}, chr(10) ORDER BY {order})"


CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '<.*?>', ' ', 'g'),"
    " '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)
WORDS_OF = (
    "len(list_filter(regexp_split_to_array(Text,"
    " '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+'), lambda x: x <> ''))"
)


# Phrases of an intent that a phrase of an earlier intent, or a shorter one, decides.
OVERRIDDEN = (
    "what are complaints", "what do customers love", "what is praised", "top praise",
    "lowest review product", "lowest rated product", "product complaints", "predict", "forecast",
    "future", "next month", "projection", "predictive", "business impact", "why does it matter",
    "what is the impact", "why important", "how to improve", "areas to improve",
    "improvement areas", "key actions", "model accuracy", "year by year", "yearly breakdown",
)


def trigger_questions() -> list[tuple[str, str]]:
    """A question for each trigger phrase, in odd case and spacing."""
    return [(f"trigger:{i}:{k}", f" {p.upper()}? ")
            for i, ps in v.TRIGGERS.items() for k, p in enumerate(ps)]


def overridden_questions() -> list[tuple[str, str]]:
    return [(f"overridden:{k}", f"{p.capitalize()}?") for k, p in enumerate(OVERRIDDEN)]


def build(lexicon: Mapping[str, str], impacts: Mapping[str, str]) -> dict[str, str]:
    lex = values([(w, float(p)) for w, p in lexicon.items()])
    stop = "(" + ", ".join(
        text(w) for w in (*v.ENGLISH_STOP_WORDS, *v.DOMAIN_STOP_WORDS)) + ")"
    impact = values(impacts.items())
    base = f"""WITH reviews AS (
  SELECT doc_id AS Id, source AS ProductId, CAST(1 + n_chars % 5 AS INTEGER) AS Score,
    1325376000 + (doc_id % 720) * 86400 AS Time,
    concat_ws(' ', source, lang, doc_id) AS Summary,
    text AS Text
  FROM documents),
dated AS (
  SELECT *, make_timestamp(Time * 1000000) AS "Date",
    CAST(date_trunc('month', make_timestamp(Time * 1000000)) AS DATE) AS YearMonth
  FROM reviews WHERE Text IS NOT NULL AND Score IS NOT NULL),
cleaned AS (SELECT *, {CLEAN.format(c="Text")} AS CleanText FROM dated),
tokens AS (
  SELECT Id, unnest(string_split(CleanText, ' ')) AS word,
    generate_subscripts(string_split(CleanText, ' '), 1) AS pos FROM cleaned),
hits AS (
  SELECT Id, sum(CAST(polarity AS DECIMAL(4,2))) AS p, count(*) AS n
  FROM tokens JOIN {lex} AS lex(lex_word, polarity) ON word = lex_word GROUP BY Id),
polar AS (
  SELECT c.*, coalesce(CAST(p AS DOUBLE) / n, 0.0) AS SentimentScore
  FROM cleaned c LEFT JOIN hits h ON c.Id = h.Id),
scored AS (
  SELECT *, CASE WHEN SentimentScore > 0.1 THEN 'Positive'
      WHEN SentimentScore < -0.1 THEN 'Negative' ELSE 'Neutral' END AS Sentiment,
    CASE WHEN Score >= 4 THEN 'Positive' WHEN Score <= 2 THEN 'Negative'
      ELSE 'Neutral' END AS ExpectedSentiment
  FROM polar),
totals AS (SELECT count(*) AS total FROM scored),
keywords AS (
  SELECT s.Sentiment, w.Id, w.word, w.pos FROM tokens w JOIN scored s ON w.Id = s.Id
  WHERE length(w.word) > 3 AND w.word NOT IN {stop}),
class_words AS (
  SELECT Sentiment, word, count(*) AS mentions, 
    min(CAST(coalesce(Id, 9223372036854775808) AS HUGEINT) * 2147483648 + pos) AS first
  FROM keywords GROUP BY ALL),
all_words AS (
  SELECT word, sum(mentions) AS mentions, min(first) AS first FROM class_words GROUP BY ALL),
ranked AS (
  SELECT Sentiment, word, mentions, CAST(row_number() OVER (
    PARTITION BY Sentiment ORDER BY mentions DESC, first, word) AS INTEGER) AS rank
  FROM class_words),
complaints AS (SELECT rank, word, mentions FROM ranked
  WHERE Sentiment = 'Negative' AND rank <= 8),
praise AS (SELECT rank, word, mentions FROM ranked
  WHERE Sentiment = 'Positive' AND rank <= 8),
common AS (
  SELECT CAST(row_number() OVER (ORDER BY mentions DESC, first, word) AS INTEGER) AS rank,
    word, CAST(mentions AS BIGINT) AS mentions
  FROM all_words ORDER BY mentions DESC, first, word LIMIT 8),
kpi AS (
  SELECT count(*) AS total,
    count(*) FILTER (Sentiment = 'Positive') AS positive,
    count(*) FILTER (Sentiment = 'Negative') AS negative,
    count(*) FILTER (Sentiment = 'Neutral') AS neutral,
    count(*) FILTER (Sentiment = 'Positive') / count(*) * 100 AS positive_pct,
    count(*) FILTER (Sentiment = 'Negative') / count(*) * 100 AS negative_pct,
    count(*) FILTER (Sentiment = 'Neutral') / count(*) * 100 AS neutral_pct,
    avg(Score) AS avg_rating,
    (SELECT Score FROM dated GROUP BY Score ORDER BY count(*) DESC, Score LIMIT 1)
      AS mode_rating,
    count(*) FILTER (Sentiment = 'Positive') / count(*) * 100 AS csat,
    count(*) FILTER (Sentiment = ExpectedSentiment) / count(*) * 100 AS agreement_pct
  FROM scored),
monthly AS (
  SELECT YearMonth AS month, count(*) AS reviews,
    count(*) FILTER (Sentiment = 'Negative') AS negative,
    count(*) FILTER (Sentiment = 'Negative') / count(*) * 100 AS neg_pct,
    CAST(row_number() OVER (ORDER BY YearMonth) - 1 AS INTEGER) AS t
  FROM scored WHERE YearMonth IS NOT NULL GROUP BY YearMonth),
fit AS (
  SELECT *, round_even(slope * 1000, 0) / 1000 AS slope_rounded,
    CASE WHEN slope > 0.1 THEN 'Rising' WHEN slope < -0.1 THEN 'Falling'
      ELSE 'Stable' END AS direction
  FROM (SELECT count(*) AS n_months, regr_slope(neg_pct, t) AS slope,
      regr_intercept(neg_pct, t) AS intercept, max(t) AS last_t, max(month) AS last_month,
      arg_max(neg_pct, t) AS last_neg_pct FROM monthly)
  WHERE n_months >= 4),
ahead AS (
  SELECT step, CAST(last_month + to_months(step) AS DATE) AS month,
    round_even(greatest(0.0, least(100.0, slope * (last_t + step) + intercept)) * 10, 0)
      / 10 AS neg_pct, direction, slope_rounded
  FROM fit, (VALUES (1), (2), (3)) AS steps(step)),
forecast AS (
  SELECT step, month, strftime(month, '%Y-%m') AS label, neg_pct,
    CASE WHEN neg_pct > 20 THEN 'High' WHEN neg_pct > 10 THEN 'Medium' ELSE 'Low' END
      AS risk, direction, slope_rounded,
    CASE WHEN slope_rounded > 0.1 THEN 'Watch closely: the negative share is rising.'
      WHEN slope_rounded < -0.1 THEN 'Improving: keep the present quality.'
      ELSE 'Stable: keep monitoring.' END AS advice
  FROM ahead),
scenarios AS (
  SELECT ord, scenario, CASE ord WHEN 1 THEN greatest(0.0, neg_pct - 3) WHEN 2 THEN neg_pct
      ELSE least(100.0, neg_pct + 5) END AS neg_pct,
    CASE WHEN slope_rounded > 0 THEN 'Step in now to stop the decline.'
      ELSE 'Keep the present course; the trend is improving.' END AS action
  FROM forecast, (VALUES (1, 'best'), (2, 'base'), (3, 'worst')) AS c(ord, scenario)
  WHERE step = 3),
trend_summary AS (
  SELECT min(month) AS first_month, max(month) AS last_month,
    (SELECT month FROM monthly ORDER BY neg_pct DESC, month LIMIT 1) AS worst_month,
    (SELECT month FROM monthly ORDER BY neg_pct, month LIMIT 1) AS best_month,
    count(*) AS n_months FROM monthly),
by_class AS (
  SELECT YearMonth AS month, count(*) FILTER (Sentiment = 'Positive') AS "Positive",
    count(*) FILTER (Sentiment = 'Negative') AS "Negative",
    count(*) FILTER (Sentiment = 'Neutral') AS "Neutral"
  FROM scored WHERE YearMonth IS NOT NULL GROUP BY YearMonth),
yearly AS (
  SELECT CAST(year(YearMonth) AS INTEGER) AS year, count(*) AS reviews,
    avg(Score) AS avg_rating,
    count(*) FILTER (Sentiment = 'Positive') AS positive,
    count(*) FILTER (Sentiment = 'Negative') AS negative,
    count(*) FILTER (Sentiment = 'Positive') / count(*) * 100 AS positive_pct,
    count(*) FILTER (Sentiment = 'Negative') / count(*) * 100 AS negative_pct
  FROM scored WHERE YearMonth IS NOT NULL GROUP BY 1),
stars AS (
  SELECT star, count(Score) AS n, count(Score) / (SELECT total FROM totals) * 100 AS pct
  FROM (VALUES (1), (2), (3), (4), (5)) AS s(star) LEFT JOIN dated ON Score = star
  GROUP BY star),
products AS (
  SELECT ProductId, count(*) AS reviews,
    count(*) FILTER (Sentiment = 'Positive') AS positive,
    count(*) FILTER (Sentiment = 'Negative') AS negative, avg(Score) AS avg_rating
  FROM scored WHERE ProductId IS NOT NULL GROUP BY ProductId),
top_products AS (
  SELECT CAST(row_number() OVER (ORDER BY reviews DESC, ProductId) AS INTEGER) AS rank,
    ProductId, reviews, avg_rating, positive / reviews * 100 AS positive_pct
  FROM products ORDER BY reviews DESC, ProductId LIMIT 5),
complained AS (
  SELECT CAST(row_number() OVER (ORDER BY negative DESC, ProductId) AS INTEGER) AS rank,
    ProductId, negative, avg_rating
  FROM products WHERE negative > 0 ORDER BY negative DESC, ProductId LIMIT 3),
lengths AS (SELECT Id, Score, CAST({WORDS_OF} AS INTEGER) AS ReviewLen FROM dated),
length_stats AS (
  SELECT avg(ReviewLen) AS avg_words, count(*) FILTER (ReviewLen < 20) AS short_reviews,
    count(*) FILTER (ReviewLen > 100) AS long_reviews FROM lengths),
longest AS (SELECT Id, Score, ReviewLen FROM lengths ORDER BY ReviewLen DESC, Id LIMIT 1),
quotes AS (
  SELECT *, row_number() OVER (PARTITION BY Sentiment ORDER BY md5('1:' || Id), Id) AS by_class,
    row_number() OVER (PARTITION BY Score ORDER BY md5('1:' || Id), Id) AS by_star
  FROM scored),
insights AS (
  SELECT rank, word, mentions, CAST({f1("mentions / total * 100")} AS DOUBLE) AS pct,
    coalesce(impact, 'Raised in ' || mentions || ' negative reviews ('
      || {f1("mentions / total * 100")} || '% of all reviews); look into it soon.') AS impact
  FROM complaints CROSS JOIN totals LEFT JOIN {impact} AS i(keyword, impact)
    ON lower(word) = lower(keyword)
  WHERE rank <= 5),
insight_lines AS (
  SELECT *, '''' || word || ''': ' || mentions || ' mentions (' || {f1("pct")}
    || '% of all reviews) - ' || impact AS line FROM insights)
"""

    phrases = [(i, p) for i, ps in v.TRIGGERS.items() for p in ps]
    canned_rows = [(f"canned:{i}", q) for i, q in enumerate(v.CANNED_QUESTIONS, 1)]
    names = values(list(enumerate(v.INTENTS, 1)))

    def routed(questions: str) -> str:
        return f"""routed AS (
  SELECT question_id, question, CAST(coalesce(min(intent), 25) AS INTEGER) AS intent
  FROM ({questions}) LEFT JOIN {values(phrases)} AS p(intent, phrase)
    ON contains(lower(question), phrase)
  GROUP BY question_id, question),
named AS (SELECT r.*, name AS intent_name FROM routed r
  JOIN {names} AS n(number, name) ON r.intent = n.number)
"""

    turns = (
        "SELECT conv_id || ':' || turn AS question_id, text AS question FROM conversations"
        " WHERE role = 'user'"
    )
    asked = turns + " UNION ALL SELECT q, s FROM " + values(
        [*canned_rows, *trigger_questions(), *overridden_questions()]) + " AS q(q, s)"
    canned = "SELECT CAST(q AS BIGINT) AS question_id, s AS question FROM " + values(
        list(enumerate(v.CANNED_QUESTIONS, 1))) + " AS q(q, s)"

    def quote(where: str) -> str:
        line = filled(t.QUOTE, stars="repeat('⭐', Score)", summary="Summary")
        order = "by_class" if "Sentiment" in where else "by_star"
        return f"(SELECT {lines(order, line)} FROM quotes WHERE {where} AND {order} <= 3)"

    def word_lines(table: str, n: int, template: str) -> str:
        line = filled(template, pct=f1("mentions / total * 100"))
        return f"(SELECT {lines('rank', line)} FROM {table}, totals WHERE rank <= {n})"

    def word_list(table: str, n: int) -> str:
        return f"(SELECT string_agg(word, ', ' ORDER BY rank) FROM {table} WHERE rank <= {n})"

    def month(c: str) -> str:
        return f"strftime({c}, '%Y-%m')"

    def count_share(c: str) -> str:
        return f"{grouped(c)} || ' (' || {f1(c + '_pct')} || '%)'"

    def star(n: int, template: str) -> str:
        return (f"(SELECT {filled(template, n=grouped('n'), pct=f1('pct'))} FROM stars"
                f" WHERE star = {n})")

    step = filled(t.FORECAST_STEP, pct=f1("neg_pct"))
    steps = f"(SELECT {lines('step', step)} FROM forecast)"
    cases = f"(SELECT {lines('ord', filled(t.SCENARIO, pct=f1('neg_pct')))} FROM scenarios)"
    trend_text = "(SELECT " + filled(
        t.TREND, first=month("first_month"), last=month("last_month"),
        worst=month("worst_month"), best=month("best_month")) + " FROM trend_summary)"
    outlook = "(SELECT " + filled(t.TREND_OUTLOOK, steps=steps) + " FROM forecast WHERE step = 1)"
    first_forecast = "(SELECT " + filled(t.FORECAST, steps=steps) + " FROM forecast WHERE step = 1)"
    all_cases = "(SELECT " + filled(t.SCENARIOS, cases=cases) + " FROM scenarios WHERE ord = 1)"
    note = ("CASE WHEN slope_rounded > 0.1 THEN 'act before it gets worse'"
            " ELSE 'the course is improving' END")
    advice_line = ("(SELECT " + filled(t.OUTLOOK, direction="lower(direction)", note=note)
                   + " FROM fit)")
    product = filled(t.PRODUCT, product="ProductId", rating=f1("avg_rating"),
                     pct="printf('%.0f', positive_pct)")
    complained = filled(t.COMPLAINED_PRODUCT, product="ProductId", rating=f1("avg_rating"))
    year = filled(t.YEAR, rating=f1("avg_rating"), pos=f1("positive_pct"),
                  neg=f1("negative_pct"))
    star_line = filled(t.STAR, stars="repeat('⭐', star)", n=grouped("n"), pct=f1("pct"))
    length_text = filled(t.LENGTHS, average="printf('%.0f', avg_words)",
                         short=grouped("short_reviews"), long=grouped("long_reviews"))

    csat_level = ("CASE WHEN csat > 75 THEN 'Excellent' WHEN csat > 60 THEN 'Good'"
                  " ELSE 'Needs Improvement' END")
    csat_benchmark = "CASE WHEN csat >= 70 THEN 'above benchmark' ELSE 'below benchmark' END"
    industry = "CASE WHEN avg_rating > 3.5 THEN 'above' ELSE 'below' END"
    benchmark = "CASE WHEN avg_rating >= 4 THEN 'Above' ELSE 'Below' END"
    advice = ("CASE WHEN avg_rating >= 4 THEN 'Protect this score by holding quality steady.'"
              " ELSE 'Raise it by working through the top complaints.' END")
    urgency = ("CASE WHEN negative_pct > 30 THEN 'HIGH' WHEN negative_pct > 15 THEN 'MODERATE'"
               " ELSE 'LOW' END")
    urgency_note = ("CASE WHEN negative_pct > 30 THEN 'act at once' WHEN negative_pct > 15"
                    " THEN 'moderate risk, watch closely'"
                    " ELSE 'low risk, the brand is seen well' END")

    figures = {
        "total": grouped("total"), "pos": count_share("positive"),
        "neg": count_share("negative"), "neu": count_share("neutral"),
        "neg_count": grouped("negative"), "neg_pct": f1("negative_pct"),
        "rating": "printf('%.2f', avg_rating)", "mode": "mode_rating",
        "csat": f1("csat"), "agreement": f1("agreement_pct"), "csat_level": csat_level,
        "csat_benchmark": csat_benchmark, "industry": industry,
        "rating_benchmark": benchmark, "rating_advice": advice,
        "retention": "CASE WHEN avg_rating >= 4 THEN 'helps keep customers'"
                     " ELSE 'has to rise to keep customers' END",
        "urgency": urgency, "urgency_note": urgency_note,
        "quotes_pos": quote("Sentiment = 'Positive'"),
        "quotes_neg": quote("Sentiment = 'Negative'"),
        "quotes_top": quote("Score = 5"), "quotes_low": quote("Score = 1"),
        "five_star": star(5, "{n} ({pct}%)"), "one_star": star(1, "{n} ({pct}%)"),
        "five_pct": star(5, "{pct}"), "one_pct": star(1, "{pct}"),
        "star_lines": f"(SELECT {lines('star', star_line)} FROM stars)",
        "complaint_lines":
            f"(SELECT {lines('rank', filled(t.COMPLAINT))} FROM insight_lines)",
        "complaint_list": word_list("complaints", 3),
        "praise_lines": word_lines("praise", 5, t.PRAISE),
        "praise_list": word_list("praise", 3), "first_praise": word_list("praise", 1),
        "common_lines": word_lines("common", 8, t.COMMON_WORD),
        "trend": f"{trend_text} || coalesce({outlook}, '')",
        "scenarios": f"{first_forecast} || {all_cases}", "outlook": advice_line,
        "most_reviewed": "'Products by number of reviews:' || chr(10) || "
                         f"(SELECT {lines('rank', product)} FROM top_products)",
        "most_complained": "'Products by negative reviews:' || chr(10) || "
                           f"(SELECT {lines('rank', complained)} FROM complained)",
        "years": "'Year by year:' || chr(10) || "
                 f"(SELECT {lines('year', year)} FROM yearly)",
        "lengths": f"(SELECT {length_text} FROM length_stats)",
        "longest": "(SELECT " + filled(t.LONGEST, words="ReviewLen", score="Score")
                   + " FROM longest)",
    }
    figure_row = "figures AS (SELECT " + ", ".join(
        f"{sql} AS f_{name}" for name, sql in figures.items()) + " FROM kpi)"
    named_figures = {name: f"f_{name}" for name in figures}
    answer_rows = "answer_rows AS (" + " UNION ALL ".join(
        f"SELECT {i} AS intent, {filled(template, **named_figures)} AS answer FROM figures"
        for i, template in t.TEMPLATES.items()) + ")"
    answers = f"{base}, {figure_row}, {answer_rows}"
    # Without Time, ProductId and Summary these texts are fixed.
    fixed = {"trend": t.NO_TIME, "scenarios": t.NO_FORECAST, "outlook": "", "years": t.NO_YEARS,
             "most_reviewed": t.NO_PRODUCTS, "most_complained": t.NO_PRODUCTS, "quotes_pos": "",
             "quotes_neg": "", "quotes_top": "", "quotes_low": ""}
    few_figures = named_figures | {name: text(value) for name, value in fixed.items()}
    few_answers = f"{base}, {figure_row} " + " UNION ALL ".join(
        f"SELECT {i} AS intent, {filled(template, **few_figures)} AS answer FROM figures"
        for i, template in t.TEMPLATES.items())
    trend_points = " UNION ALL ".join([
        *(f"SELECT '{c}' AS series, month AS point_date, CAST(\"{c}\" AS DOUBLE) AS value,"
          " 'reviews' AS unit FROM by_class" for c in v.CLASSES),
        "SELECT 'Forecast', last_month, last_neg_pct, 'percent' FROM fit",
        "SELECT 'Forecast', last_day(month), neg_pct, 'percent' FROM forecast"])
    chart_rows = [
        ("sentiment_bars", "Sentiment", "count(*)", "scored GROUP BY Sentiment"),
        ("sentiment_share", "Sentiment", "count(*) / (SELECT total FROM totals) * 100",
         "scored GROUP BY Sentiment"),
        ("sentiment_trend", "concat_ws(' ', series, point_date)", "value", f"({trend_points})"),
        ("star_histogram", "Score", "count(*)", "dated GROUP BY Score"),
        ("complaint_words", "word", "mentions", "complaints"),
        ("praise_words", "word", "mentions", "praise"),
        ("complaint_impact", "word", f1("mentions / total * 100"),
         "complaints, totals WHERE rank <= 6"),
        ("yearly_sentiment", "year", "positive_pct", "yearly")]

    def answered(questions: str) -> str:
        return (f"{answers}, {routed(questions)} SELECT question_id, question, n.intent,"
                " intent_name, answer FROM named n JOIN answer_rows a ON n.intent = a.intent")

    def share_of_star(n: int) -> str:
        return (f"{base} SELECT count(*) FILTER (Score = {n}) AS n, count(*) AS total,"
                f" count(*) FILTER (Score = {n}) / count(*) * 100 AS pct FROM dated")

    def with_share(table: str) -> str:
        return (f"{base} SELECT rank, word, mentions, mentions / total * 100 AS pct"
                f" FROM {table}, totals")

    def cards() -> str:
        rows = [
            (1, "Total Reviews", "CAST(total AS DOUBLE)", grouped("total")),
            (2, "Positive %", "positive_pct", f1("positive_pct") + " || '%'"),
            (3, "Negative %", "negative_pct", f1("negative_pct") + " || '%'"),
            (4, "Avg Rating", "avg_rating", "printf('%.2f', avg_rating) || '/5'"),
            (5, "CSAT Score", "positive_pct", "printf('%.0f', positive_pct) || '%'"),
        ]
        return base + " UNION ALL ".join(
            f"SELECT {i} AS ord, {text(label)} AS label, {value} AS value, {shown} AS shown"
            " FROM kpi" for i, label, value, shown in rows)

    def report() -> str:
        rows = [(1, "Total", grouped("total")), (2, "Positive", count_share("positive")),
                (3, "Negative", count_share("negative")),
                (4, "Neutral", count_share("neutral")),
                (5, "Avg Rating", "printf('%.2f', avg_rating) || '/5'")]
        parts = [f"SELECT 'summary' AS section, {i} AS ord, {text(label)} AS label,"
                 f" {value} AS value FROM kpi" for i, label, value in rows]
        parts += [
            "SELECT 'complaints', rank, word, mentions || 'x - ' || impact FROM insights",
            "SELECT 'praise', rank, word, CAST(mentions AS VARCHAR) FROM praise WHERE rank <= 5",
            f"SELECT 'forecast', step, label, {f1('neg_pct')} || '%' FROM forecast",
        ]
        return base + " UNION ALL ".join(parts)

    scored_columns = "Id, SentimentScore, Sentiment"
    stages = " UNION ALL SELECT "
    sampled = "sampled AS (SELECT * FROM reviews ORDER BY md5('42:' || Id), Id LIMIT 300)"
    complete = "Text IS NOT NULL AND Score IS NOT NULL"
    class_quotes = " UNION ALL ".join(
        f"SELECT CAST(by_class AS INTEGER) AS ord, Id, Score, Summary, Sentiment FROM quotes"
        f" WHERE Sentiment = '{c}' AND by_class <= 3" for c in ("Positive", "Negative"))
    return {
        "load_stats": f"{base} SELECT 'raw' AS stage, count(*) AS n FROM reviews{stages}"
                      f"'sampled', count(*) FROM reviews{stages}'clean', count(*) FROM dated",
        "load_stats_sampled":
            f"{base}, {sampled} SELECT 'raw' AS stage, count(*) AS n FROM reviews{stages}"
            f"'sampled', count(*) FROM sampled{stages}'clean', count(*) FROM sampled"
            f" WHERE {complete}",
        "csv_reviews": f"{base} SELECT Id, ProductId, CAST(Score AS DOUBLE) AS Score, Time, Summary, Text, YearMonth"
                       " FROM dated",
        "reviews_dated": f'{base} SELECT Id, Score, "Date", YearMonth,'
                         ' CAST(year("Date") AS INTEGER) AS "Year",'
                         ' CAST(month("Date") AS INTEGER) AS "Month" FROM dated',
        "sample_fixed_n": f"{base}, {sampled} SELECT Id, ProductId, Score FROM sampled",
        "clean_text": f"{base} SELECT Id, CleanText FROM cleaned",
        "clean_markup": f"SELECT page_id, {CLEAN.format(c='html')} AS CleanText FROM pages",
        "sentiment_scored": f"{base} SELECT {scored_columns}, ExpectedSentiment,"
                            " Sentiment = ExpectedSentiment AS agrees FROM scored",
        "sentiment_joined": f"{base} SELECT {scored_columns} FROM scored",
        "sentiment_plugin": f"{base} SELECT {scored_columns} FROM scored",
        "star_label_agreement":
            f"{base} SELECT count(*) FILTER (Sentiment = ExpectedSentiment) AS agreeing,"
            " count(*) AS total, count(*) FILTER (Sentiment = ExpectedSentiment) / count(*)"
            " * 100 AS agreement_pct FROM scored",
        "sentiment_distribution":
            f"{base} SELECT Sentiment, count(*) AS n,"
            " count(*) / (SELECT total FROM totals) * 100 AS pct FROM scored GROUP BY Sentiment",
        "sentiment_bars": f"{base} SELECT Sentiment, count(*) AS n FROM scored"
                          " GROUP BY Sentiment",
        "kpi": f"{base} SELECT * FROM kpi",
        "kpi_cards": cards(),
        "rating_summary": f"{base} SELECT total, avg_rating, mode_rating, {industry} AS"
                          f" industry_position, {benchmark} AS benchmark, {advice} AS advice"
                          " FROM kpi",
        "star_histogram": f"{base} SELECT Score, count(*) AS n FROM dated GROUP BY Score",
        "star_breakdown": f"{base} SELECT star, n, pct FROM stars",
        "five_star": share_of_star(5),
        "one_star": share_of_star(1),
        "csat": f"{base} SELECT csat, avg_rating, {csat_level} AS level, {csat_benchmark} AS"
                " benchmark FROM kpi",
        "urgency": f"{base} SELECT negative, negative_pct, {urgency} AS priority,"
                   f" {urgency_note} AS note FROM kpi",
        "top_complaints": with_share("complaints"),
        "top_praise": with_share("praise"),
        "common_words": with_share("common"),
        "keyword_table": f"{base} SELECT Sentiment, word, mentions FROM class_words",
        "stop_words_joined": f"{base} SELECT word, CAST(mentions AS BIGINT) AS mentions"
                             " FROM all_words",
        "keyword_lists": f"{base} SELECT 'Negative' AS Sentiment,"
                         f" {word_list('complaints', 3)} AS words UNION ALL SELECT 'Positive',"
                         f" {word_list('praise', 3)}",
        "complaint_impact_pct":
            f"{base} SELECT rank, word, mentions,"
            f" CAST({f1('mentions / total * 100')} AS DOUBLE) AS pct"
            " FROM complaints, totals WHERE rank <= 6",
        "complaint_insights": f"{base} SELECT * FROM insight_lines",
        "monthly_negative": f"{base} SELECT * FROM monthly",
        "monthly_by_class": f"{base} SELECT * FROM by_class",
        "trend_summary": f"{base} SELECT * FROM trend_summary",
        "trend_fit": f"{base} SELECT n_months, slope_rounded, direction, last_t, last_month"
                     " FROM fit",
        "forecast": f"{base} SELECT * FROM forecast",
        "scenarios": f"{base} SELECT * FROM scenarios",
        "spike_months": f"{base} SELECT month, reviews, negative, neg_pct FROM monthly"
                        " WHERE neg_pct > 20",
        "trend_chart": base + trend_points,
        "yearly": f"{base} SELECT * FROM yearly",
        "yearly_bars": f"{base} SELECT year, positive_pct, negative_pct, reviews FROM yearly",
        "top_products": f"{base} SELECT * FROM top_products",
        "complained_products": f"{base} SELECT * FROM complained",
        "review_length": f"{base} SELECT * FROM length_stats",
        "longest_review": f"{base} SELECT * FROM longest",
        "star_quotes": f"{base} SELECT CAST(by_star AS INTEGER) AS ord, Id, Score, Summary,"
                       " repeat('⭐', Score) AS stars FROM quotes"
                       " WHERE Score IN (1, 5) AND by_star <= 3",
        "class_quotes": base + class_quotes,
        "report": report(),
        "route_questions": f"WITH {routed(asked)} SELECT question_id, question, intent,"
                           " intent_name FROM named",
        "answers": answered(asked),
        "answers_without_columns": few_answers,
        "canned_answers": answered(canned),
        "chart_tables": base + " UNION ALL ".join([
            "SELECT 'kpi_cards' AS chart, label, value FROM ("
            + cards().removeprefix(base) + ")",
            *(f"SELECT '{chart}', CAST({label} AS VARCHAR), CAST({value} AS DOUBLE) FROM {rows}"
              for chart, label, value, rows in chart_rows)]),
        "answers_streamed": answered(turns),
    }
