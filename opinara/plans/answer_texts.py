"""Answer templates, in our own words; ``{name}`` is a column of the figures row."""

TEMPLATES = {
    1: """Overall sentiment over {total} reviews:
  Positive: {pos}
  Negative: {neg}
  Neutral: {neu}
  Satisfaction: {csat_level}
  At risk: {neg_count} unhappy reviewers
  Average rating: {rating}/5, {industry} the industry average of 3.5""",
    2: """Positive reviews: {pos}
  Satisfied buyers tend to come back and recommend.
  Examples:
{quotes_pos}""",
    3: """Negative reviews: {neg}
  Winning a lost buyer back costs far more than keeping one.
  Examples:
{quotes_neg}""",
    4: """Neutral reviews: {neu}
  Undecided buyers; small improvements can win them.""",
    5: """5-star reviews: {five_star}
  Use them in marketing.
  Examples:
{quotes_top}""",
    6: """1-star reviews: {one_star}
  The most visible ones; reply to them publicly.
  Examples:
{quotes_low}""",
    7: """Top complaints:
{complaint_lines}
  Negative reviews: {neg}
  Priority: {urgency}""",
    8: """What customers praise:
{praise_lines}
  Put '{first_praise}' first in ads and descriptions.""",
    9: """Star ratings:
  Average: {rating} of 5
  Most common: {mode} stars
{star_lines}
  5-star share: {five_pct}%
  1-star share: {one_pct}%""",
    10: """Average rating: {rating} of 5
  Most common: {mode} stars
  Based on: {total} reviews
  {rating_benchmark} the 4.0 benchmark. {rating_advice}""",
    11: """{trend}""",
    12: """{most_reviewed}""",
    13: """{most_complained}""",
    14: """Customer satisfaction (CSAT): {csat}%
  Average rating: {rating}/5
  Level: {csat_level}
  Benchmark of 70%: {csat_benchmark}""",
    15: """{scenarios}""",
    16: """Why the complaints matter:
{complaint_lines}
  Negative share {neg_pct}%: {urgency_note}
  Average rating {rating}/5 {retention}""",
    17: """Recommendations, priority {urgency}:
  1. Fix: {complaint_list}
  2. Promote: {praise_list}
  3. Monitor: months with more than 20% negative reviews
  4. Engage: answer every 1-star review{outlook}""",
    18: """Dataset: {total} reviews
  Positive: {pos}
  Negative: {neg}
  Neutral: {neu}
  Average rating: {rating}/5""",
    19: """Model: lexicon polarity from -1 to 1
  Agreement with the stars: {agreement}%
  Positive above 0.1, Negative below -0.1, Neutral between
  Sarcasm and context are not understood.""",
    20: """Most common words:
{common_lines}""",
    21: """{years}""",
    22: """Review length:
{lengths}
  Longest: {longest}""",
    23: """Review analytics over {total} customer reviews: sentiment, complaints and their impact, trends, forecasts and products.
  Ask for help to see every topic.""",
    24: """You can ask about:
  overall sentiment; positive, negative and neutral reviews; satisfaction (CSAT)
  highest and lowest rated reviews; complaints; praise; common words
  average rating and star breakdown
  trend over time, forecast and scenarios, year by year
  most reviewed and most complained products
  business impact, recommendations, model accuracy, review length""",
    25: """No topic was recognised. Name one, such as sentiment, complaints, forecast,
impact or recommendations, or ask for help to see them all.""",
}

QUOTE = '  {stars} "{summary}"'
STAR = "  {stars} {star}-star: {n} ({pct}%)"
COMPLAINT = "  {line}"
PRAISE = "  {rank}. '{word}' - {mentions} mentions ({pct}%)"
COMMON_WORD = "  {rank}. '{word}' - {mentions} times ({pct}%)"
PRODUCT = "  {rank}. {product}: {reviews} reviews, {rating} stars, {pct}% positive"
COMPLAINED_PRODUCT = (
    "  {rank}. {product}: {negative} negative reviews, {rating} stars;"
    " check its quality and description"
)
YEAR = "  {year}: {reviews} reviews, {rating} stars, {pos}% positive, {neg}% negative"
LENGTHS = """  Average: {average} words
  Under 20 words: {short}
  Over 100 words: {long}"""
LONGEST = "{words} words (rated {score})"

TREND = """Sentiment trend:
  Data range: {first} to {last}
  Worst month: {worst}
  Best month: {best}"""
FORECAST_STEP = "    {label}: {pct}% negative, risk {risk}"
TREND_OUTLOOK = """
  Direction: {direction}
  Forecast:
{steps}
  Advice: {advice}"""
FORECAST = """Forecast, direction {direction}:
{steps}"""
SCENARIO = "    {scenario}: {pct}%"
SCENARIOS = """
  Scenarios:
{cases}
  Action: {action}"""
OUTLOOK = "\n  5. Outlook: the negative trend is {direction}, {note}."

NO_TIME = "The reviews carry no time, so there is no trend."
NO_YEARS = "The reviews carry no time, so there are no years."
NO_PRODUCTS = "The reviews name no products."
NO_FORECAST = "A forecast needs at least four months of reviews."
