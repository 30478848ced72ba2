"""Values that decide results: class names, bands, word lists, tables.

Everything here is data.  The code that uses it lives in ``functions``,
``operators`` and ``plans``; most callables take these as default parameters
so that a caller can pass their own.
"""

from __future__ import annotations

# --- fixed values: classes and the thresholds around them -------------------

POSITIVE = "Positive"
NEGATIVE = "Negative"
NEUTRAL = "Neutral"
CLASSES = (POSITIVE, NEGATIVE, NEUTRAL)

POLARITY_EDGE = 0.1  # above +edge: Positive; below -edge: Negative
POSITIVE_STARS = 4  # this many stars or more: Positive expected
NEGATIVE_STARS = 2  # this many stars or fewer: Negative expected

# --- fixed values: input columns, null tokens, defaults ---------------------

REVIEW_COLUMNS = ("Id", "ProductId", "Score", "Time", "Summary", "Text")

CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

SAMPLE_SIZE = 10_000
SAMPLE_SEED = 42
QUOTE_SEED = 1
QUOTES_PER_ANSWER = 3

KEYWORDS_PER_LIST = 8
MIN_KEYWORD_LENGTH = 4
IMPACT_BARS = 6
INSIGHT_LINES = 5

MIN_MONTHS_FOR_FORECAST = 4
FORECAST_MONTHS = 3
SPIKE_PCT = 20.0

SHORT_REVIEW_WORDS = 20  # fewer words than this
LONG_REVIEW_WORDS = 100  # more words than this

TOP_PRODUCTS = 5
COMPLAINED_PRODUCTS = 3

# --- fixed values: stop words ------------------------------------------------
# The usual English stop list.  Entries with an apostrophe are left out:
# cleaning turns the apostrophe into a space, so they can never match a token.

ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will
just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn
haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split())

DOMAIN_STOP_WORDS = (
    "like", "would", "also", "even", "product", "one", "get", "got", "much",
    "really", "just", "very", "good", "great", "food", "amazon", "review",
    "bought", "ordered", "time",
)

# --- fixed values: complaint keyword -> business impact ----------------------
# The keys are fixed; the sentences are our own.

IMPACT_BY_KEYWORD = {
    "taste": "Buyers who dislike the taste rate low and rarely come back.",
    "coffee": "Weak coffee quality wears down loyalty to the brand.",
    "flavor": "Uneven flavor makes buyers doubt the next order.",
    "disappointed": "Missed expectations raise returns and bad word of mouth.",
    "chicken": "Defects in this item point at gaps in quality control.",
    "smell": "Odor complaints commonly end in a returned order.",
    "stale": "Stale goods hint at storage, packaging or supply problems.",
    "price": "Price complaints mean buyers see too little value and may not convert.",
    "quality": "Quality complaints weigh on reputation and repeat purchases.",
    "delivery": "Late or failed delivery spoils an otherwise sound purchase.",
    "packaging": "Damaged packaging causes returns and looks careless.",
    "service": "Poor service sends customers to competing sellers.",
    "refund": "Refund requests mark strongly dissatisfied customers about to leave.",
    "wrong": "Wrong items or descriptions cost trust and support time.",
    "broken": "Broken goods show that quality checks are missing damage.",
    "expired": "Expired goods are a safety hazard and a legal exposure.",
}

# --- fixed values: question intents and their trigger phrases ---------------
# Intents are tried in this order; the first one with a phrase contained in the
# question wins.  A phrase that contains another phrase of the same or an
# earlier intent can never decide a question and is not listed.

INTENTS = (
    "overall_sentiment", "positive_reviews", "negative_reviews",
    "neutral_reviews", "highest_rated", "lowest_rated", "top_complaints",
    "praise_themes", "star_breakdown", "average_rating", "trend_and_forecast",
    "most_reviewed_products", "most_complained_products",
    "customer_satisfaction", "forecast_scenarios", "business_impact",
    "recommendations", "dataset_size", "model_accuracy", "common_words",
    "year_by_year", "review_length", "about", "help", "fallback",
)
FALLBACK_INTENT = 25

TRIGGERS = {
    1: ("overall sentiment", "general sentiment", "how is sentiment",
        "sentiment overview", "customer sentiment", "how do customers feel",
        "how are customers", "overall feeling", "general feeling",
        "sentiment summary", "what is sentiment", "what's the sentiment"),
    2: ("how many positive", "number of positive", "positive count",
        "positive reviews", "total positive", "count positive"),
    3: ("how many negative", "number of negative", "negative count",
        "negative reviews", "total negative", "count negative"),
    4: ("how many neutral", "neutral reviews", "neutral count",
        "mixed reviews", "neither positive", "total neutral"),
    5: ("highest rated", "best review", "top review", "5 star", "five star",
        "best rated", "most positive review", "highest rating", "top rated",
        "what are the best"),
    6: ("lowest rated", "worst review", "1 star", "one star", "lowest rating",
        "most negative review", "worst rated", "bad review", "lowest review",
        "what are the worst"),
    7: ("top complaint", "complaints", "issues", "problems",
        "common complaint", "main issue", "what goes wrong",
        "what customers dislike", "what is bad", "pain point",
        "negative feedback", "what do people hate"),
    8: ("customers love", "what customers like", "praise",
        "positive feedback", "customers enjoy", "what is good",
        "what works well", "customers appreciate", "what do people like",
        "what are the positives"),
    9: ("star rating", "rating breakdown", "rating distribution",
        "stars breakdown", "how many stars", "rating summary",
        "score distribution", "review scores", "what are the ratings"),
    10: ("average rating", "avg rating", "mean rating", "average score",
         "average star", "mean score", "what is the rating",
         "overall rating", "what is the average"),
    11: ("trend", "over time", "sentiment change", "how has sentiment",
         "history", "monthly", "yearly", "by year", "by month",
         "time period", "when was", "sentiment over", "change over",
         "forecast", "predict", "future", "next month", "projection"),
    12: ("most reviewed product", "top product", "popular product",
         "which product", "most popular", "best selling", "most reviews",
         "product with most"),
    13: ("least reviewed", "worst product", "product with lowest",
         "bad product", "most complained product"),
    14: ("customer satisfaction", "satisfaction score", "csat",
         "are customers happy", "how satisfied", "happy customers",
         "satisfaction rate", "overall satisfaction"),
    15: ("next period", "what will happen", "will sentiment improve"),
    16: ("why", "impact", "business consequence", "so what",
         "what does it mean"),
    17: ("recommend", "suggestion", "improve", "what should",
         "business advice", "strategy", "action", "what to do",
         "next steps"),
    18: ("total reviews", "total records", "dataset size",
         "how many reviews", "how many records", "dataset info",
         "data size", "how much data", "number of reviews", "how large"),
    19: ("accuracy", "how accurate", "model performance", "precision",
         "textblob", "model info"),
    20: ("most common words", "frequent words", "top words",
         "common keywords", "what words", "word frequency"),
    21: ("year wise", "each year", "reviews per year", "annual",
         "how many per year"),
    22: ("review length", "long review", "short review", "average length",
         "how long", "word count", "detailed review"),
    23: ("what are you", "who are you", "what is this", "about you",
         "what do you do", "tell me about", "this chatbot", "this agent"),
    24: ("help", "what can you", "what can i ask", "capabilities", "options",
         "commands", "questions", "how to use", "guide"),
}

CANNED_QUESTIONS = (
    "Overall sentiment?", "Top complaints?", "What do customers love?",
    "Recommendations?", "Highest rated review?", "Lowest rated review?",
    "Star rating breakdown?", "Customer satisfaction?",
    "Most reviewed product?", "Lowest review product?",
    "Predictive forecast?", "Why do complaints matter?",
)
