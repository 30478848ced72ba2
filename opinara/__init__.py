"""Review analytics on Spark: sentiment, keywords, trends, forecasts and answers."""

from opinara.operators.sentiment import score
from opinara.plans.answers import answer, answer_table
from opinara.plans.batch import run
from opinara.plans.marts import Marts
from opinara.sources.reviews import load_reviews, read_csv

__all__ = [
    "Marts", "answer", "answer_table", "load_reviews", "read_csv", "run", "score",
]
