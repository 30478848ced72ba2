"""The shared intermediate tables behind reports, charts and answers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.operators import impact, keywords, lengths, metrics, products, sentiment, trend
from opinara.sources.sinks import stored

OVERALL = "All"


@dataclass(frozen=True)
class Marts:
    """``cube``: review counts per month, star and class; ``words``: mentions per class and
    word; ``facts``: one narrow row per review.

    Cube and words come out of one pass over the texts, facts out of another that only runs when
    something needs single reviews (quotes, products, lengths).  Every other table is
    derived from these, so nothing else reads or scores a text.
    """

    scored: DataFrame
    cube: DataFrame
    words: DataFrame
    impact: DataFrame
    store: bool

    @classmethod
    def build(
        cls,
        scored: DataFrame,
        impact_table: DataFrame | None = None,
        stop_words=keywords.STOP_WORDS,
        store: bool = True,
    ) -> Marts:
        """From scored reviews; ``store`` writes the tables to the shared folder."""
        counts = keywords.review_counts(scored, stop_words)
        if store:
            counts = stored(counts, "counts", ("kind",))
        cube, words = keywords.cube_and_words(counts)
        if impact_table is None:
            impact_table = impact.impact_table(scored.sparkSession)
        return cls(scored, cube, words, impact_table, store)

    @property
    def has_time(self) -> bool:
        return "YearMonth" in self.scored.columns

    @property
    def has_products(self) -> bool:
        return "ProductId" in self.scored.columns

    @cached_property
    def facts(self) -> DataFrame:
        facts = sentiment.review_facts(self.scored)
        return stored(facts, "facts") if self.store else facts

    @cached_property
    def tops(self) -> DataFrame:
        """``Sentiment, rank, word, mentions``: the first words of each class and of all reviews."""
        return keywords.top_lists(self.words, OVERALL)

    def top(self, name: str) -> DataFrame:
        return self.tops.where(F.col("Sentiment") == name).drop("Sentiment")

    @cached_property
    def total(self) -> Column:
        return metrics.total_reviews(self.cube).scalar()

    @cached_property
    def complaints(self) -> DataFrame:
        return self.top(v.NEGATIVE)

    @cached_property
    def praise(self) -> DataFrame:
        return self.top(v.POSITIVE)

    @cached_property
    def common_words(self) -> DataFrame:
        return self.top(OVERALL)

    @cached_property
    def insights(self) -> DataFrame:
        return impact.insight_lines(self.complaints, self.impact, self.total)

    @cached_property
    def monthly(self) -> DataFrame:
        return trend.monthly_negative(self.cube)

    @cached_property
    def forecast(self) -> DataFrame:
        return trend.forecast(trend.trend_fit(self.monthly))

    @cached_property
    def yearly(self) -> DataFrame:
        return metrics.yearly(self.cube)

    @cached_property
    def products(self) -> DataFrame:
        return products.product_stats(self.facts)

    @cached_property
    def lengths(self) -> DataFrame:
        return lengths.review_length(self.facts)

    @cached_property
    def longest(self) -> DataFrame:
        return lengths.longest_review(self.facts)
