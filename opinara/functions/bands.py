"""Threshold labels.  Every edge is strict or inclusive exactly as written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara import fixed_values as v


def sentiment_class(polarity: Column) -> Column:
    return (
        F.when(polarity > v.POLARITY_EDGE, v.POSITIVE)
        .when(polarity < -v.POLARITY_EDGE, v.NEGATIVE)
        .otherwise(v.NEUTRAL)
    )


def star_class(score: Column) -> Column:
    return (
        F.when(score >= v.POSITIVE_STARS, v.POSITIVE)
        .when(score <= v.NEGATIVE_STARS, v.NEGATIVE)
        .otherwise(v.NEUTRAL)
    )


def csat_level(csat: Column) -> Column:
    return (
        F.when(csat > 75, "Excellent")
        .when(csat > 60, "Good")
        .otherwise("Needs Improvement")
    )


def csat_benchmark(csat: Column) -> Column:
    return F.when(csat >= 70, "above benchmark").otherwise("below benchmark")


def industry_position(rating: Column) -> Column:
    return F.when(rating > 3.5, "above").otherwise("below")


def rating_benchmark(rating: Column) -> Column:
    return F.when(rating >= 4, "Above").otherwise("Below")


def rating_advice(rating: Column) -> Column:
    return F.when(rating >= 4, "Protect this score by holding quality steady.").otherwise(
        "Raise it by working through the top complaints."
    )


def retention_note(rating: Column) -> Column:
    return F.when(rating >= 4, "helps keep customers").otherwise(
        "has to rise to keep customers"
    )


def urgency(negative_pct: Column) -> Column:
    return (
        F.when(negative_pct > 30, "HIGH")
        .when(negative_pct > 15, "MODERATE")
        .otherwise("LOW")
    )


def urgency_note(negative_pct: Column) -> Column:
    return (
        F.when(negative_pct > 30, "act at once")
        .when(negative_pct > 15, "moderate risk, watch closely")
        .otherwise("low risk, the brand is seen well")
    )


def trend_direction(slope: Column) -> Column:
    """Takes the unrounded slope."""
    return F.when(slope > 0.1, "Rising").when(slope < -0.1, "Falling").otherwise("Stable")


def trend_advice(rounded_slope: Column) -> Column:
    return (
        F.when(rounded_slope > 0.1, "Watch closely: the negative share is rising.")
        .when(rounded_slope < -0.1, "Improving: keep the present quality.")
        .otherwise("Stable: keep monitoring.")
    )


def recommendation_note(rounded_slope: Column) -> Column:
    return F.when(rounded_slope > 0.1, "act before it gets worse").otherwise(
        "the course is improving"
    )


def forecast_risk(negative_pct: Column) -> Column:
    return (
        F.when(negative_pct > 20, "High").when(negative_pct > 10, "Medium").otherwise("Low")
    )


def scenario_action(rounded_slope: Column) -> Column:
    return F.when(rounded_slope > 0, "Step in now to stop the decline.").otherwise(
        "Keep the present course; the trend is improving."
    )
