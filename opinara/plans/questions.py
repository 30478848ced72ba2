"""Routing of questions to intents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import fixed_values as v
from opinara.functions.text import strip
from opinara.sources.tables import small_table


def intent_of(
    asked: Column,
    triggers: Mapping[int, Sequence[str]] = v.TRIGGERS,
    fallback: int = v.FALLBACK_INTENT,
) -> Column:
    """Number of the first intent with a trigger phrase contained in a normalised question.

    One CASE branch per intent, tried in order: a narrow expression, so it needs
    neither a join with the phrases nor a shuffle and works on streams as well.  Plain
    substring tests are several times faster here than one regex per intent.
    """
    branches = F
    for intent in sorted(triggers):
        phrases = F.array(*[F.lit(p) for p in triggers[intent]])
        found = F.exists(phrases, lambda p: F.contains(asked, p))
        branches = branches.when(found, intent)
    return branches.otherwise(fallback)


def route(questions: DataFrame, triggers: Mapping[int, Sequence[str]] = v.TRIGGERS) -> DataFrame:
    """Add ``intent`` and ``intent_name`` to ``question_id, question``."""
    normalised = questions.withColumn("_asked", strip(F.lower("question")))
    routed = normalised.withColumn("intent", intent_of(F.col("_asked"), triggers))
    names = F.array(*[F.lit(n) for n in v.INTENTS])
    return routed.withColumn("intent_name", F.get(names, F.col("intent") - 1)).drop("_asked")


def canned_questions(spark: SparkSession) -> DataFrame:
    """The shortcut questions: ``question_id, question``."""
    schema = pa.schema([("question_id", pa.int64()), ("question", pa.string())])
    return small_table(spark, enumerate(v.CANNED_QUESTIONS, 1), schema)
