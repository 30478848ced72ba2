"""Answer questions as they arrive.

Routing is a narrow expression and the answers are a 25-row static table, so the query
keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from opinara.plans.answers import answer


def answer_stream(questions: DataFrame, answers: DataFrame) -> DataFrame:
    if not questions.isStreaming:
        raise ValueError("questions must be a streaming DataFrame")
    return answer(questions, answers)


def serve(
    questions: DataFrame, answers: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append answers to parquet files; the checkpoint makes a restart exact.

    With ``once`` the query answers what is there and stops.
    """
    writer = (
        answer_stream(questions, answers)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
