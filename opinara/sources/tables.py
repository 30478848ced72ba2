"""Small tables made from Python values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def small_table(spark: SparkSession, rows: Iterable[Sequence], schema: pa.Schema) -> DataFrame:
    """A table whose size Catalyst knows, unlike one parallelized from a list."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))
