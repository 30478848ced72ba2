"""Shared helpers: folders all executors see, batches of bounded size, hashing, held-out folds."""

from __future__ import annotations

import ctypes
import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.sources import sinks

CHUNK_CHARS = 1_000_000
BATCH_ROWS = 2048
WHOLE_BATCH = 1 << 30  # for work that aggregates what a batch holds


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the folder that all executors share."""
    return f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The same rows written as Parquet where every executor can read them: cuts the lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, name: str, before: DataFrame | None) -> DataFrame:
    """As stored; the folder of the stored table before it, which nothing else may read, is removed."""
    now = stored(df, name)
    if before is not None:
        spark = df.sparkSession
        for file in before.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return now


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of whole texts, each list of about `most` characters; null is empty."""
    first, size, out = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if out and size + len(text) > most:
            yield first, out
            first, size, out = i, 0, []
        out.append(text)
        size += len(text)
    if out:
        yield first, out


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Returns freed memory to the system: workers stay between tasks, beside others of the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """work on every Arrow batch, in slices of so many rows; None gives no rows."""
    def run(batches):
        for batch in slices(batches, rows):
            out = work(batch)
            if out is not None and out.num_rows:
                yield out
        give_back()

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of uint64 values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def learn(sample: DataFrame, train: Callable[[list[dict]], Any]) -> Any:
    """What train makes of all rows of a bounded sample, in one task of an executor.

    Only that result, a model, comes to the driver; the sample never does. An empty sample may have no
    task at all; then train gets an empty list here.
    """
    def run(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(train(rows))], pa.binary())})
        del rows
        give_back()

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return train([]) if found is None else pickle.loads(found[0])


def sample_per_class(rows: DataFrame, label: str, key: str, per_class: int,
                     most_classes: int = 1000, most_rows: int = 8000) -> DataFrame:
    """About per_class rows of each class, chosen by a hash of the key; never over twice as many.

    With many classes fewer of each, so that they are some most_rows together. The counts are of all
    rows; one row per class comes to the driver, and more than most_classes of them is an error. Rows
    without a label are left out.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).count().limit(most_classes + 1).collect()
    if len(counts) > most_classes:
        raise ValueError(f"over {most_classes} classes in {label}")
    if not counts:
        return rows.limit(0)
    per_class = max(1, min(per_class, most_rows // len(counts)))
    share = F.lit(0.0)
    for value, n in counts:
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(1_000_003))
    return rows.where(place < share * 1_000_003).limit(2 * per_class * len(counts))
