"""Review input: CSV, any typed DataFrame, or the documents stand-in."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from opinara import fixed_values as v
from opinara.functions import dates
from opinara.sources.sampling import sample_rows
from opinara.sources.sinks import stored

_TYPES = {"Id": "bigint", "ProductId": "string", "Score": "double", "Time": "bigint",
          "Summary": "string", "Text": "string"}
HEADER_THREADS = 16
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    multi_line: bool | None = None,
    null_tokens: Sequence[str] = v.CSV_NULL_TOKENS,
) -> DataFrame:
    """Review CSV with a header, quoted fields and doubled quotes.

    Columns are found by name, so extra columns and any order are fine; files that are read
    together must have the same header, which is compared before anything else is read.
    Files are split among tasks unless quoted fields hold line breaks: then each file must go
    to one task.  Which of the two it is, a pass over the lines counts, and a warning says so;
    ``multi_line`` given as True or False saves that pass.  Store a large collection with such
    breaks as many files, or convert it once with :func:`opinara.sources.sinks.write_table`.
    """
    header = csv_header(spark, path)
    if multi_line is None:
        broken = open_lines(spark, path)
        multi_line = broken > 0
        if multi_line:
            warnings.warn(f"{broken} lines end inside a quoted field: each file is read by one task",
                          stacklevel=2)
    schema = StructType([StructField(c, StringType()) for c in header])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    present = [c for c in v.REVIEW_COLUMNS if c in raw.columns]
    tokens = list(null_tokens)

    def value(name: str) -> Column:
        return F.when(~F.col(name).isin(tokens), F.col(name)).alias(name)

    return typed(raw.select(*[value(c) for c in present]))


def csv_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The column names that all files share, from the first line of each; another is refused.

    A few bytes of every file come to the driver, several files at a time.
    """
    files = spark.read.text(path).inputFiles()
    hadoop, settings = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    codecs = hadoop.io.compress.CompressionCodecFactory(settings)

    def first_line(file: str) -> str:
        at = hadoop.fs.Path(spark._jvm.java.net.URI(file))
        opened = at.getFileSystem(settings).open(at)
        codec = codecs.getCodec(at)
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(
            opened if codec is None else codec.createInputStream(opened), "UTF-8"))
        try:
            return (reader.readLine() or "").removeprefix("\ufeff")
        finally:
            reader.close()

    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        lines = {line: file for file, line in zip(files, pool.map(first_line, files), strict=True) if line}
    headers = {tuple(next(csv.reader([line]))): file for line, file in lines.items()}
    if len(headers) > 1:
        (one, a), (other, b) = list(headers.items())[:2]
        raise ValueError(f"different headers: {list(one)} in {a}, {list(other)} in {b}")
    return list(next(iter(headers), ()))


def open_lines(spark: SparkSession, path: str | Sequence[str]) -> int:
    """Lines with an odd number of quotes: those that a quoted line break begins or ends."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).where(quotes % 2 == 1).count()


def typed(df: DataFrame) -> DataFrame:
    """Known, present columns in their types; a value that does not fit is null.

    Stars of a whole-number type stay whole numbers; all others may have fractions.
    """
    types = dict(df.dtypes)

    def value(name: str) -> Column:
        kind = "int" if name == "Score" and types[name] in _WHOLE else _TYPES[name]
        return F.col(name) if types[name] == kind else F.col(name).try_cast(kind).alias(name)

    return df.select(*[value(c) for c in v.REVIEW_COLUMNS if c in df.columns])


def reviews_from_documents(documents: DataFrame) -> DataFrame:
    """Review-shaped view over a documents table (stand-in input, see README)."""
    return documents.select(
        F.col("doc_id").alias("Id"),
        F.col("source").alias("ProductId"),
        (F.lit(1) + F.col("n_chars") % 5).cast("int").alias("Score"),
        (F.lit(1325376000) + (F.col("doc_id") % 720) * 86400).alias("Time"),
        F.concat_ws(" ", "source", "lang", "doc_id").alias("Summary"),
        F.col("text").alias("Text"),
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.where(F.col("Text").isNotNull() & F.col("Score").isNotNull())


def with_dates(df: DataFrame) -> DataFrame:
    """Date, YearMonth, Year and Month, when there is a ``Time`` column."""
    if "Time" not in df.columns:
        return df
    seconds = F.col("Time")
    day = dates.epoch_date(seconds)
    return df.select(
        "*",
        dates.epoch_timestamp(seconds).alias("Date"),
        dates.epoch_month(seconds).alias("YearMonth"),
        F.year(day).alias("Year"),
        F.month(day).alias("Month"),
    )


def load_reviews(
    raw: DataFrame,
    sample_size: int | None = None,
    seed: int = v.SAMPLE_SEED,
    spread: int | None = None,
) -> DataFrame:
    """Sample (only when asked), prune, drop incomplete rows, add dates.

    Sampling comes before the null drop, so a sample may end up with fewer rows.  ``spread`` deals
    the rows out to so many tasks first: it shuffles the texts once, which pays for input in fewer
    parts than there are cores, such as one file with one row group, and for nothing else.
    Without an ``Id`` column the reading order becomes the row key; such a table is stored
    once, so that every later pass sees the same keys.
    """
    df = typed(raw)
    if "Id" not in df.columns:
        df = stored(df.withColumn("Id", F.monotonically_increasing_id()), "reviews")
    if sample_size is not None:
        df = sample_rows(df, sample_size, seed)
    df = drop_incomplete(df)
    return with_dates(df if spread is None else df.repartition(spread))


def load_stats(
    raw: DataFrame, sample_size: int | None = None, seed: int = v.SAMPLE_SEED
) -> DataFrame:
    """Rows at each loading stage: ``stage, n`` for raw, sampled and clean."""
    complete = F.col("Text").isNotNull() & F.col("Score").isNotNull()
    rows, kept = F.count(F.lit(1)), F.count_if(complete)
    if sample_size is None:
        counts = typed(raw).agg(rows.alias("raw"), rows.alias("sampled"), kept.alias("clean"))
    else:
        sampled = sample_rows(typed(raw), sample_size, seed)
        counts = sampled.agg(rows.alias("sampled"), kept.alias("clean")).select(
            raw.agg(rows).scalar().alias("raw"), "sampled", "clean"
        )
    return counts.unpivot([], ["raw", "sampled", "clean"], "stage", "n")
