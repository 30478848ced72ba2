"""Writing tables, the shared folder for intermediate ones, and tables as streams."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that :func:`opinara.sources.reviews.read_csv` reads back unchanged."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_marts(marts: Mapping[str, DataFrame], path: str) -> None:
    """One parquet folder per mart; a mart is small, so it gets one file."""
    for name, mart in marts.items():
        write_table(mart.coalesce(1), f"{path}/{name}")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it, or else its warehouse.

    A warehouse on the machine's own disk will do for a local session only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        own = folder.startswith("file:") or "://" not in folder
        if own and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; columns to part by come last.

    For an intermediate that several results read: its lineage ends here, it survives
    lost executors, and each reader scans only the columns it needs.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    write_table(df, path, partition_by)
    columns = [c for c in df.columns if c not in partition_by] + list(partition_by)
    return spark.read.schema(df.select(columns).schema).parquet(path)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder as a stream, one file or a directory of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema)
    if system.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)
