"""Incremental reading of landed files, and running a stream over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_landing(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
    files_per_batch: int | None = None, **options: str,
) -> DataFrame:
    """New files only, each read once; `files_per_batch` bounds a micro-batch.

    `path` is a table as it lies: one file or a folder of files. A path that holds no file raises, so that a stream
    over a mistyped or empty landing cannot pass as a stream over no rows.
    """
    listed = spark.read.format(fmt).schema(schema).options(**options).load(path).inputFiles()
    if not listed:
        raise FileNotFoundError(f"no {fmt} file lies at {path}")
    if len(listed) == 1 and listed[0].rstrip("/").endswith(path.rstrip("/")):
        # A stream reads folders: a table of one file is its folder, filtered to that file's name.
        parent, _, name = path.rstrip("/").rpartition("/")
        path, options = parent, {**options, "pathGlobFilter": name}
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def write_available(
    df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
) -> None:
    """Process everything that has landed, append it below `path`, then stop."""
    (df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start(path).awaitTermination())


def each_batch(df: DataFrame, fn, checkpoint: str) -> None:
    """Run `fn(batch, batch_id)` over everything that has landed, then stop."""
    (df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
