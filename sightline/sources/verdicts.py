"""Tab-separated verdict files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import VERDICT


def _cell(name: str) -> Column:
    return F.nullif(strip(F.col(name)), F.lit(""))


def clean_verdicts(rows: DataFrame) -> DataFrame:
    """Text cells -> typed verdicts: rows without url go, blank cells are null, `4.1/5` is 4.1."""
    kept = [c for c in rows.columns if c not in VERDICT.fieldNames()]
    score = F.trim(F.split_part(_cell("score"), F.lit("/"), F.lit(1)))
    return rows.select(
        *kept, _cell("url").alias("url"), score.cast("double").alias("score"),
        _cell("status").alias("status"), _cell("report_num").cast("int").alias("report_num"),
    ).filter(F.col("url").isNotNull())


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows under a header, columns in any order; `seq` keeps the order of the rows."""
    rows = spark.read.csv(path, sep="\t", header=True)
    for name in VERDICT.fieldNames():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    seq = F.struct("_metadata.file_path", "_metadata.file_block_start",
                   F.monotonically_increasing_id().alias("row"))
    return clean_verdicts(rows.select(*VERDICT.fieldNames(), seq.alias("seq")))
