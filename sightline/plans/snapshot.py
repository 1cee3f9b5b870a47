"""The vacancy table as versioned folders.

    <root>/rows/v=N/part=open      rows a later scan can still touch, rewritten by every version
    <root>/rows/v=N/part=closed    rows that left the reach of scans in version N, written once
    <root>/log                     one row per finished version; the highest one is current

A version is written in full before its log row, so readers always see a finished one, and a job
that fails leaves nothing behind that counts. A scan reads and writes the open part only: its cost
follows what is live, not the history. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import empty_snapshot
from ..schema import VACANCY

_LOG = "version bigint, base bigint, token string"


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.root}/log")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def has(self, token: str) -> bool:
        """Whether a version with this token was finished: a retried job must not merge twice."""
        log = self._log()
        return log is not None and not log.filter(F.col("token") == token).isEmpty()

    def _current(self) -> tuple[int, int]:
        """(current version, first version whose closed part counts); zeros for an empty table."""
        log = self._log()
        row = None if log is None else log.orderBy(F.desc("version")).first()
        return (row["version"], row["base"]) if row else (0, 0)

    def _rows(self, versions: Iterable[int]) -> DataFrame:
        shape = T.StructType([*VACANCY.fields, T.StructField("v", T.LongType()),
                              T.StructField("part", T.StringType())])
        paths = [f"{self.root}/rows/v={v}" for v in versions]
        return self.spark.read.schema(shape).option("basePath", f"{self.root}/rows").parquet(*paths)

    def read_open(self) -> DataFrame:
        version, _ = self._current()
        if not version:
            return empty_snapshot(self.spark)
        return self._rows([version]).filter(F.col("part") == "open").select(*VACANCY.fieldNames())

    def read(self) -> DataFrame:
        version, base = self._current()
        if not version:
            return empty_snapshot(self.spark)
        counts = (F.col("part") == "closed") | (F.col("v") == version)
        return self._rows(range(base, version + 1)).filter(counts).select(*VACANCY.fieldNames())

    def _commit(self, df: DataFrame, is_open: Column, rebase: bool, token: str | None) -> int:
        current, base = self._current()
        version = current + 1
        part = F.when(F.coalesce(is_open, F.lit(True)), "open").otherwise("closed")
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in VACANCY.fields],
                         part.alias("part"))
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/rows/v={version}")
        entry = self.spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"),
            F.lit(version if rebase else base or version).cast("bigint").alias("base"), F.lit(token).cast("string").alias("token"))
        entry.write.mode("append").parquet(f"{self.root}/log")
        return version

    def commit_scan(
        self, open_rows: DataFrame, scan_ts: datetime | Column, hours: int, token: str | None = None,
    ) -> int:
        """New version from the merged open rows; what no scan can touch any more is closed."""
        ts = scan_ts if isinstance(scan_ts, Column) else F.lit(scan_ts)
        reach = F.col("last_seen") >= ts - F.make_dt_interval(hours=F.lit(max(0, hours)))
        return self._commit(open_rows, reach | (F.col("status") == "new"), False, token)

    def replace(self, rows: DataFrame, token: str | None = None) -> int:
        """New version from all rows, all open: after verdicts on old rows, or to widen the window."""
        return self._commit(rows, F.lit(True), True, token)
