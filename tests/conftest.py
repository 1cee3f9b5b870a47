import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sightline.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def column(spark):
    """Apply a Column function to plain values: column(fn, [v, ...]) or column(fn, [(a, b), ...])."""
    def run(fn, values, schema="a string"):
        from pyspark.sql import functions as F
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, {schema}")
        names = [c for c in df.columns if c != "i"]
        out = df.select("i", fn(*[F.col(n) for n in names]).alias("out")).orderBy("i").collect()
        return [r["out"] for r in out]
    return run
