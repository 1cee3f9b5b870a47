import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import ledger
from sightline.plans.score import run_scoring
from sightline.schema import SCORE_RUN, VACANCY

T0 = dt.datetime(2026, 1, 1)
RUN = dict(run_id="r", model="claude-haiku-4-5", engine="api", started=T0)


@pytest.fixture
def rows(spark):
    """j0 is the newest; j9 is scored already, j8 is applied."""
    data = [(f"j{i}", f"title {i}", "applied" if i == 8 else "new", T0 - dt.timedelta(hours=i), T0 if i == 9 else None) for i in range(10)]
    df = spark.createDataFrame(data, "job_id string, title string, status string, first_seen timestamp, evaluated_at timestamp")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in VACANCY.fields])


def scorer(fail: dict):
    """Score 5 for every row but those in `fail`: {row number: error text}."""
    def run(frames):
        for pdf in frames:
            n = pdf["prompt"].str.extract(r"title (\d)")[0].astype(int)
            error = n.map(fail)
            yield pd.DataFrame({
                "job_id": pdf["job_id"], "seq": pdf["seq"], "model": "claude-haiku-4-5",
                "reply": '{"score": 5, "reason": "r"}', "error_kind": None, "error_message": error.where(error.notna(), None),
                "input_tokens": 100, "output_tokens": 20, "cache_read_tokens": 80, "cache_write_tokens": 0, "cost_usd": None})
    return run


def scored(result):
    return sorted(r["job_id"] for r in result.rows.filter("evaluated_at = timestamp'2026-01-01' and engine is not null").collect())


def test_one_bad_row_is_passed_over(rows, spark, tmp_path):
    result = run_scoring(rows, scorer({3: "odd reply"}), **RUN)
    assert scored(result) == ["j0", "j1", "j2", "j4", "j5", "j6", "j7"]
    row = result.ledger.first()
    assert (row["jobs"], row["scored"], row["errors"], row["note"], row["input_tokens"]) == (8, 7, 1, "", 700)
    assert abs(row["cost_usd"] - 7 * (108 / 1e6 + 20 / 1e6 * 5)) < 1e-12
    assert {r["status"] for r in result.rows.filter("job_id = 'j0'").collect()} == {"new"}
    ledger.append(result.ledger, str(tmp_path / "runs"))
    assert ledger.usage_totals(spark.read.schema(SCORE_RUN).parquet(str(tmp_path / "runs"))).first()["calls"] == 8


def test_cap_reports_what_it_left_out(rows):
    result = run_scoring(rows, scorer({}), max_jobs=3, **RUN)
    assert scored(result) == ["j0", "j1", "j2"] and result.skipped.first()["skipped"] == 5


@pytest.mark.parametrize("batch_rows", [500, 2])
def test_budget_ends_the_run(rows, batch_rows):
    result = run_scoring(rows, scorer({3: "usage limit reached"}), batch_rows=batch_rows, **RUN)
    assert scored(result) == ["j0", "j1", "j2"]
    row = result.ledger.first()
    assert (row["scored"], row["errors"], row["budget_hit"], row["note"]) == (3, 0, True, "rate/usage limit")
    assert result.judged.count() == (8 if batch_rows == 500 else 4)


def test_auth_and_halt(rows):
    assert run_scoring(rows, scorer({0: "please run /login"}), **RUN).ledger.first()["note"] == "auth failed"
    calls = iter([False, True])
    result = run_scoring(rows, scorer({}), batch_rows=2, should_stop=lambda: next(calls), **RUN)
    assert scored(result) == ["j0", "j1"] and result.ledger.first()["note"] == "halted"
    none = run_scoring(rows, scorer({}), should_stop=lambda: True, **RUN)
    assert none.ledger.first()["note"] == "halted" and none.ledger.first()["scored"] == 0 and scored(none) == []


def test_given_ids_are_scored_again(rows, spark):
    ids = spark.createDataFrame([("j9",), ("j8",)], "job_id string")
    assert scored(run_scoring(rows, scorer({}), job_ids=ids, only_unscored=False, **RUN)) == ["j9"]
