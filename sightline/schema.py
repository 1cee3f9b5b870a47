"""Table shapes. Column order is the storage order."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _B, _TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols.items()])


# One landed provider reply. `meta` carries what the request knew and the reply does not repeat.
PAYLOAD = _struct(
    source=_S, payload=_S, fetched_at=_TS, page=T.LongType(), meta=T.MapType(_S, _S),
)

# One listing as one provider showed it at one time.
SIGHTING = _struct(
    source=_S, company=_S, title=_S, url=_S, location=_S, description=_S, jd_full=_B,
    posted_at=T.DateType(), salary_min=_D, salary_max=_D, currency=_S, remote=_B,
    raw=T.VariantType(), fetched_at=_TS, pos=_struct(page=T.LongType(), item=T.LongType()),
)

# What the first sighting of a generation decides for good.
CONTENT = (
    "source", "company", "title", "url", "location", "description", "jd_full",
    "posted_at", "salary_min", "salary_max", "currency", "remote", "raw",
)

# One row per generation of a vacancy.
VACANCY = _struct(
    job_id=_S, vacancy_key=_S, source=_S, company=_S, title=_S, url=_S, location=_S,
    locations=T.ArrayType(_S), description=_S, jd_full=_B, posted_at=T.DateType(),
    salary_min=_D, salary_max=_D, currency=_S, remote=_B, status=_S, score=_D,
    report_num=T.IntegerType(), eval_reason=_S, evaluated_at=_TS, engine=_S,
    first_seen=_TS, last_seen=_TS, raw=T.VariantType(),
)

# One row per source and scan.
SCAN_RUN = _struct(
    run_id=_S, started_at=_TS, finished_at=_TS, source=_S, found=T.IntegerType(),
    new=T.IntegerType(), dupes=T.IntegerType(), filtered=T.IntegerType(),
    errors=T.IntegerType(), error_detail=_S,
)

# One row per scoring run.
SCORE_RUN = _struct(
    run_id=_S, stage=_S, model=_S, engine=_S, started_at=_TS, finished_at=_TS,
    jobs=T.IntegerType(), scored=T.IntegerType(), errors=T.IntegerType(),
    input_tokens=T.LongType(), output_tokens=T.LongType(), cache_read_tokens=T.LongType(),
    cache_write_tokens=T.LongType(), cost_usd=_D, budget_hit=_B, note=_S,
)

# One outside verdict.
VERDICT = _struct(url=_S, score=_S, status=_S, report_num=_S)

# Column lists of the read views (fixed values).
PENDING_COLS = (
    "job_id", "url", "company", "title", "location", "source",
    "posted_at", "salary_min", "salary_max", "currency", "remote",
)
CANDIDATE_COLS = ("job_id", "company", "title", "location", "locations", "description")
LIST_COLS = (
    "job_id", "source", "company", "title", "url", "location", "locations", "status",
    "score", "eval_reason", "salary_min", "salary_max", "currency", "first_seen", "last_seen",
)
USAGE_COLS = tuple(f.name for f in SCORE_RUN.fields)
NEW_COLS = ("source", "company", "title", "location", "url")

# Statuses a person may set directly (fixed values).
SETTABLE = ("new", "viewed", "saved", "applied", "rejected", "archived")
