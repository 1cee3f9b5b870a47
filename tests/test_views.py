import datetime as dt

import pytest
from pyspark.sql import functions as F

from sightline.operators import enrich, filters, ledger, scoring, views
from sightline.operators.filters import KeywordPolicy

NOW = dt.datetime(2026, 1, 10)
SCHEMA = ("job_id string, source string, company string, title string, url string, location string, locations array<string>, status string, "
          "score double, eval_reason string, salary_min double, salary_max double, currency string, first_seen timestamp, description string, evaluated_at timestamp")


@pytest.fixture
def board(spark):
    def row(i, status="new", score=None, hours=1, **kw):
        d = dict(job_id=f"j{i}", source="reed", company=f"C{i}", title="Data Engineer", url=f"https://x/{i}", location="", locations=["London"],
                 status=status, score=score, eval_reason=None, salary_min=None, salary_max=None, currency=None,
                 first_seen=None if hours is None else NOW - dt.timedelta(hours=hours), description="", evaluated_at=None)
        return tuple({**d, **kw}.values())
    return spark.createDataFrame([
        row(1, hours=1, description="Apache Spark and Airflow"), row(2, "viewed", hours=2, score=7.0), row(3, hours=49, score=7.0),
        row(4, "archived", hours=3, score=-2.0, company="beta"), row(5, hours=None, salary_max=10.0, company="Äb"),
        row(6, "saved", hours=5, score=9.5, locations=["Edinburgh", "London"], salary_max=99.0), row(7, None, hours=6, company="a\\b%"),
    ], SCHEMA)


def ids(df):
    return [r["job_id"] for r in df.collect()]


def test_keyword_rules(column):
    p = KeywordPolicy(("data engineer", "spark"), ("junior",), ("edinburgh", "remote"), ("london",))
    assert column(p.title_ok, ["Senior Data Engineer", "SPARK dev", "Junior Data Engineer", "Frontend", None]) == [True, True, False, False, False]
    assert column(p.place_ok, ["Edinburgh, Scotland", "Remote (UK)", "", None, "London", "Manchester", "London remote", " "]) == [
        True, True, True, True, False, False, False, False]
    assert column(KeywordPolicy().title_ok, ["x", None]) == [True, True]
    assert column(KeywordPolicy(title_negative=("manager",)).title_ok, ["x", "Manager"]) == [True, False]
    assert column(KeywordPolicy(title_positive=("",)).title_ok, ["x"]) == [True]


def test_search(board):
    assert ids(filters.search_text(board, " spark ")) == ["j1"]
    assert filters.search_text(board, "DATA ENGINEER").count() == 7
    assert filters.search_text(board, "  ").count() == 7
    assert ids(filters.search_text(board, "a\\b")) == ["j7"]
    assert ids(filters.search_text(board, "a\\b%data")) == [] and ids(filters.search_text(board, "d_ta%apache")) == ["j1"]
    assert "description" not in views.newest(board, query="spark").columns


def test_lanes_and_recency(board):
    as_of = F.lit(NOW)
    assert sorted(ids(filters.lane(board, "inbox"))) == ["j1", "j2", "j3", "j5"]
    assert sorted(ids(filters.recent_inbox(board, as_of))) == ["j1", "j2", "j5"]
    assert ids(filters.recent_new(board, NOW)) == ["j1"]
    assert sorted(ids(filters.min_salary(board, 50))) == ["j1", "j2", "j3", "j4", "j6", "j7"]
    assert views.older_count(board, as_of).first()[0] == 1
    assert ids(filters.in_city(board, "Edinburgh")) == ["j6"]


def test_orders_and_pages(board):
    assert ids(views.newest(board)) == ["j1", "j2", "j4", "j6", "j7", "j3", "j5"]
    assert ids(views.best_score(board)) == ["j6", "j2", "j3", "j4"]
    assert ids(views.sort_by(board, "score")) == ["j6", "j2", "j3", "j1", "j7", "j5", "j4"]
    assert ids(views.sort_by(board, "company"))[:2] == ["j7", "j5"]
    assert ids(views.sort_by(board, "location"))[0] == "j6"
    last = views.page(board, 9, 3)
    assert ids(last) == ["j5"] and last.first()["pages"] == 3 and last.first()["page"] == 3
    assert ids(views.page(board, -1, 3)) == ["j1", "j2", "j4"]
    assert ids(views.capped(board, 2).filter("status = 'new'")) == ["j1"]
    assert views.skipped(board, max_jobs=1).first().asDict() == {"candidates": 3, "skipped": 2}
    assert ids(views.candidates(board, max_jobs=2)) == ["j1", "j3"]


def test_counts(board):
    assert {r["stage"]: r["n"] for r in views.funnel(board).collect()} == {
        "total": 7, "new": 3, "viewed": 1, "archived": 1, "saved": 1, "None": 1}
    assert views.lane_counts(board).first().asDict() == {"inbox": 4, "archived": 1, "all": 7}
    assert {r["stage"]: r["n"] for r in views.stage_counts(board).collect()} == {"saved": 1, "applied": 0, "rejected": 0}
    assert [(r["stage"], r["n"]) for r in views.funnel_stages(board).orderBy("pos").collect()] == [
        ("Discovered", 7), ("Scored", 4), ("New", 3), ("Saved", 1), ("Applied", 0), ("Rejected", 0)]
    assert [r["value"] for r in views.facet(board, "locations").collect()] == ["Edinburgh", "London"]


def test_digest_and_export(spark, board, tmp_path):
    lines = [r["line"] for r in views.digest(board, most=2).orderBy("pos").collect()]
    assert lines[0] == "🆕 <b>7</b> new job match(es):\n" and len(lines) == 4 and lines[-1].startswith("\n…and 5 more")
    assert lines[1] == '⚪ <a href="https://x/1">Data Engineer</a>\n   <i>C1 · London · reed</i>'
    assert views.digest(board.filter("false")).count() == 0
    views.write_pending(board, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text[:3] == ["## Pending", "", "- [ ] https://x/1 | C1 | Data Engineer"] and len(text) == 5


def test_usage(spark):
    runs = spark.createDataFrame(
        [("a", "anthropic", 2, 1, 0.00121), ("b", None, 5, 0, 0.5), ("c", "anthropic", None, 3, None)],
        "run_id string, engine string, scored int, errors int, cost_usd double").withColumns(
        {c: F.lit(1000).cast("bigint") for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")})
    assert ledger.usage_totals(runs).first().asDict() == {
        "scored": 7, "calls": 11, "input_tokens": 3000, "output_tokens": 3000, "cache_read_tokens": 3000, "cost_usd": 0.5012, "runs": 3}
    assert [tuple(r) for r in ledger.usage_by_engine(runs).collect()] == [("?", 1, 5, 0.5), ("anthropic", 2, 3, 0.0012)]
    assert ledger.api_cost(runs).first()[0] == 0.0012


def test_scoring_run(spark, board):
    cand = views.candidates(board).withColumn("seq", F.monotonically_increasing_id())
    got = {r["job_id"]: (r["score"], r["outcome"]) for r in scoring.score_batch(cand, scoring.keyword_scorer({"spark": 8, "data": 5})).collect()}
    assert got == {"j1": (10.0, "scored"), "j3": (5.0, "scored"), "j5": (5.0, "scored")}


def test_cut_off_and_summary(spark):
    ok, bad = '{"score": 5, "reason": "r"}', "no json"
    rows = [("a", 1, ok, None), ("a", 2, bad, None), ("a", 3, None, "rate limit"), ("a", 4, ok, None),
            ("b", 1, None, "not logged in"), ("b", 2, ok, None), ("c", 1, ok, None), ("c", 2, None, "odd")]
    tried = spark.createDataFrame(rows, "run_id string, seq int, reply string, error_message string").withColumns({
        "error_kind": F.lit(None).cast("string"), "model": F.lit("m"), "cost_usd": F.lit(0.1),
        **{t: F.lit(10).cast("bigint") for t in scoring.TOKENS}})
    judged = scoring.judge(tried)
    assert scoring.cut_off(judged).count() == 3 + 1 + 2
    s = {r["run_id"]: r for r in scoring.run_summary(judged, halted=F.col("run_id") == "c").collect()}
    assert (s["a"]["jobs"], s["a"]["scored"], s["a"]["errors"], s["a"]["note"], s["a"]["budget_hit"]) == (4, 1, 1, "rate/usage limit", True)
    assert (s["b"]["scored"], s["b"]["errors"], s["b"]["note"]) == (0, 0, "auth failed")
    assert (s["c"]["scored"], s["c"]["errors"], s["c"]["note"], s["c"]["input_tokens"]) == (1, 1, "halted", 10)


def test_request_dedup_equals_fold(spark):
    import random
    rng, rows = random.Random(5), []
    for i in range(400):
        rows.append((rng.choice("aab"), NOW + dt.timedelta(hours=rng.randrange(24 * 30), seconds=i), i, rng.choice(["ask", "ask", "done"])))
    waiting, want = set(), set()
    for key, at, seq, kind in sorted(rows, key=lambda r: r[1:3]):
        if kind == "done":
            waiting.discard(key)
        elif key not in waiting:
            waiting.add(key)
            want.add((key, seq))
    log = spark.createDataFrame(rows, "key string, at timestamp, seq int, kind string")
    assert {(r["key"], r["seq"]) for r in scoring.dedup_requests(log).collect()} == want


def test_enrich(spark):
    snap = spark.createDataFrame([("j1", "reed", "snip", False, NOW, "5"), ("j2", "reed", "snip", False, NOW, "6"), ("j3", "adzuna", "s", False, NOW, "5"),
                                  ("j4", "reed", "full", True, NOW, "5")],
                                 "job_id string, source string, description string, jd_full boolean, first_seen timestamp, listing string")
    details = spark.createDataFrame([("5", "FULL"), ("6", None)], "listing_id string, description string")
    got = {r["job_id"]: (r["description"], r["jd_full"]) for r in enrich.enrich_detail(snap, details, F.col("listing")).collect()}
    assert got == {"j1": ("FULL", True), "j2": ("snip", False), "j3": ("s", False), "j4": ("full", True)}
