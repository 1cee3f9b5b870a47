import datetime as dt
import json

from pyspark.sql import functions as F

from sightline.functions import Gazetteer
from sightline.operators.filters import KeywordPolicy
from sightline.plans.scan import ScanPolicy, Window, run_scan, scan_into
from sightline.plans.snapshot import SnapshotTable
from sightline.schema import PAYLOAD, SCAN_RUN

T0 = dt.datetime(2026, 7, 22, 9)
POLICY = ScanPolicy(Gazetteer(("London", "Leeds")), KeywordPolicy(title_positive=("engineer",), place_block=("paris",)))


def payloads(spark, ts, *rows):
    data = [(s, p if p is None or isinstance(p, str) else json.dumps(p), ts, i, m) for i, (s, p, m) in enumerate(rows)]
    return spark.createDataFrame(data, PAYLOAD)


def reed(*jobs):
    return "reed", {"results": [dict(jobId=i, jobUrl=f"https://r/{i}", jobTitle=t, employerName="Acme", locationName=l, jobDescription="snip",
                                     date=d) for i, t, l, d in jobs]}, {}


def adzuna(*jobs):
    return "adzuna", {"results": [{"redirect_url": f"https://a/{i}", "title": t, "company": {"display_name": "Acme"},
                                   "location": {"display_name": l}, "created": "2026-07-21"} for i, t, l in jobs]}, {}


def test_scans_end_to_end(spark, tmp_path):
    table, runs = SnapshotTable(spark, str(tmp_path / "table")), str(tmp_path / "runs")
    day = "21/07/2026"
    first = payloads(spark, T0, reed((1, "Data Engineer", "London", day), (2, "Data Engineer", "Leeds", day), (3, "Cook", "London", day),
                                     (4, "ML Engineer", "Paris", day)),
                     adzuna((9, "Data Engineer", "Leeds")), ("lever", None, {"error": "timeout"}),
                     ("reed", {"jobDescription": "<p>Full text</p>"}, {"kind": "detail", "listing_id": "1"}))
    result = scan_into(table, first, POLICY, T0, ledger_path=runs, run_id="r1")
    (row,) = table.read().collect()
    # adzuna comes before reed in the registry, so its sighting is the first.
    assert (row["source"], row["url"], row["locations"], row["jd_full"]) == ("adzuna", "https://a/9", ["London", "Leeds"], True)
    counts = {r["source"]: r.asDict() for r in result.counts.collect()}
    assert counts["reed"] == {"source": "reed", "found": 4, "new": 0, "dupes": 2, "filtered": 2}
    assert counts["adzuna"] == {"source": "adzuna", "found": 1, "new": 1, "dupes": 0, "filtered": 0}
    assert {r["source"]: r["found"] for r in result.totals.collect()} == {"reed": 4, "adzuna": 1, "*": 5}
    log = {r["source"]: (r["found"], r["errors"], r["error_detail"]) for r in spark.read.schema(SCAN_RUN).parquet(runs).collect()}
    assert log == {"reed": (4, 0, ""), "adzuna": (1, 0, ""), "lever": (0, 1, "timeout")}
    assert [r["url"] for r in result.new_rows.collect()] == ["https://a/9"]
    from sightline.operators.views import digest
    assert digest(result.new_rows).count() == 2  # the count line and one card

    # Next day: adzuna fails, so its row stays although it is gone; reed brings a snippet with a detail.
    later = T0 + dt.timedelta(hours=30)
    second = payloads(spark, later, reed((5, "Platform Engineer", "London", day)), ("adzuna", "<html>", {}),
                      ("reed", {"jobDescription": "<p>Full text</p>"}, {"kind": "detail", "listing_id": "5"}))
    scan_into(table, second, POLICY, later, ledger_path=runs, run_id="r2")
    rows = {r["title"]: r for r in table.read().collect()}
    assert rows["Data Engineer"]["status"] == "new"
    assert (rows["Platform Engineer"]["description"], rows["Platform Engineer"]["jd_full"]) == ("Full text", True)

    # Then adzuna is back without it: expired, closed, and listed again as a new row.
    third = T0 + dt.timedelta(hours=31)
    scan_into(table, payloads(spark, third, adzuna()), POLICY, third, ledger_path=runs, run_id="r3")
    assert {r["title"]: r["status"] for r in table.read().collect()} == {"Data Engineer": "expired", "Platform Engineer": "new"}
    assert [r["title"] for r in table.read_open().collect()] == ["Platform Engineer"]
    fourth = T0 + dt.timedelta(hours=32)
    scan_into(table, payloads(spark, fourth, adzuna((9, "Data Engineer", "Leeds"))), POLICY, fourth, ledger_path=runs, run_id="r4")
    assert sorted(r["status"] for r in table.read().filter("title = 'Data Engineer'").collect()) == ["expired", "new"]
    table.replace(table.read())
    assert table.read_open().count() == 3


def test_dry_run_and_windows(spark):
    jobs = payloads(spark, T0, reed((1, "Data Engineer", "London", "22/07/2026"), (2, "Data Engineer", "Leeds", "22/07/2026"),
                                    (3, "Old Engineer", "Leeds", "10/07/2026"), (4, "Undated Engineer", "Leeds", None)))
    policy = ScanPolicy(POLICY.gazetteer, POLICY.keywords, windows={"reed": Window(max_days=30)}, recent_days=2)
    result = run_scan(None, jobs, policy, T0, dry_run=True)
    assert result.rows is None and result.skipped.count() == 0
    assert result.counts.first().asDict() == {"source": "reed", "found": 3, "new": 2, "dupes": 1, "filtered": 0}
    assert run_scan(None, jobs, policy, T0, dry_run=True, deep=True).counts.first()["found"] == 4
    assert run_scan(None, jobs, policy, T0, dry_run=True, only="adzuna").counts.count() == 0
