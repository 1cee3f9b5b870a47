import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sightline import sources as src
from sightline.schema import PAYLOAD
from sightline.sources.base import first_wins

NOW = dt.datetime(2026, 7, 22)


@pytest.fixture
def landed(spark):
    def run(*rows):
        """(source, payload or object, meta)"""
        data = [(s, p if p is None or isinstance(p, str) else json.dumps(p), NOW, i, m) for i, (s, p, m) in enumerate(rows)]
        return spark.createDataFrame(data, PAYLOAD)
    return run


def _rows(df):
    return [r.asDict(True) for r in df.withColumn("raw", F.to_json("raw")).orderBy("pos").collect()]


def test_adzuna(landed):
    page = {"results": [
        {"redirect_url": "https://x/1", "title": "<strong>Data</strong> Engineer", "company": {"display_name": "Acme"},
         "location": {"display_name": "London"}, "description": "a <b>b</b>", "created": "2026-07-20T23:00:00Z",
         "salary_min": 50000, "salary_max": 60000.5},
        {"redirect_url": "", "title": "no link"}, {"redirect_url": "https://x/2", "company": None, "title": None}]}
    a, b = _rows(src.REGISTRY["adzuna"](landed(("adzuna", page, {"country": "gb"}))))
    assert (a["title"], a["company"], a["location"], a["description"]) == ("Data Engineer", "Acme", "London", "a b")
    assert (a["posted_at"], a["salary_min"], a["salary_max"], a["currency"]) == (dt.date(2026, 7, 20), 50000.0, 60000.5, "GBP")
    assert (b["title"], b["company"], b["posted_at"], b["jd_full"]) == ("", "", None, True)
    assert json.loads(a["raw"])["redirect_url"] == "https://x/1"
    assert _rows(src.REGISTRY["adzuna"](landed(("adzuna", page, {"country": "us"}))))[0]["currency"] is None


def test_reed_and_detail(landed):
    page = {"results": [{"jobId": 5, "jobUrl": "https://r/5", "jobTitle": "DE", "employerName": "A", "locationName": "L",
                         "jobDescription": "snip", "date": "20/07/2026", "minimumSalary": None, "maximumSalary": 9}]}
    (r,) = _rows(src.REGISTRY["reed"](landed(("reed", page, {}))))
    assert (r["jd_full"], r["posted_at"], r["salary_min"], r["salary_max"]) == (False, dt.date(2026, 7, 20), None, 9.0)
    from sightline.sources.search_apis import reed_detail
    details = landed(("reed", {"jobDescription": " <p>Full</p> "}, {"kind": "detail", "listing_id": "5"}),
                     ("reed", {"jobDescription": ""}, {"kind": "detail", "listing_id": "6"}),
                     ("reed", "oops", {"kind": "detail", "listing_id": "7"}))
    got = {x["listing_id"]: x["description"] for x in reed_detail(details).collect()}
    assert got == {"5": "Full", "6": None, "7": None}
    assert src.REGISTRY["reed"](details).count() == 0


def _job(key, **kw):
    return {"job": {"key": key, "title": "Data Engineer", "datePublished": 1784505600000, "employer": {"name": "Acme"},
                    "description": {"html": "<p>JD</p>"}, "location": {"formatted": {"long": "Edinburgh EH1"}},
                    "compensation": None, "attributes": [], **kw}}


def test_indeed(landed):
    pages = [[_job("a", compensation={"baseSalary": {"unitOfWork": "YEAR", "range": {"min": 5, "max": 6}}, "currencyCode": "GBP"}),
              _job("b", compensation={"baseSalary": {"unitOfWork": "HOUR", "range": {"min": 5}},
                                      "estimated": {"baseSalary": {"unitOfWork": "YEAR", "range": {"min": 1}}}}),
              _job("", title="blank")],
             [_job("a", title="second sighting"),
              _job("c", employer=None, attributes=[{"label": "Remote"}], location={"city": "Leeds", "countryName": "UK"},
                   compensation={"estimated": {"currencyCode": "EUR", "baseSalary": {"unitOfWork": "year", "range": {"max": 2}}}})]]
    rows = {r["url"][-1]: r for r in _rows(src.REGISTRY["indeed"](landed(
        *[("indeed", {"data": {"jobSearch": {"results": p}}}, {}) for p in pages])))}
    assert sorted(rows) == ["a", "b", "c"]
    assert (rows["a"]["title"], rows["a"]["salary_min"], rows["a"]["salary_max"], rows["a"]["currency"]) == ("Data Engineer", 5.0, 6.0, "GBP")
    assert rows["b"]["salary_min"] is None and rows["b"]["remote"] is None
    c = rows["c"]
    assert (c["location"], c["remote"], c["salary_max"], c["currency"], c["company"]) == ("Leeds, UK", True, 2.0, "EUR", "")
    assert rows["a"]["posted_at"] == dt.date(2026, 7, 20) and rows["a"]["description"] == "JD"


def test_html_cards(landed):
    def card(link, title, company, extra=""):
        return (f'<li><a href="{link}?trk=x"></a><h3 class="base-search-card__title"> {title} </h3>'
                f'<h4 class="base-search-card__subtitle">\n<a href="#">{company}</a></h4>'
                f'<span class="job-search-card__location"> Edinburgh </span>{extra}</li>')
    base = "https://uk.linkedin.com/jobs/view/"
    one = card(base + "1", "Data Engineer", "Monzo", '<time datetime="2026-07-20">')
    page = f"<ul>{one}{card(base + '2', 'Remote DE', 'M&amp;G')}<li>ad</li></ul>"
    a, b = _rows(src.REGISTRY["linkedin"](landed(("linkedin", page, {}), ("linkedin", page, {}))))
    assert (a["title"], a["company"], a["location"], a["url"], a["posted_at"], a["remote"]) == (
        "Data Engineer", "Monzo", "Edinburgh", base + "1", dt.date(2026, 7, 20), None)
    assert (b["company"], b["remote"], b["posted_at"], b["description"]) == ("M&G", True, None, "")


def test_boards(landed):
    g = {"jobs": [{"absolute_url": "https://g/1", "title": "T", "location": {"name": "L"}, "content": "&lt;p&gt;a &amp; b&lt;/p&gt;"},
                  {"title": "no link"}]}
    l = [{"hostedUrl": None, "applyUrl": "https://l/1", "text": "T", "categories": {"location": "L"}, "descriptionPlain": "d"}]
    w = {"name": "", "jobs": [{"url": "", "shortlink": "https://w/1", "title": "T", "city": "C", "state": "", "country": "U",
                               "description": "<i>d</i>", "published_on": "2026-07-20", "telecommuting": False}]}
    rows = _rows(src.read_sources(landed(
        ("greenhouse", g, {"slug": "acme"}), ("lever", l, {"slug": "acme"}), ("lever", {"ok": False}, {"slug": "x"}),
        ("ashby", {"jobs": [{"jobUrl": "https://a/1", "title": "T", "location": "L", "descriptionPlain": "d"}]}, {"slug": "acme"}),
        ("workable", w, {"slug": "acme"}))))
    by = {r["source"]: r for r in rows}
    assert sorted(by) == ["ashby", "greenhouse", "lever", "workable"] and len(rows) == 4
    assert by["greenhouse"]["description"] == "a & b" and by["lever"]["url"] == "https://l/1"
    assert (by["workable"]["location"], by["workable"]["remote"], by["workable"]["company"]) == ("C, U", False, "acme")
    assert by["lever"]["source_rank"] == 5


def test_workday(landed):
    m = {"host": "acme.wd3.example.com", "site": "S"}
    listed = {"jobPostings": [{"title": "T1", "externalPath": "/job/1", "locationsText": "2 Locations"},
                              {"title": "again", "externalPath": "/job/1"}, {"title": "T2", "externalPath": "/job/2", "locationsText": "Leeds"}]}
    info = {"jobPostingInfo": {"title": "Full T1", "jobDescription": "<p>d</p>", "startDate": "2026-07-20",
                               "location": "London", "additionalLocations": ["Leeds", ""]}}
    rows = _rows(src.REGISTRY["workday"](landed(
        ("workday", listed, {**m, "kind": "list"}), ("workday", listed, {**m, "kind": "list"}),
        ("workday", info, {**m, "kind": "detail", "path": "/job/1"}), ("workday", listed, {"host": "x", "kind": "list"}))))
    assert [(r["title"], r["location"], r["company"]) for r in rows] == [
        ("Full T1", "London", "acme"), ("Full T1", "Leeds", "acme"), ("T2", "Leeds", "acme")]
    assert rows[2]["url"] == "https://acme.wd3.example.com/en-US/S/job/2" and rows[2]["posted_at"] is None


def test_oracle(landed):
    m = {"host": "bank.oc.example.com", "site": "CX", "name": "Bank"}
    reqs = [{"Id": "7", "Title": "T", "PrimaryLocation": "London", "PostedDate": "2026-07-20", "ShortDescriptionStr": "d",
             "secondaryLocations": [{"Name": "Leeds"}, "Bath", {"Other": 1}]},
            {"Id": 8, "Title": "U"}, {"Title": "no id"}]
    rows = _rows(src.REGISTRY["oracle"](landed(("oracle", {"items": [{"requisitionList": reqs}]}, m), ("oracle", {"items": []}, m))))
    assert [(r["title"], r["location"]) for r in rows] == [("T", "London"), ("T", "Leeds"), ("T", "Bath"), ("U", "")]
    assert rows[0]["url"] == "https://bank.oc.example.com/hcmUI/CandidateExperience/en/sites/CX/job/7"


def test_failed_sources(landed):
    from sightline.sources.registry import live_sources
    payloads = landed(("reed", None, {"error": "401"}), ("adzuna", "<html>", {}), ("adzuna", {"results": []}, {}),
                      ("lever", [], {}), ("linkedin", "<html>", {}))
    assert {(r["source"], r["error_detail"], r["errors"]) for r in src.source_errors(payloads).collect()} == {
        ("reed", "401", 1), ("adzuna", "unreadable reply", 1)}
    assert {r["source"] for r in live_sources(payloads).collect()} == {"lever", "linkedin"}
    with pytest.raises(ValueError):
        src.read_sources(payloads, enabled=[])
    assert src.read_sources(payloads, only="lever").count() == 0


def test_one_bad_detail_or_closed_board_does_not_fail_a_source(landed):
    from sightline.sources.registry import live_sources, skipped_replies
    payloads = landed(
        ("reed", {"results": []}, {}), ("reed", "<html>", {"kind": "detail"}), ("workday", {"jobPostings": []}, {"kind": "list", "host": "h"}),
        ("workday", None, {"kind": "detail", "host": "h", "error": "500"}), ("workday", None, {"kind": "list", "host": "k"}),
        ("greenhouse", None, {"slug": "closed", "status": "404"}), ("lever", "<html>", {"slug": "odd"}), ("ashby", None, {"error": "timeout"}), ("linkedin", None, {"error": "429"}),
        ("oracle", None, {"host": "o"}), ("adzuna", None, {"error": "401"}))
    assert {r["source"] for r in live_sources(payloads).collect()} == {"reed", "workday", "greenhouse", "linkedin", "oracle"}
    assert {r["source"] for r in src.source_errors(payloads).collect()} == {"lever", "adzuna", "ashby"}
    assert sorted((r["source"], r["kind"], r["site"], r["error_detail"]) for r in skipped_replies(payloads).collect() if r["site"]) == [
        ("greenhouse", "list", "closed", "no reply"), ("oracle", "list", "o", "no reply"), ("workday", "detail", "h", "500"),
        ("workday", "list", "k", "no reply")]


def test_windows(spark):
    assert src.within_window(max_days=7, recent_days=1) == 24
    assert src.within_window(max_hours=168, recent_days=1) == 24
    assert src.within_window(max_days=7, recent_days=1, deep=True) == 168
    assert src.within_window(max_days=1, recent_days=7) == 24
    assert src.within_window(recent_days=1) is None


def test_first_wins_and_budget(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "b", 2), (4, "a", 2)], "id int, k string, o int")
    assert {r["id"] for r in first_wins(df, ["k"], ["o"]).collect()} == {2, 3}
    assert {r["id"] for r in src.budget_per_group(df, ["k"], 2, ["o"]).collect()} == {2, 3, 4}


def test_verdict_file(spark, tmp_path):
    f = tmp_path / "results.tsv"
    f.write_text("score\turl\tstatus\treport_num\n8.5\thttps://x/1\tapplied\t3\n4.1/5\t https://x/2 \t\t\n\t\tapplied\t\n")
    rows = src.read_verdicts(spark, str(f)).orderBy("seq").drop("seq").collect()
    assert [tuple(r) for r in rows] == [("https://x/1", 8.5, "applied", 3), ("https://x/2", 4.1, None, None)]
    g = tmp_path / "short.tsv"
    g.write_text("url\nhttps://x/9\n")
    assert src.read_verdicts(spark, str(g)).drop("seq").first().asDict() == {
        "url": "https://x/9", "score": None, "status": None, "report_num": None}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tenants_read_each_reply_once(landed):
    """Every reply is parsed once and its fields are read once; before, filters and date readers read them again."""
    rows = landed(("workday", {}, {"kind": "list"}), ("oracle", {}, {}), ("workable", {}, {}))
    shown = ["url", "company", "title", "location", "description", "posted_at"]
    for name, parses, reads in (("workday", 2, 4), ("oracle", 1, 4), ("workable", 1, 3)):
        plan = _plan(src.read_sources(rows, only=name).select(*shown))
        assert plan.count("parseJson") == parses and plan.count("try_variant_get") <= reads, name


def test_tenants_without_fields_or_places(landed):
    """Items that are no objects, fields of another kind and empty place lists give what single reads gave."""
    site = {"host": "a.wd3.x.com", "site": "S", "lang": "de-DE"}
    items = [7, {"externalPath": "/j/1", "title": {"t": 1}, "locationsText": "Leeds"}, {"externalPath": "/j/1", "title": "again"},
             {"externalPath": "/j/2"}, {"title": "no path"}]
    rows = _rows(src.read_sources(landed(
        ("workday", {"jobPostings": items}, {"kind": "list", **site}),
        ("workday", {"jobPostingInfo": None}, {"kind": "detail", "path": "/j/1", **site}),
        ("workday", {"jobPostingInfo": {"title": "T", "location": "", "additionalLocations": ["", "Bonn", "Köln"],
                                        "startDate": "2026-02-30"}}, {"kind": "detail", "path": "/j/2", **site})), only="workday"))
    assert [(r["url"][-4:], r["title"], r["location"], r["posted_at"]) for r in rows] == [
        ("/j/1", '{"t":1}', "Leeds", None), ("/j/2", "T", "Bonn", None), ("/j/2", "T", "Köln", None)]
    assert "de-DE" in rows[0]["url"] and rows[0]["raw"] == json.dumps(items[1], separators=(",", ":"), sort_keys=True)
    reqs = [None, 3, {"Id": 5, "Title": None, "PrimaryLocation": "", "secondaryLocations": [{"Name": "Rom"}, "Paris", {"x": 1}, None]},
            {"Id": "", "Title": "none"}, {"Id": "6", "secondaryLocations": "Leeds"}]
    rows = _rows(src.read_sources(landed(("oracle", {"items": [{"requisitionList": reqs}]}, {"host": "h", "site": "s"})), only="oracle"))
    assert [(r["url"][-6:], r["title"], r["location"]) for r in rows] == [
        ("/job/5", "", "Rom"), ("/job/5", "", "Paris"), ("/job/6", "", "")]


def test_landing_packs_all_sources_in_one_pass(spark):
    """One join of the tables for all providers; before, one for each of the six."""
    import re

    from sightline.plans import fixtures as fx
    from sightline.plans.q_sources import landed_replies
    out = landed_replies(fx.sightings(spark, "/root/testdata/sf0.001"))
    assert re.findall(r"Relation \[([a-z]+)_", _plan(out)).count("l") == 1
    assert {r["source"] for r in out.select("source").distinct().collect()} <= {
        "adzuna", "reed", "greenhouse", "ashby", "workable", "oracle"}


def test_workday_computes_its_replies_once(landed):
    """List and detail replies share one pass and one shuffle; before, what lies below was computed for each and joined."""
    rows = landed(("workday", {}, {"kind": "list"}))
    plan = src.read_sources(rows, only="workday").select("url", "location")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_workday_first_entry_and_first_detail(spark, landed):
    """The first of each by page and item, also over several replies; a detail alone, or without a clock, shows nothing."""
    site = {"host": "a.wd3.x.com", "site": "S"}
    job = lambda n, t: {"externalPath": n, "title": t, "locationsText": "Leeds"}
    rows = landed(
        ("workday", {"jobPostingInfo": {"jobDescription": "first"}}, {"kind": "detail", "path": "/1", **site}),
        ("workday", {"jobPostings": [job("/2", "two"), job("/1", "one"), job("/1", "again")]}, {"kind": "list", **site}),
        ("workday", {"jobPostings": [job("/1", "later")]}, {"kind": "list", **site}),
        ("workday", {"jobPostingInfo": {"jobDescription": "second"}}, {"kind": "detail", "path": "/1", **site}),
        ("workday", {"jobPostingInfo": {"jobDescription": "alone"}}, {"kind": "detail", "path": "/3", **site}),
        ("workday", {"jobPostingInfo": {"jobDescription": "no path"}}, {"kind": "detail", **site}))
    shown = lambda df: [(r["title"], r["description"]) for r in df.orderBy("pos").collect()]
    assert shown(src.REGISTRY["workday"](rows)) == [("two", ""), ("one", "first")]
    assert shown(src.REGISTRY["workday"](rows.withColumn("fetched_at", F.lit(None).cast("timestamp")))) == [("two", ""), ("one", "")]


def test_indeed_reads_fields_once(landed):
    """The fields of a result are read at once, after a key's first is found; before, by a read for each use (some thirty)."""
    shown = ["url", "company", "title", "location", "description", "posted_at", "salary_min", "salary_max", "currency", "remote"]
    plan = _plan(src.read_sources(landed(("indeed", {}, {})), only="indeed").select(*shown))
    assert plan.count("try_variant_get(item#") <= 3 and plan.count("parseJson") == 1


def test_indeed_first_of_a_key(landed):
    """A key's first result counts, in one reply and over replies of one scan."""
    job = lambda k, t, **more: {"job": {"key": k, "title": t, **more}}
    page = lambda *jobs: ("indeed", {"data": {"jobSearch": {"results": [*jobs]}}}, {})
    rows = landed(
        page(job("", "no key"), job("b", "b"), {"job": None}, 5, job("a", "a", location="text", attributes=[{"label": "WFH"}, 3]), job("a", "again")),
        page(job("a", "later"), job(7, "number"), job("c", "c", compensation={"baseSalary": {}, "estimated": {
            "currencyCode": "EUR", "baseSalary": {"unitOfWork": "year", "range": {"min": 1, "max": "x"}}}})),
        ("indeed", "<html>", {}), ("indeed", {"data": 3}, {}))
    got = _rows(src.REGISTRY["indeed"](rows))
    assert [(r["url"][-1], r["title"], r["remote"]) for r in got] == [
        ("b", "b", None), ("a", "a", True), ("7", "number", None), ("c", "c", None)]
    assert (got[3]["salary_min"], got[3]["salary_max"], got[3]["currency"]) == (1.0, None, "EUR")
    assert json.loads(got[1]["raw"])["title"] == "a" and got[1]["pos"] == {"page": 0, "item": 4}
