"""Adapters. Sightings are packed into each provider's reply shape and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import sources as src
from ..session import shared_dir
from ..sources.registry import live_sources
from ..sources.search_apis import adzuna, indeed, reed
from ..sources.boards import ashby, greenhouse, lever, workable
from ..sources.html_cards import linkedin
from ..sources.tenants import oracle, workday
from ..sources.search_apis import reed_detail
from . import fixtures as fx
from .fixtures import SIGHTINGS, ts_text
from .registry import query

_OUT = ("source", "company", "title", "url", "location", "description", "jd_full", "posted_at",
        "salary_min", "salary_max", "currency", "remote")


# A text key that both engines can form.
def _key():
    return F.concat_ws("-", *[F.col(f"pos.{c}").cast("string") for c in (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])


_SQL_KEY = "concat_ws('-', o1, o2, o3, o4, o5)"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_OUT)


def _sql(source: str, where: str = "true", **cols: str) -> str:
    """The projection an adapter should yield; columns not named are the plain sighting's."""
    base = {
        "company": "company", "title": "title", "url": "url", "location": "location",
        "description": "description", "jd_full": "true", "posted_at": "cast(null as date)",
        "salary_min": "cast(null as double)", "salary_max": "cast(null as double)",
        "currency": "cast(null as varchar)", "remote": "cast(null as boolean)", **cols,
    }
    shown = ", ".join(f"{expr} as {name}" for name, expr in base.items())
    return f"with {SIGHTINGS} select '{source}' as source, {shown} from v1 where {where}"


def _reply(source: str, payload, **meta) -> dict:
    """What a landed reply says of itself, by column."""
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v)]
    tags = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return {"source": F.lit(source), "payload": payload, "meta": tags}


def _land(rows: DataFrame, reply: dict) -> DataFrame:
    """One landed reply per sighting."""
    return rows.select(
        reply["source"].alias("source"), reply["payload"].alias("payload"), "fetched_at",
        F.xxhash64("pos").alias("page"), reply["meta"].alias("meta"))


def _payloads(rows: DataFrame, source: str, payload, **meta) -> DataFrame:
    return _land(rows, _reply(source, payload, **meta))


def _obj(**cols):
    return F.struct(*[c.alias(k) for k, c in cols.items()])


def _day(fmt="yyyy-MM-dd"):
    return F.date_format("posted_at", fmt)


# Markup and entities around the plain description, as the providers send them.
def _markup():
    return F.concat(F.lit(" <p>"), F.col("description"), F.lit("</p>\n"))


def adzuna_reply() -> dict:
    item = _obj(
        redirect_url=F.col("url"), title=F.concat(F.lit("<strong>"), "title", F.lit("</strong>")),
        company=_obj(display_name=F.col("company")), location=_obj(display_name=F.col("location")),
        description=_markup(), created=F.concat(_day(), F.lit("T09:00:00Z")),
        salary_min=F.col("salary_min"), salary_max=F.col("salary_max"))
    no_link = _obj(
        redirect_url=F.lit(""), title=F.col("title"), company=_obj(display_name=F.col("company")),
        location=_obj(display_name=F.col("location")), description=F.col("description"), created=_day(),
        salary_min=F.col("salary_min"), salary_max=F.col("salary_max"))
    return _reply("adzuna", F.to_json(_obj(results=F.array(no_link, item))), country=F.lit("gb"))


def adzuna_replies(rows: DataFrame) -> DataFrame:
    return _land(rows, adzuna_reply())


@query("src_adzuna", _sql("adzuna", posted_at="posted_at", salary_min="salary_min",
                          salary_max="salary_max", currency="'GBP'"))
def src_adzuna(spark, sf):
    return _shown(adzuna(adzuna_replies(fx.sightings(spark, sf))))


def reed_reply() -> dict:
    day = F.when(F.col("l_linestatus") == "F", _day("dd/MM/yyyy")).otherwise(_day())
    item = _obj(
        jobId=F.xxhash64("pos"), jobUrl=F.col("url"), jobTitle=F.col("title"), employerName=F.col("company"),
        locationName=F.col("location"), jobDescription=_markup(), date=day,
        minimumSalary=F.col("salary_min"), maximumSalary=F.col("salary_max"))
    return _reply("reed", F.to_json(_obj(results=F.array(item))), kind=F.lit("search"))


def reed_replies(rows: DataFrame) -> DataFrame:
    return _land(rows, reed_reply())


@query("src_reed", _sql("reed", jd_full="false", posted_at="posted_at", salary_min="salary_min",
                        salary_max="salary_max", currency="'GBP'"))
def src_reed(spark, sf):
    return _shown(reed(reed_replies(fx.sightings(spark, sf))))


def reed_details(rows: DataFrame) -> DataFrame:
    """A third of the replies has no text, another part cannot be read."""
    flag = F.col("l_returnflag")
    body = F.when(flag == "R", F.lit("<br/> ")).otherwise(_markup())
    payload = F.when((flag == "N") & (F.col("l_linestatus") == "F"), "<html>busy</html>").otherwise(
        F.to_json(_obj(jobDescription=body)))
    return _payloads(rows, "reed", payload, kind=F.lit("detail"), listing_id=F.col("url"))


@query("src_reed_detail", f"""
with {SIGHTINGS}
select url as listing_id, case when l_returnflag = 'R' or (l_returnflag = 'N' and l_linestatus = 'F')
  then null else description end as description from v1
""")
def src_reed_detail(spark, sf):
    return reed_detail(reed_details(fx.sightings(spark, sf))).select("listing_id", "description")


def indeed_replies(rows: DataFrame) -> DataFrame:
    """Every reply shows its listing twice, and once more without a key."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    pay = lambda unit, on: F.when(on, _obj(
        unitOfWork=F.lit(unit), range=_obj(min=F.col("salary_min"), max=F.col("salary_max"))))
    job = lambda key, title: _obj(job=_obj(
        key=key, title=title, datePublished=F.unix_millis(F.col("posted_at").cast("timestamp")),
        employer=_obj(name=F.col("company")), description=_obj(html=_markup()),
        location=_obj(
            city=F.col("n_name"), admin1Code=F.lit(""), countryName=F.col("r_name"),
            formatted=_obj(long=F.when(flag == "A", F.col("location")))),
        compensation=_obj(
            baseSalary=pay("HOUR", flag == "R"),
            estimated=_obj(currencyCode=F.lit("EUR"), baseSalary=pay("year", line == "F")),
            currencyCode=F.col("currency")),
        attributes=F.array(_obj(label=F.when(flag == "N", "Work from home").otherwise("Full time")))))
    key = _key()
    results = F.array(job(F.lit(""), F.col("title")), job(key, F.col("title")), job(key, F.lit("again")))
    return _payloads(rows, "indeed", F.to_json(_obj(data=_obj(jobSearch=_obj(results=results)))))


_YEARLY = "l_linestatus = 'F' and l_returnflag <> 'R'"


@query("src_indeed", _sql(
    "indeed", url=f"concat('https://uk.indeed.com/viewjob?jk=', {_SQL_KEY})", posted_at="posted_at",
    salary_min=f"case when {_YEARLY} then salary_min end",
    salary_max=f"case when {_YEARLY} then salary_max end",
    currency=f"case when {_YEARLY} then coalesce(currency, 'EUR') end",
    remote="case when l_returnflag = 'N' then true end"))
def src_indeed(spark, sf):
    return _shown(indeed(indeed_replies(fx.sightings(spark, sf))))


def linkedin_replies(rows: DataFrame) -> DataFrame:
    link = F.concat(F.lit("https://uk.linkedin.com/jobs/view/"), _key())
    card = lambda title: F.concat(
        F.lit('<li>\n<a href="'), link, F.lit('?trk=x"></a><h3 class="base-search-card__title"> '), title,
        F.lit(' </h3><h4 class="base-search-card__subtitle"><a href="#">'), F.col("company"),
        F.lit(' &amp;\n Co</a></h4><span class="job-search-card__location"> '), F.col("location"),
        F.lit('</span><time datetime="'), _day(), F.lit('">2 days ago</time></li>'))
    page = F.concat(F.lit("<ul><li>sponsored</li>"), card(F.col("title")), card(F.lit("again")), F.lit("</ul>"))
    return _payloads(rows, "linkedin", page)


@query("src_html_cards", _sql("linkedin", company="concat(company, ' & Co')", url=f"concat('https://uk.linkedin.com/jobs/view/', {_SQL_KEY})",
                              description="''", posted_at="posted_at"))
def src_html_cards(spark, sf):
    return _shown(linkedin(linkedin_replies(fx.sightings(spark, sf))))


def greenhouse_reply() -> dict:
    content = F.concat(F.lit("&lt;p class=&quot;x&quot;&gt;"), F.replace(F.col("description"), F.lit("&"), F.lit("&amp;")),
                       F.lit("&lt;/p&gt;"))
    item = _obj(absolute_url=F.col("url"), title=F.col("title"), location=_obj(name=F.col("location")), content=content)
    return _reply("greenhouse", F.to_json(_obj(jobs=F.array(item))), slug=F.col("company"))


def greenhouse_replies(rows: DataFrame) -> DataFrame:
    return _land(rows, greenhouse_reply())


@query("src_greenhouse", _sql("greenhouse"))
def src_greenhouse(spark, sf):
    return _shown(greenhouse(greenhouse_replies(fx.sightings(spark, sf))))


def lever_replies(rows: DataFrame) -> DataFrame:
    """Top-level array; replies of one kind are an object instead and give nothing."""
    flag = F.col("l_returnflag")
    item = _obj(
        hostedUrl=F.when(flag == "A", F.col("url")).otherwise(""), applyUrl=F.col("url"), text=F.col("title"),
        categories=_obj(location=F.col("location")), descriptionPlain=F.col("description"))
    payload = F.when(flag == "R", '{"ok": false}').otherwise(F.to_json(F.array(item)))
    return _payloads(rows, "lever", payload, slug=F.col("company"))


@query("src_lever", _sql("lever", where="l_returnflag <> 'R'"))
def src_lever(spark, sf):
    return _shown(lever(lever_replies(fx.sightings(spark, sf))))


def ashby_reply() -> dict:
    item = _obj(jobUrl=F.when(F.col("l_returnflag") != "A", F.col("url")), title=F.col("title"),
                location=F.col("location"), descriptionPlain=F.col("description"))
    return _reply("ashby", F.to_json(_obj(jobs=F.array(item))), slug=F.col("company"))


def ashby_replies(rows: DataFrame) -> DataFrame:
    return _land(rows, ashby_reply())


@query("src_ashby", _sql("ashby", where="l_returnflag <> 'A'"))
def src_ashby(spark, sf):
    return _shown(ashby(ashby_replies(fx.sightings(spark, sf))))


def workable_reply() -> dict:
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    item = _obj(
        url=F.when(flag == "A", F.col("url")).otherwise(""), shortlink=F.when(flag == "N", F.col("url")),
        application_url=F.col("url"), title=F.col("title"), city=F.col("n_name"),
        state=F.lit(""), country=F.col("r_name"), description=_markup(), published_on=_day(),
        telecommuting=F.when(flag != "R", line == "F"))
    payload = F.to_json(_obj(name=F.when(line == "F", F.col("company")), jobs=F.array(item)))
    return _reply("workable", payload, slug=F.lit("slug"))


def workable_replies(rows: DataFrame) -> DataFrame:
    return _land(rows, workable_reply())


@query("src_workable", _sql(
    "workable", company="case when l_linestatus = 'F' then company else 'slug' end", posted_at="posted_at",
    remote="case when l_returnflag <> 'R' then l_linestatus = 'F' end"))
def src_workable(spark, sf):
    return _shown(workable(workable_replies(fx.sightings(spark, sf))))


def workday_replies(rows: DataFrame) -> DataFrame:
    """A list reply that names its posting twice, and for most postings a detail reply."""
    flag = F.col("l_returnflag")
    path = F.concat(F.lit("/job/"), _key())
    posting = lambda t: _obj(title=t, externalPath=path, locationsText=F.col("location"))
    listed = F.to_json(_obj(jobPostings=F.array(posting(F.col("title")), posting(F.lit("again"))), total=F.lit(2)))
    info = _obj(
        title=F.when(flag == "A", F.upper("title")), jobDescription=_markup(), startDate=_day(),
        location=F.when(flag == "A", F.col("n_name")),
        additionalLocations=F.when(flag == "A", F.array(F.col("s_nation"), F.lit(""))),
        externalUrl=F.when(flag == "A", F.col("url")))
    # Both replies of a sighting in one pass over the rows.
    replies = F.array(
        F.struct(F.lit("list").alias("kind"), listed.alias("payload")),
        F.when(flag != "R", F.struct(F.lit("detail").alias("kind"), F.to_json(_obj(jobPostingInfo=info)).alias("payload"))))
    rows = rows.select("fetched_at", "pos", "company", path.alias("path"), F.explode(replies).alias("reply"))
    return _payloads(rows.filter(F.col("reply").isNotNull()), "workday", F.col("reply.payload"), kind=F.col("reply.kind"),
                     host=F.lit("acme.wd3.example.com"), site=F.lit("Careers"), name=F.col("company"), path=F.col("path"))


@query("src_workday", f"""
with {SIGHTINGS}, w as (
  select *, case when l_returnflag = 'A' then [n_name, s_nation] else [location] end places from v1)
select 'workday' as source, company, case when l_returnflag = 'A' then upper(title) else title end as title,
  case when l_returnflag = 'A' then url
    else concat('https://acme.wd3.example.com/en-US/Careers/job/', {_SQL_KEY}) end as url, unnest(places) as location,
  case when l_returnflag = 'R' then '' else description end as description, true as jd_full,
  case when l_returnflag <> 'R' then posted_at end as posted_at, cast(null as double) as salary_min,
  cast(null as double) as salary_max, cast(null as varchar) as currency, cast(null as boolean) as remote
from w
""")
def src_workday(spark, sf):
    return _shown(workday(workday_replies(fx.sightings(spark, sf))))


def oracle_reply() -> dict:
    """Other places are objects in some replies and plain text in others."""
    flag = F.col("l_returnflag")
    req = lambda others: F.to_json(_obj(items=F.array(_obj(TotalJobsCount=F.lit(1), requisitionList=F.array(_obj(
        Id=F.col("p_size"), Title=F.col("title"), PostedDate=_day(), ShortDescriptionStr=_markup(),
        PrimaryLocation=F.when(flag != "R", F.col("n_name")), secondaryLocations=others))))))
    payload = (
        F.when(flag == "A", req(F.array(_obj(Name=F.col("s_nation")))))
        .when(flag == "N", req(F.array(F.col("s_nation"), F.lit(""))))
        .otherwise(req(F.lit(None).cast("array<string>"))))
    return _reply("oracle", payload, host=F.lit("acme.oc.example.com"), site=F.lit("CX_1"),
                  name=F.when(F.col("l_linestatus") == "F", F.col("company")).otherwise(""))


def oracle_replies(rows: DataFrame) -> DataFrame:
    return _land(rows, oracle_reply())


@query("src_oracle", f"""
with {SIGHTINGS}, w as (
  select *, case when l_returnflag = 'R' then [''] else [n_name, s_nation] end places from v1)
select 'oracle' as source, case when l_linestatus = 'F' then company else 'acme' end as company, title,
  concat('https://acme.oc.example.com/hcmUI/CandidateExperience/en/sites/CX_1/job/', cast(p_size as varchar)) as url,
  unnest(places) as location, description, true as jd_full, posted_at, cast(null as double) as salary_min,
  cast(null as double) as salary_max, cast(null as varchar) as currency, cast(null as boolean) as remote
from w
""")
def src_oracle(spark, sf):
    return _shown(oracle(oracle_replies(fx.sightings(spark, sf))))


# Which provider stands for which part type when all sources are landed together.
_AS = {"economy": adzuna_reply, "large": reed_reply, "medium": greenhouse_reply, "promo": ashby_reply,
       "small": workable_reply, "standard": oracle_reply}


def landed_replies(rows: DataFrame) -> DataFrame:
    """Each sighting as its provider's reply, all in one pass over the rows."""
    replies = {kind: reply() for kind, reply in _AS.items()}

    def of_kind(name: str) -> Column:
        out = F  # the first `when` is the function's, the others are the column's
        for kind, reply in replies.items():
            out = out.when(F.col("source") == kind, reply[name])
        return out

    return _land(rows.filter(F.col("source").isin(*replies)), {c: of_kind(c) for c in ("source", "payload", "meta")})


def landing_table(spark, sf: str) -> DataFrame:
    """Replies of all sources, written and read back partitioned by source."""
    path = shared_dir(spark, "landing")
    landed_replies(fx.sightings(spark, sf)).write.partitionBy("source").parquet(path)
    return src.landed(spark, path)


@query("union_sources", f"""
with {SIGHTINGS}, w as (
  select *, case source when 'economy' then 'adzuna' when 'large' then 'reed' when 'medium' then 'greenhouse'
    when 'promo' then 'ashby' when 'small' then 'workable' else 'oracle' end provider,
    case source when 'economy' then 0 when 'large' then 1 when 'medium' then 4 when 'promo' then 6
      when 'small' then 7 else 9 end source_rank,
    case when source = 'standard' and l_returnflag <> 'R' then [n_name, s_nation]
      when source = 'standard' then [''] when source = 'promo' and l_returnflag = 'A' then []
      else [location] end places
  from v1)
select provider as source, source_rank, title, unnest(places) as location, description from w
""")
def union_sources(spark, sf):
    return src.read_sources(landing_table(spark, sf)).select(
        "source", "source_rank", "title", "location", "description")


def _broken(spark, sf: str) -> DataFrame:
    """Replies of which some never came and some are not JSON."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    broken = F.when((flag == "R") & (F.col("source") == "large"), F.lit(None)).when(
        (line == "F") & (F.col("source") == "small"), "<html>busy</html>").otherwise('{"results": []}')
    return fx.sightings(spark, sf).select(
        "source", broken.alias("payload"), "fetched_at", F.lit(0).cast("bigint").alias("page"),
        F.create_map(F.lit("error"), F.when(F.col("source") == "large", "timeout")).alias("meta"))


@query("source_errors", f"""
with {SIGHTINGS}, b as (
  select source, scan_ts, case when source = 'large' and l_returnflag = 'R' then 'timeout'
    when source = 'small' and l_linestatus = 'F' then 'unreadable reply' end failure from v1)
select source, strftime(scan_ts, '%Y-%m-%d %H:%M:%S') as fetched_at, 0 as found, 0 as new, 0 as dupes,
  0 as filtered, 1 as errors, min(failure) as error_detail
from b group by source, scan_ts having count(failure) > 0
""")
def source_errors(spark, sf):
    rows = src.source_errors(_broken(spark, sf))
    return rows.withColumn("fetched_at", ts_text("fetched_at"))


@query("live_sources", f"""
with {SIGHTINGS}, b as (
  select source, scan_ts, max(case when source = 'large' and l_returnflag = 'R' then 1
    when source = 'small' and l_linestatus = 'F' then 1 else 0 end) failed from v1 group by source, scan_ts)
select source, strftime(scan_ts, '%Y-%m-%d %H:%M:%S') as fetched_at from b where failed = 0
""")
def live(spark, sf):
    return live_sources(_broken(spark, sf)).withColumn("fetched_at", ts_text("fetched_at"))


@query("budget_per_location", f"""
with {SIGHTINGS}, r as (
  select *, row_number() over (partition by title, location order by posted_at desc, o1, o2, o3, o4, o5) rn from v1)
select title, location, url, posted_at from r where rn <= 10
""")
def budget(spark, sf):
    rows = src.budget_per_group(
        fx.sightings(spark, sf), ["title", "location"], 10, [F.desc("posted_at"), "pos"])
    return rows.select("title", "location", "url", "posted_at")


@query("freshness_window", f"""
with {SIGHTINGS}
select url, strftime(scan_ts, '%Y-%m-%d %H:%M:%S') as seen from v1
where (source in ('economy', 'large') and scan_ts >= timestamp '2001-11-01' - interval 90 day)
  or (source in ('medium', 'promo') and scan_ts >= timestamp '2001-11-01' - interval 30 day)
  or source in ('small', 'standard')
""")
def freshness(spark, sf):
    """Two sources with a 30-day window, two with 365 days tightened to 90, two without any."""
    rows = fx.sightings(spark, sf)
    as_of = F.to_timestamp(F.lit("2001-11-01"))
    own = {"economy": 365, "large": 365, "medium": 30, "promo": 30, "small": None, "standard": None}
    parts = [
        src.fresh_only(rows.filter(F.col("source") == name), F.col("fetched_at"), as_of,
                       src.within_window(max_days=days, recent_days=90))
        for name, days in own.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("url", ts_text("fetched_at").alias("seen"))


def verdict_cells(rows: DataFrame) -> DataFrame:
    """Text cells as a person would leave them: blanks, `8.5` and `4.1/5`."""
    score = F.col("score").cast("string")
    return rows.select(
        F.when(F.col("status") == "expired", "  ").otherwise(F.col("url")).alias("url"),
        F.when(F.col("status") == "saved", F.concat(score, F.lit("/5"))).otherwise(score).alias("score"),
        F.when(F.col("status") == "new", " ").otherwise(F.col("status")).alias("status"),
        F.when(F.col("salary_max").isNotNull(), F.col("doc_id").cast("string")).alias("report_num"))


@query("read_verdicts", f"""
with {fx.BOARD}
select url, score, case when status <> 'new' then status end as status,
  case when salary_max is not null then cast(doc_id as int) end as report_num from board where status <> 'expired'
""")
def verdicts(spark, sf):
    path = shared_dir(spark, "verdicts")
    verdict_cells(fx.board(spark, sf)).write.csv(path, sep="\t", header=True)
    return src.read_verdicts(spark, path).drop("seq")
