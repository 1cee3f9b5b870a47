"""Filters, lists, counts and text exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import escape_html
from ..operators import filters, ledger, views
from ..operators.filters import KeywordPolicy
from ..session import shared_dir
from . import fixtures as fx
from .fixtures import BOARD, BOARD_CLOCK, RUNS, SIGHTINGS, ts_text
from .registry import query

_CLOCK = f"timestamp '{BOARD_CLOCK}'"
_SEEN = "strftime(first_seen, '%Y-%m-%d %H:%M:%S') as first_seen"
_NEWEST = "first_seen desc nulls last, job_id"


def _as_of():
    return F.to_timestamp(F.lit(BOARD_CLOCK))


def _ids(df):
    return df.select("job_id", "status", ts_text("first_seen").alias("first_seen"))


def _with_board(sql: str) -> str:
    return f"with {BOARD} {sql}"


def _ids_sql(where: str) -> str:
    return _with_board(f"select job_id, status, {_SEEN} from board where {where}")


# --- keyword rules ----------------------------------------------------------------------------------

@query("title_filter", f"""
with {SIGHTINGS}
select url, title from v1 where (contains(lower(title), 'plate') or contains(lower(title), 'ring'))
  and not contains(lower(title), 'red') and not contains(lower(title), 'old')
""")
def title_filter(spark, sf):
    policy = KeywordPolicy(title_positive=("Plate", "RING"), title_negative=("red", "Old"))
    return fx.sightings(spark, sf).filter(policy.title_ok(F.col("title"))).select("url", "title")


@query("location_filter", f"""
with {SIGHTINGS}, r as (select url, case when l_returnflag = 'R' then '' when l_returnflag = 'A' and l_linestatus = 'F'
  then null else location end as location from v1)
select url, location from r where coalesce(location, '') = '' or (not contains(lower(location), 'nation_1')
  and (contains(lower(location), 'asia') or contains(lower(location), 'america')))
""")
def location_filter(spark, sf):
    flag = F.col("l_returnflag")
    place = F.when(flag == "R", "").when((flag == "A") & (F.col("l_linestatus") == "F"), None).otherwise(F.col("location"))
    policy = KeywordPolicy(place_allow=("Asia", "AMERICA"), place_block=("nation_1",))
    rows = fx.sightings(spark, sf).select("url", place.alias("location"))
    return rows.filter(policy.place_ok(F.col("location")))


@query("any_keyword", """
select doc_id from documents where contains(lower(text), 'license') or contains(lower(text), 'copyright')
  or contains(lower(text), 'http')
""")
def any_keyword(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.filter(filters.any_keyword(F.col("text"), ["License", "copyright", "http"])).select("doc_id")


@query("search_text", _with_board("""
select job_id, company from board
where contains(lower(concat(coalesce(title, ''), ' ', coalesce(company, ''), ' ', coalesce(description, ''))), 'license')
"""))
def search_text(spark, sf):
    return filters.search_text(fx.board(spark, sf), "  LICENSE ").select("job_id", "company")


@query("search_wildcard", _with_board("""
select job_id, company from board
where lower(concat(coalesce(title, ''), ' ', coalesce(company, ''), ' ', coalesce(description, ''))) like '%src1_ & e%'
"""))
def search_wildcard(spark, sf):
    """`%` and `_` in a query are wildcards."""
    return filters.search_text(fx.board(spark, sf), "src1_ & E").select("job_id", "company")


# --- row filters --------------------------------------------------------------------------------------

@query("lane_view", _with_board(f"""
select 'inbox' as lane, job_id from board where status in ('new', 'viewed')
union all select 'archived', job_id from board where status = 'archived'
union all select 'all', job_id from board
"""))
def lane_view(spark, sf):
    board = fx.board(spark, sf).select("job_id", "status")
    parts = [filters.lane(board, key).select(F.lit(key).alias("lane"), "job_id") for key in filters.LANES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("filter_city", _ids_sql("list_contains(locations, 'Remote')"))
def filter_city(spark, sf):
    return _ids(filters.in_city(fx.board(spark, sf), "Remote"))


@query("filter_source", _ids_sql("source = 'src7'"))
def filter_source(spark, sf):
    return _ids(filters.from_source(fx.board(spark, sf), "src7"))


@query("filter_salary", _ids_sql("salary_max is null or salary_max >= 20000"))
def filter_salary(spark, sf):
    return _ids(filters.min_salary(fx.board(spark, sf), 20000))


@query("recent_inbox", _ids_sql(
    f"status in ('new', 'viewed') and (first_seen is null or first_seen >= {_CLOCK} - interval 48 hour)"))
def recent_inbox(spark, sf):
    return _ids(filters.recent_inbox(fx.board(spark, sf), _as_of()))


@query("recent_new", _ids_sql(f"status = 'new' and first_seen >= {_CLOCK} - interval 48 hour"))
def recent_new(spark, sf):
    return _ids(filters.recent_new(fx.board(spark, sf), _as_of()))


@query("pending", _with_board("""
select job_id, url, company, title, location, source, cast(null as date) as posted_at, salary_min, salary_max,
  currency, cast(null as boolean) as remote from board where status = 'new'
"""))
def pending(spark, sf):
    return filters.pending(fx.board(spark, sf))


@query("by_id", _with_board(f"""
select job_id, source, company, title, url, status, score, {_SEEN} from board where job_id = substr(sha1('17'), 1, 16)
"""))
def by_id(spark, sf):
    row = filters.by_id(fx.board(spark, sf), "0716d9708d321ffb6a00818614779e779925365c"[:16])
    return row.select("job_id", "source", "company", "title", "url", "status", "score", ts_text("first_seen").alias("first_seen"))


# --- sorts and limits -----------------------------------------------------------------------------------

@query("list_newest", _with_board(f"""
select job_id, source, company, title, url, location, array_to_string(locations, ', ') as locations, status, score,
  eval_reason, salary_min, salary_max, currency, {_SEEN} from board order by {_NEWEST.replace('first_seen', 'board.first_seen')} limit 500
"""))
def list_newest(spark, sf):
    rows = views.newest(fx.board(spark, sf), views.LIST_LIMIT)
    return rows.withColumn("locations", F.array_join("locations", ", ")).withColumn(
        "first_seen", ts_text("first_seen")).drop("last_seen")


@query("top_scored", _with_board("""
select job_id, score, status, row_number() over (order by score desc, first_seen desc nulls last, job_id) as place
from board where score is not null
"""))
def top_scored(spark, sf):
    """All scored rows, best first, numbered."""
    rows = fx.board(spark, sf).filter(F.col("score").isNotNull())
    return views.numbered(rows, [F.desc("score"), *views.newest_first()]).select("job_id", "score", "status", "place")


def _page_sql(order: str, number: int, size: int, where: str = "true") -> str:
    return _with_board(f"""
, f as (select * from board where {where}), t as (select count(*) n, greatest(1, ceil(count(*) / {size}.0)) pages from f),
n as (select job_id, row_number() over (order by {order}) rn from f)
select job_id, n as total, cast(pages as bigint) as pages, cast(least({number}, pages - 1) + 1 as bigint) as page
from n, t where rn > least({number}, pages - 1) * {size} and rn <= (least({number}, pages - 1) + 1) * {size}
""")


_BEST_PLACE = "coalesce(nullif(locations[1], ''), nullif(location, ''), '—')"


@query("sort_score", _page_sql(f"coalesce(score, -1) desc, {_NEWEST}", 1, 25))
def sort_score(spark, sf):
    return views.page(fx.board(spark, sf), 1, 25, views.sort_order("score")).select(
        "job_id", "total", "pages", "page")


@query("sort_company", _page_sql(f"company, {_NEWEST}", 0, 25))
def sort_company(spark, sf):
    return views.page(fx.board(spark, sf), 0, 25, views.sort_order("company", None)).select("job_id", "total", "pages", "page")


@query("sort_location", _page_sql(f"{_BEST_PLACE}, {_NEWEST}", 2, 25))
def sort_location(spark, sf):
    return views.page(fx.board(spark, sf), 2, 25, views.sort_order("location", None)).select(
        "job_id", "total", "pages", "page")


@query("page_slice", _page_sql(_NEWEST, 1_000_000, 8, "status = 'new'"))
def page_slice(spark, sf):
    """A page number past the end gives the last page."""
    rows = fx.board(spark, sf).filter(F.col("status") == "new")
    return views.page(rows, 1_000_000, 8).select("job_id", "total", "pages", "page")


@query("capped_view", _with_board(f"""
select job_id, status from (select * from board order by {_NEWEST} limit 1000) where status = 'new'
"""))
def capped_view(spark, sf):
    """The newest 1000 first, then the filter."""
    return views.capped(fx.board(spark, sf), 1000).filter(F.col("status") == "new").select("job_id", "status")


@query("triage_candidates", _with_board(f"""
select job_id, company from board where status = 'new' and evaluated_at is null order by {_NEWEST} limit 200
"""))
def triage_candidates(spark, sf):
    return views.candidates(fx.board(spark, sf), max_jobs=200).select("job_id", "company")


@query("triage_skipped", _with_board("""
select count(*) as candidates, greatest(0, count(*) - 200) as skipped from board where status = 'new' and evaluated_at is null
"""))
def triage_skipped(spark, sf):
    return views.skipped(fx.board(spark, sf), max_jobs=200)


@query("recent_runs", f"""
with {RUNS}
select run_id, engine, strftime(started_at, '%Y-%m-%d %H:%M:%S') as started_at from runs
order by runs.started_at desc, run_id limit 50
""")
def recent_runs(spark, sf):
    return ledger.recent_runs(fx.runs(spark, sf), ledger.RUNS_SHOWN).select("run_id", "engine", ts_text("started_at").alias("started_at"))


# --- counts -----------------------------------------------------------------------------------------------

@query("funnel", _with_board("select coalesce(status, 'total') as stage, count(*) as n from board group by rollup (status)"))
def funnel(spark, sf):
    return views.funnel(fx.board(spark, sf))


@query("count_scored", _with_board("select count(score) as scored from board"))
def count_scored(spark, sf):
    return views.count_scored(fx.board(spark, sf))


@query("lane_counts", _with_board("""
select count(*) filter (where status in ('new', 'viewed')) as inbox, count(*) filter (where status = 'archived') as archived,
  count(*) as "all" from board
"""))
def lane_counts(spark, sf):
    return views.lane_counts(fx.board(spark, sf))


@query("older_count", _with_board(f"""
select count(*) as older from board where status in ('new', 'viewed') and first_seen < {_CLOCK} - interval 48 hour
"""))
def older_count(spark, sf):
    return views.older_count(fx.board(spark, sf), _as_of())


@query("stage_counts", _with_board("""
select stage, count(job_id) as n from (values ('saved'), ('applied'), ('rejected')) t(stage)
left join board on status = stage group by stage
"""))
def stage_counts(spark, sf):
    return views.stage_counts(fx.board(spark, sf))


@query("funnel_stages", _with_board("""
select 0 as pos, 'Discovered' as stage, count(*) as n from board
union all select 1, 'Scored', count(score) from board
union all select 2, 'New', count(*) from board where status = 'new'
union all select 3, 'Saved', count(*) from board where status = 'saved'
union all select 4, 'Applied', count(*) from board where status = 'applied'
union all select 5, 'Rejected', count(*) from board where status = 'rejected'
"""))
def funnel_stages(spark, sf):
    return views.funnel_stages(fx.board(spark, sf))


@query("untriaged_count", _with_board("select count(*) as untriaged from board where status = 'new' and score is null"))
def untriaged_count(spark, sf):
    return views.untriaged_count(fx.board(spark, sf))


@query("facet_cities", _with_board("select distinct value from (select unnest(locations) as value from board) where value <> ''"))
def facet_cities(spark, sf):
    return views.facet(fx.board(spark, sf), "locations")


@query("facet_sources", _with_board("select distinct source as value from board where source <> ''"))
def facet_sources(spark, sf):
    return views.facet(fx.board(spark, sf), "source")


# --- usage ------------------------------------------------------------------------------------------------

@query("usage_totals", f"""
with {RUNS}
select cast(coalesce(sum(scored), 0) as bigint) as scored, cast(coalesce(sum(scored), 0) + coalesce(sum(errors), 0) as bigint) as calls,
  cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens,
  cast(sum(cache_read_tokens) as bigint) as cache_read_tokens, round(sum(cost_usd), 4) as cost_usd, count(*) as runs from runs
""")
def usage_totals(spark, sf):
    return ledger.usage_totals(fx.runs(spark, sf))


@query("usage_by_engine", f"""
with {RUNS}
select coalesce(engine, '?') as engine, count(*) as runs, cast(coalesce(sum(scored + errors), 0) as bigint) as calls,
  round(coalesce(sum(cost_usd), 0), 4) as cost_usd from runs group by 1
""")
def usage_by_engine(spark, sf):
    return ledger.usage_by_engine(fx.runs(spark, sf))


@query("api_cost", f"with {RUNS} select round(coalesce(sum(cost_usd), 0), 4) as api_cost from runs where engine = 'anthropic'")
def api_cost(spark, sf):
    return ledger.api_cost(fx.runs(spark, sf))


@query("usage_rows", f"""
with {RUNS}, t as (select *, input_tokens + cache_read_tokens + cache_write_tokens tin from runs)
select run_id, coalesce(engine, stage) as engine, coalesce(scored, 0) + coalesce(errors, 0) as calls,
  concat(cast(scored as varchar), '/', cast(jobs as varchar)) as done,
  concat(case when tin >= 1000 then printf('%.1fk', tin / 1000) else cast(tin as varchar) end, ' / ',
    case when output_tokens >= 1000 then printf('%.1fk', output_tokens / 1000) else cast(output_tokens as varchar) end) as tokens,
  case when note = 'auth failed' then 'not logged in' when budget_hit then 'limit'
    when coalesce(errors, 0) > 0 then concat(cast(errors as varchar), ' err') else '' end as flag from t
""")
def usage_rows(spark, sf):
    return ledger.usage_rows(fx.runs(spark, sf))


# --- texts --------------------------------------------------------------------------------------------------

def _esc(e: str) -> str:
    return (f"replace(replace(replace(replace(replace(coalesce({e}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), chr(39), '&#x27;')")


_SALARY = """case when salary_min > 0 and salary_max > 0 and salary_min = salary_max then klo
    when salary_min > 0 and salary_max > 0 then concat(klo, '–', khi) when salary_max > 0 then concat('≤', khi)
    when salary_min > 0 then concat(klo, '+') else '' end"""
_K = "concat(sign, cast(cast(round_even({0} / 1000, 0) as bigint) as varchar), 'k')"
_CARDS = f"""
{BOARD}, s as (select *, case currency when 'EUR' then '€' when 'USD' then '$' else '£' end sign from board),
k as (select *, {_K.format('salary_min')} klo, {_K.format('salary_max')} khi from s),
cards as (select job_id, status, first_seen, concat(
  case when score is null then '⚪' when score >= 7 then '🟢' when score >= 5 then '🟡' else '🔴' end, ' ',
  case when score is null then '' else concat('<b>', cast(cast(round_even(score, 0) as bigint) as varchar), '/10</b> ') end,
  '<a href="', {_esc('url')}, '">', {_esc('title')}, '</a>', chr(10), '   <i>',
  array_to_string(list_filter([{_esc('company')},
    case when len(locations) > 0 then array_to_string(locations, ', ') when coalesce(location, '') <> '' then location else 'N/A' end,
    {_SALARY}, {_esc('source')}], lambda x: x <> ''), ' · '), '</i>',
  case when coalesce(eval_reason, '') = '' then '' else concat(chr(10), '   ✨ ', {_esc('eval_reason')}) end) as card from k)
"""


@query("card_text", f"with {_CARDS} select job_id, card from cards")
def card_text(spark, sf):
    board = fx.board(spark, sf)
    return board.select("job_id", views.cards(board).alias("card"))


@query("escape_html", f"select page_id, {_esc('html')} as escaped from pages")
def escape(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", escape_html(F.col("html")).alias("escaped"))


@query("new_digest", f"""
with {_CARDS}, n as (select * from cards where status = 'new'), c as (select count(*) n from n)
select 0 as pos, concat('🆕 <b>', cast(n as varchar), '</b> new job match(es):', chr(10)) as line from c where n > 0
union all select rn, card from (select *, row_number() over (order by {_NEWEST}) rn from n) where rn <= 10
union all select 11, concat(chr(10), '…and ', cast(n - 10 as varchar), ' more — send /jobs to browse all') from c where n > 10
""")
def new_digest(spark, sf):
    return views.digest(fx.board(spark, sf).filter(F.col("status") == "new"))


@query("pending_export", _with_board("""
select concat('- [ ] ', url, ' | ', company, ' | ', title) as line from board where status = 'new'
union all select '## Pending' union all select ''
"""))
def pending_export(spark, sf):
    """Written as text and read back line by line."""
    path = shared_dir(spark, "pending") + "/list"
    views.write_pending(fx.board(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")
