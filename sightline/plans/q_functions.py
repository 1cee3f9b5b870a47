"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..sources.search_apis import annual_salary, location_text, remote_flag
from . import fixtures as fx
from .fixtures import BOARD, EVENT_CLOCK, REPLIES, RUNS, SIGHTINGS
from ..functions.replies import ERROR_CHARS, PROMPT_CHARS
from .registry import query

_UNESCAPED = ("replace(replace(replace(regexp_replace({0}, '&amp;?', chr(1), 'g'), '&middot;', '·'), "
              "'&copy;', '©'), '&quot;', '\"')")


def _unescaped(expr: str) -> str:
    """The entities the pages hold; chr(1) keeps a decoded & from starting a new entity."""
    return f"replace({_UNESCAPED.format(expr)}, chr(1), '&')"


@query("strip_tags", "select page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) as text from pages")
def strip_tags(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", fn.strip_tags(F.col("html")).alias("text"))


@query("canonical_url", "select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') as url from pages")
def canonical_url(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", fn.canonical_url(F.col("url")).alias("url"))


@query("clean_url", """
with p as (
  select page_id, regexp_replace(url, '[?#].*$', '') as base,
    list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
      lambda x: x <> '' and not starts_with(lower(x), 'utm_')
        and lower(split_part(x, '=', 1)) not in ('gh_src', 'source', 'ref', 'referrer')) as kept
  from pages)
select page_id, case when len(kept) > 0 then concat(base, '?', array_to_string(kept, '&')) else base end as url from p
""")
def clean_url(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", fn.clean_url(F.col("url")).alias("url"))


@query("unescape_html", f"select page_id, {_unescaped('html')} as text from pages")
def unescape_html(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", fn.unescape_all(F.col("html")).alias("text"))


@query("html_text", f"""
select page_id, trim(regexp_replace(regexp_replace({_unescaped("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")},
  '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) as heading from pages
""")
def html_text(spark, sf):
    heading = F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)
    return fx.table(spark, sf, "pages").select("page_id", fn.html_text(heading).alias("heading"))


@query("norm_company", """
select doc_id, trim(regexp_replace(regexp_replace(lower(concat(source, ' (', lang, ') ', text)),
  '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as company from documents
""")
def norm_company(spark, sf):
    name = F.concat("source", F.lit(" ("), "lang", F.lit(") "), "text")
    return fx.table(spark, sf, "documents").select("doc_id", fn.norm_company(name).alias("company"))


@query("norm_role", """
select doc_id, trim(regexp_replace(regexp_replace(replace(replace(lower(concat(lang, '/', source, '(', text, ')')),
  '(', ' '), ')', ' '), '[^a-z0-9 /]', '', 'g'), ' +', ' ', 'g')) as role from documents
""")
def norm_role(spark, sf):
    name = F.concat("lang", F.lit("/"), "source", F.lit("("), "text", F.lit(")"))
    return fx.table(spark, sf, "documents").select("doc_id", fn.norm_role(name).alias("role"))


# A third of the companies is blanked, so the fallback to the link is used too.
_KEYED = f"""
with {SIGHTINGS}, k as (
  select url, o1, o2, o3, case when l_returnflag = 'R' then ' - ' else company end company, title,
    regexp_replace(url, '[?#].*$', '') canon from v1),
n as (select *, trim(regexp_replace(regexp_replace(lower(company), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) c,
    trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 /]', '', 'g'), ' +', ' ', 'g')) r from k),
t as (select *, case when c <> '' and r <> '' then concat(c, '|', r) end vacancy_text from n)
"""


def _keyed(spark, sf):
    rows = fx.sightings(spark, sf)
    return rows.withColumn("company", F.when(F.col("l_returnflag") == "R", " - ").otherwise(F.col("company")))


@query("vacancy_text", _KEYED + "select url, vacancy_text from t")
def vacancy_text(spark, sf):
    text = fn.vacancy_text(F.col("company"), F.col("title"))
    return _keyed(spark, sf).select("url", text.alias("vacancy_text"))


@query("vacancy_key", _KEYED + "select url, substr(sha1(coalesce(vacancy_text, canon)), 1, 16) as vacancy_key from t")
def vacancy_key(spark, sf):
    key = fn.vacancy_key(F.col("company"), F.col("title"), F.col("url"))
    return _keyed(spark, sf).select("url", key.alias("vacancy_key"))


@query("job_id", """
with e as (select event_id, concat(cast(user_id as varchar), event_type) vkey,
  case when event_type = 'error' then date_trunc('second', ts) else ts end ts from events)
select event_id, substr(sha1(concat(vkey, '|', strftime(ts, '%Y-%m-%dT%H:%M:%S'),
  case when strftime(ts, '%f') = '000000' then '' else concat('.', strftime(ts, '%f')) end, '+00:00')), 1, 16) as job_id
from e
""")
def job_id(spark, sf):
    e = fx.table(spark, sf, "events")
    ts = F.when(F.col("event_type") == "error", F.date_trunc("second", "ts")).otherwise(F.col("ts"))
    vkey = F.concat(F.col("user_id").cast("string"), F.col("event_type"))
    return e.select("event_id", fn.job_id(vkey, ts).alias("job_id"))


@query("clean_city", f"""
with {SIGHTINGS}, r as (
  select url, case when l_returnflag = 'R' and l_linestatus = 'F' then concat('Remote, ', r_name)
    when l_returnflag = 'R' then concat('Wales near', n_name, ' / england')
    when l_returnflag = 'N' then concat('Hybrid: ', s_nation, ' or ', n_name)
    when l_linestatus = 'F' then '  ' else concat(n_name, ', uk') end raw, n_name, s_nation from v1),
m as (select *, regexp_extract_all(lower(raw), '\\bnation_[0-9]+\\b') as hits from r)
select url, raw, case
  when trim(raw) = '' then 'Unknown'
  when list_contains(hits, 'nation_3') then 'NATION_3'
  when list_contains(hits, 'nation_7') then 'NATION_7'
  when len(hits) = 2 and length(hits[2]) > length(hits[1]) then upper(hits[2])
  when len(hits) > 0 then upper(hits[1])
  when contains(lower(raw), 'remote') then 'Remote'
  when contains(lower(raw), 'wales') then 'Wales' else 'Unknown' end as city
from m
""")
def clean_city(spark, sf):
    rows = fx.sightings(spark, sf)
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    raw = (
        F.when((flag == "R") & (line == "F"), F.concat(F.lit("Remote, "), "r_name"))
        .when(flag == "R", F.concat(F.lit("Wales near"), "n_name", F.lit(" / england")))
        .when(flag == "N", F.concat(F.lit("Hybrid: "), "s_nation", F.lit(" or "), "n_name"))
        .when(line == "F", "  ").otherwise(F.concat("n_name", F.lit(", uk")))
    )
    located = rows.select("url", raw.alias("raw"))
    return fn.clean_city_table(located, "raw", fx.gazetteer(spark, sf), fx.PRIORITY).select("url", "raw", "city")


@query("order_cities", f"""
with {SIGHTINGS}
select url, case when n_name = s_nation then concat(n_name, case when n_name < 'Remote' then ', Remote' else '' end)
  else array_to_string(list_transform(list_sort(list_transform([n_name, s_nation, 'Remote'],
    lambda c: concat(case c when 'NATION_3' then '1' when 'NATION_7' then '2' else '3' end, c))),
    lambda x: substr(x, 2)), ', ') end as cities
from v1
""")
def order_cities(spark, sf):
    cities = F.array_distinct(F.array("n_name", "s_nation", F.lit("Remote")))
    ordered = fn.order_cities(cities, fx.PRIORITY)
    return fx.sightings(spark, sf).select("url", F.array_join(ordered, ", ").alias("cities"))


@query("parse_date_iso", """
select o_orderkey, case when o_orderpriority like '4%' or o_orderpriority like '5%' then null
  else cast(o_orderdate as date) end as day from orders
""")
def parse_date_iso(spark, sf):
    day, p = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")
    text = (
        F.when(p.startswith("1"), day).when(p.startswith("2"), F.concat(day, F.lit("T23:30:00Z")))
        .when(p.startswith("3"), F.concat(day, F.lit(" 00:15:00.5-05:00")))
        .when(p.startswith("4"), F.concat(day, F.lit("x"))).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    )
    return fx.table(spark, sf, "orders").select("o_orderkey", fn.parse_date_iso(text).alias("day"))


@query("parse_date_multi", """
select o_orderkey, case when o_orderpriority like '5%' then null else cast(o_orderdate as date) end as day from orders
""")
def parse_date_multi(spark, sf):
    p = F.col("o_orderpriority")
    form = lambda f: F.date_format("o_orderdate", f)
    text = (
        F.when(p.startswith("1"), form("dd/MM/yyyy")).when(p.startswith("2"), form("yyyy-MM-dd"))
        .when(p.startswith("3"), form("d/M/yyyy")).when(p.startswith("4"), form("yyyy-M-d"))
        .otherwise(form("yyyy/MM/dd"))
    )
    return fx.table(spark, sf, "orders").select("o_orderkey", fn.parse_date_multi(text).alias("day"))


@query("epoch_ms_date", """
select event_id, case when event_type in ('error', 'click') then null else cast(ts as date) end as day from events
""")
def epoch_ms_date(spark, sf):
    kind = F.col("event_type")
    ms = F.when(kind == "error", 0).when(kind == "click", 9_223_372_036_854_775_807).otherwise(
        F.unix_millis("ts"))
    return fx.table(spark, sf, "events").select("event_id", fn.epoch_ms_date(ms).alias("day"))


@query("annual_salary", f"""
with {SIGHTINGS}
select url, case when l_linestatus = 'F' then salary_min end as pay_min,
  case when l_linestatus = 'F' then salary_max end as pay_max,
  case when l_linestatus = 'F' then currency end as pay_currency from v1
""")
def annual(spark, sf):
    unit = F.when(F.col("l_linestatus") == "F", "Year").when(F.col("l_returnflag") == "A", "HOUR")
    pay = annual_salary(unit, F.col("salary_min"), F.col("salary_max"), F.col("currency"))
    return fx.sightings(spark, sf).select("url", pay.alias("p")).select(
        "url", F.col("p.min").alias("pay_min"), F.col("p.max").alias("pay_max"),
        F.col("p.currency").alias("pay_currency"))


@query("location_text", f"""
with {SIGHTINGS}
select url, case when l_returnflag = 'A' then location when l_returnflag = 'N' then concat(n_name, ', ', r_name)
  else concat(n_name, ', ', s_nation, ', ', r_name) end as place from v1
""")
def place(spark, sf):
    flag = F.col("l_returnflag")
    text = location_text(
        F.when(flag == "A", F.col("location")), F.col("n_name"),
        F.when(flag == "N", "").otherwise(F.col("s_nation")), F.col("r_name"))
    return fx.sightings(spark, sf).select("url", text.alias("place"))


@query("remote_flag", f"""
with {SIGHTINGS}
select url, case when l_returnflag = 'A' or contains(lower(description), 'remote')
  or (l_returnflag = 'N' and l_linestatus = 'O') then true end as remote from v1
""")
def remote(spark, sf):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    label = F.when(flag == "A", "Fully REMOTE").when((flag == "N") & (line == "O"), "Work From Home").otherwise("On site")
    return fx.sightings(spark, sf).select("url", remote_flag(F.col("description"), label).alias("remote"))


@query("salary_label", f"""
with {SIGHTINGS}, s as (
  select url, case when l_returnflag = 'R' and l_linestatus = 'F' then 0 else salary_min end lo,
    case when l_linestatus = 'O' and l_returnflag = 'A' then salary_min else salary_max end hi,
    case currency when 'USD' then '$' else '£' end sign from v1),
k as (select *, concat(sign, cast(cast(round_even(lo / 1000, 0) as bigint) as varchar), 'k') klo,
    concat(sign, cast(cast(round_even(hi / 1000, 0) as bigint) as varchar), 'k') khi from s)
select url, case when lo > 0 and hi > 0 and lo = hi then klo when lo > 0 and hi > 0 then concat(klo, '–', khi)
  when hi > 0 then concat('≤', khi) when lo > 0 then concat(klo, '+') else '' end as salary from k
""")
def salary(spark, sf):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    lo = F.when((flag == "R") & (line == "F"), 0.0).otherwise(F.col("salary_min"))
    hi = F.when((line == "O") & (flag == "A"), F.col("salary_min")).otherwise(F.col("salary_max"))
    return fx.sightings(spark, sf).select("url", fn.salary_label(lo, hi, F.col("currency")).alias("salary"))


@query("score_band", f"""
with {BOARD}
select job_id, case when score is null then '' when score >= 7 then 'hi' when score >= 5 then 'mid' else 'lo' end as band,
  case when score is null then '⚪' when score >= 7 then '🟢' when score >= 5 then '🟡' else '🔴' end as dot from board
""")
def band(spark, sf):
    return fx.board(spark, sf).select(
        "job_id", fn.score_band(F.col("score")).alias("band"), fn.score_dot(F.col("score")).alias("dot"))


@query("location_chip", f"""
with {BOARD}
select job_id, case when len(locations) > 1 then concat(locations[1], ' +', cast(len(locations) - 1 as varchar))
  when len(locations) = 1 then locations[1] when coalesce(location, '') <> '' then location else '—' end as chip from board
""")
def chip(spark, sf):
    return fx.board(spark, sf).select(
        "job_id", fn.location_chip(F.col("locations"), F.col("location")).alias("chip"))


@query("location_list", f"""
with {BOARD}
select job_id, case when len(locations) > 0 then array_to_string(locations, ', ')
  when coalesce(location, '') <> '' then location else 'N/A' end as places from board
""")
def places(spark, sf):
    return fx.board(spark, sf).select(
        "job_id", fn.location_list(F.col("locations"), F.col("location")).alias("places"))


@query("age_label", f"""
with s as (select event_id, case when event_type <> 'signup' then ts end ts,
    epoch_us(timestamp '{EVENT_CLOCK}') - epoch_us(case when event_type = 'view'
      then timestamp '{EVENT_CLOCK}' - (timestamp '{EVENT_CLOCK}' - ts) / 500 else ts end) us, event_type from events),
a as (select event_id, ts, event_type, us / cast(1000000 as double) s from s)
select event_id, case when ts is null then ''
  when s < 3600 then concat(cast(greatest(1, cast(floor(s / 60 + 0.5) as bigint)) as varchar), 'm ago')
  when s < 86400 then concat(cast(cast(floor(s / 3600 + 0.5) as bigint) as varchar), 'h ago')
  else concat(cast(cast(floor(s / 86400 + 0.5) as bigint) as varchar), 'd ago') end as age,
  coalesce(ts is not null and s < 86400, false) as fresh from a
""".replace("(timestamp '{0}' - ts) / 500".format(EVENT_CLOCK),
            "to_microseconds((epoch_us(timestamp '{0}') - epoch_us(ts)) // 500)".format(EVENT_CLOCK)))
def age(spark, sf):
    """Views are moved close to the clock, so that minutes and hours occur as well as days."""
    e = fx.table(spark, sf, "events")
    as_of = F.to_timestamp(F.lit(EVENT_CLOCK))
    gap = F.unix_micros(as_of) - F.unix_micros("ts")
    kind = F.col("event_type")
    ts = F.when(kind == "view", F.timestamp_micros(F.unix_micros(as_of) - F.floor(gap / 500))).when(
        kind != "signup", F.col("ts"))
    return e.select("event_id", fn.age_label(ts, as_of).alias("age"), fn.is_fresh(ts, as_of).alias("fresh"))


@query("parse_reply", f"""
with {REPLIES}
select conv_id, turn, case when form <> 3 then cast(greatest(0, least(10, raw_score)) as double) end as score,
  case when form <> 3 then role end as reason from replies
""")
def parse_reply(spark, sf):
    rows = fx.replies(spark, sf).withColumn("v", fn.parse_reply(F.col("reply")))
    return rows.select("conv_id", "turn", F.col("v.score").alias("score"), F.col("v.reason").alias("reason"))


@query("reply_envelope", f"""
with {REPLIES}
select conv_id, turn, case when form = 0 then text when form = 1 then '' end as result,
  case when form = 2 then concat('scorer: ', substr(text, 1, 300)) when form = 3 then 'scorer: unknown error' end as error,
  case when form = 0 then length(text) else 0 end as input_tokens,
  case when form = 0 then turn else 0 end as output_tokens from replies
""")
def envelope(spark, sf):
    form, n = F.col("form"), F.length("text")
    env = (
        F.when(form == 0, F.to_json(F.struct(
            F.lit(False).alias("is_error"), F.lit("success").alias("subtype"), F.col("text").alias("result"),
            F.struct(n.alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage"))))
        .when(form == 1, "{}")
        .when(form == 2, F.to_json(F.struct(F.lit(True).alias("is_error"), F.col("text").alias("result"))))
        .otherwise('{"subtype": "error_max_turns"}')
    )
    rows = fx.replies(spark, sf).withColumn("e", fn.reply_envelope(env, max_error_chars=ERROR_CHARS))
    return rows.select(
        "conv_id", "turn", F.col("e.result").alias("result"), F.col("e.error").alias("error"),
        F.col("e.input_tokens").alias("input_tokens"), F.col("e.output_tokens").alias("output_tokens"))


@query("token_cost", f"""
with {RUNS}, b as (select *, input_tokens + cache_read_tokens * cast(0.1 as double)
    + cache_write_tokens * cast(1.25 as double) billed from runs)
select run_id, round(case model when 'claude-sonnet-4-6' then billed / 1e6 * 3 + output_tokens / 1e6 * 15
  when 'claude-haiku-4-5' then billed / 1e6 * 1 + output_tokens / 1e6 * 5 else cast(0 as double) end, 9) as cost from b
""")
def cost(spark, sf):
    rows = fx.runs(spark, sf)
    return rows.select("run_id", F.round(fn.token_cost(F.col("model"), F.col), 9).alias("cost"))


def error_columns(df):
    """Errors among the events, in the wordings that matter."""
    kind, k = F.col("event_type"), F.col("event_id") % 5
    is_error = kind == "error"
    name = F.when(is_error, F.when(k == 0, "RateLimitError").when(k == 1, "AuthenticationError").otherwise("RuntimeError"))
    text = F.when(is_error, F.when(k == 2, "Credit balance is too low").when(k == 3, "OAuth token: quota").otherwise(
        F.concat(F.lit("bad row "), F.col("user_id").cast("string"))))
    return df.withColumn("error_kind", name).withColumn("error_message", text)


@query("error_class", """
select event_id, case when event_type <> 'error' then null when event_id % 5 in (1, 3) then 'auth'
  when event_id % 5 in (0, 2) then 'budget' when contains(cast(user_id as varchar), '429') then 'budget'
  else 'other' end as error_class from events
""")
def error_class(spark, sf):
    e = error_columns(fx.table(spark, sf, "events"))
    return e.select("event_id", fn.error_class(F.col("error_kind"), F.col("error_message")).alias("error_class"))


@query("build_prompt", f"""
with {BOARD}, p as (select *, substr(trim(description, ' ' || chr(10) || chr(9) || chr(13)), 1, 6000) as jd from board)
select job_id, concat('Company: ', company, chr(10), 'Title: ', title, chr(10), 'Location(s): ',
  case when len(locations) > 0 then array_to_string(locations, ', ') when coalesce(location, '') <> '' then location
    else 'unspecified' end, chr(10), '<job_description>', chr(10),
  case when jd = '' then '(no description captured for this source)' else jd end, chr(10), '</job_description>', chr(10),
  'Return ONLY JSON: {{"score": <integer 0-10 fit>, "reason": "<one line>"}}.') as prompt from p
""")
def prompt(spark, sf):
    return fx.board(spark, sf).select("job_id", fn.build_prompt(F.col, PROMPT_CHARS).alias("prompt"))


@query("host_tenant", """
select page_id, regexp_extract(url, '://([^./]+)', 1) as tenant,
  case when page_id % 2 = 0 then regexp_extract(url, '://([^./]+)', 1) else 'Named' end as company from pages
""")
def tenant(spark, sf):
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    given = F.when(F.col("page_id") % 2 == 0, "").otherwise("Named")
    return fx.table(spark, sf, "pages").select(
        "page_id", fn.host_tenant(host).alias("tenant"), fn.host_tenant(host, given).alias("company"))
