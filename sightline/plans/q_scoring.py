"""Scoring batches and their runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring, views
from . import fixtures as fx
from .fixtures import BOARD
from .q_functions import error_columns
from ..functions.replies import PROMPT_CHARS
from .registry import query

_WORDS = {"license": 4, "the": 3, "src1": 9, "und": -2}


@query("score_batch", f"""
with {BOARD}, p as (
  select *, lower(concat('Company: ', company, chr(10), 'Title: ', title, chr(10), 'Location(s): ',
    case when len(locations) > 0 then array_to_string(locations, ', ') when coalesce(location, '') <> '' then location
      else 'unspecified' end, chr(10), substr(trim(description, ' ' || chr(10) || chr(9) || chr(13)), 1, 6000), chr(10),
    'return only json: {{"score": <integer 0-10 fit>, "reason": "<one line>"}}.')) prompt
  from board where status = 'new' and evaluated_at is null)
select job_id, cast(greatest(0, least(10, case when contains(prompt, 'license') then 4 else 0 end
  + case when contains(prompt, 'the') then 3 else 0 end + case when contains(prompt, 'src1') then 9 else 0 end
  - case when contains(prompt, 'und') then 2 else 0 end)) as double) as score, 'keywords' as reason, 'scored' as outcome from p
""")
def score_batch(spark, sf):
    """All candidates, scored by the keyword scorer that ships with the package."""
    rows = views.candidates(fx.board(spark, sf)).withColumn("seq", F.lit(0).cast("bigint"))
    out = scoring.score_batch(rows, scoring.keyword_scorer(_WORDS), prompt_chars=PROMPT_CHARS)
    return out.select("job_id", "score", "reason", "outcome")


def attempt_log(spark, sf) -> DataFrame:
    """Events as attempts: the user is the run, the event number the order, errors as worded there."""
    e = error_columns(fx.table(spark, sf, "events"))
    n = F.col("event_id")
    reply = F.when(F.col("event_type") == "signup", "no json here").otherwise(
        F.concat(F.lit('{"score": '), (n % 15 - 2).cast("string"), F.lit(', "reason": "r"}')))
    # A fatal error needs a high value, so runs stop at different places.
    fatal = (F.col("value") > 60) | (n % 5 == 4)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("user_id").alias("run_id"), n.alias("seq"), n.cast("string").alias("job_id"),
        F.when(F.col("event_type") == "view", "claude-haiku-4-5").otherwise("unlisted").alias("model"),
        reply.alias("reply"), F.when(fatal, F.col("error_kind")).alias("error_kind"),
        F.when(fatal, F.col("error_message")).alias("error_message"),
        k.alias("input_tokens"), (k * 2).alias("output_tokens"), (k * 3).alias("cache_read_tokens"),
        (k * 4).alias("cache_write_tokens"),
        F.when(F.col("event_type") == "click", F.col("value") / 1000).alias("cost_usd"))


_LOG = """
log as (
  select user_id run_id, event_id seq, event_type, k,
    case when event_type = 'error' and (value > 60 or event_id % 5 = 4) then
        case when event_id % 5 in (1, 3) then 'auth' when event_id % 5 in (0, 2) then 'budget'
          when contains(cast(user_id as varchar), '429') then 'budget' else 'other' end
      when event_type = 'signup' then 'other' else 'scored' end outcome,
    case when event_type = 'click' then value / 1000
      when event_type = 'view' then (k + k * 3 * cast(0.1 as double) + k * 4 * cast(1.25 as double)) / 1e6 * 1.0 + k * 2 / 1e6 * 5.0
      else cast(0 as double) end cost
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events)),
cut as (select l.*, stop from log l left join (
  select run_id, min(seq) stop from log where outcome in ('auth', 'budget') group by run_id) s on l.run_id = s.run_id),
ran as (select * from cut where stop is null or seq <= stop)
"""


@query("run_cutoff", f"with {_LOG} select run_id, seq, outcome from ran")
def run_cutoff(spark, sf):
    return scoring.cut_off(scoring.judge(attempt_log(spark, sf))).select("run_id", "seq", "outcome")


@query("run_summary", f"""
with {_LOG}, j as (select run_id, count(*) jobs from log group by run_id)
select ran.run_id, any_value(jobs) as jobs, count(*) filter (where outcome = 'scored') as scored,
  count(*) filter (where outcome = 'other') as errors,
  cast(coalesce(sum(case when outcome = 'scored' then k end), 0) as bigint) as input_tokens,
  cast(coalesce(sum(case when outcome = 'scored' then k * 2 end), 0) as bigint) as output_tokens,
  round(coalesce(sum(case when outcome = 'scored' then cost end), 0), 3) as cost_usd,
  max(case when outcome = 'auth' then 'auth failed' else '' end) || max(case when outcome = 'budget' then 'rate/usage limit' else '' end) as note
from ran join j on ran.run_id = j.run_id group by ran.run_id
""")
def run_summary(spark, sf):
    rows = scoring.run_summary(scoring.judge(attempt_log(spark, sf)))
    return rows.select("run_id", "jobs", "scored", "errors", "input_tokens", "output_tokens",
                       F.round("cost_usd", 3).alias("cost_usd"), "note")


@query("request_dedup", """
with l as (
  select event_id, ts, case when event_type in ('signup', 'error') then '*' else cast(user_id as varchar) end key,
    case when event_type in ('error', 'purchase') then 'done' else 'ask' end kind from events),
d as (select *, count(*) filter (where kind = 'done') over (partition by key order by ts, event_id) dones from l),
f as (select *, row_number() over (partition by key, dones order by ts, event_id) rn from d where kind = 'ask')
select key, event_id as seq from f where rn = 1
""")
def request_dedup(spark, sf):
    """Sign-ups ask for a batch, errors end it; other events ask for or end the user's own request."""
    kind = F.col("event_type")
    log = fx.table(spark, sf, "events").select(
        F.when(kind.isin("signup", "error"), "*").otherwise(F.col("user_id").cast("string")).alias("key"),
        F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.when(kind.isin("error", "purchase"), "done").otherwise("ask").alias("kind"))
    return scoring.dedup_requests(log).select("key", "seq")
