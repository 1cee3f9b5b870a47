"""Test tables shaped as engine input, and the same shapes as SQL for the checks.

`sightings`   line items as sightings: part type = source, supplier = company, part = title,
              customer nation = place, ship date = scan time.
`board`       documents and labels as a vacancy table.
`runs`        events as a scoring ledger.
`replies`     conversation turns as scorer replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


WINDOW_HOURS = 180 * 24
PRIORITY = ("nation_3", "nation_7")
BOARD_CLOCK = "2024-03-01 00:00:00"
EVENT_CLOCK = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, clocks as timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of city names (column `name`); `PRIORITY` goes with it."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))


def ts_text(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def _location() -> Column:
    return F.concat("n_name", F.lit(", "), "r_name")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every location a sighting can have (column `location`), from the tables that spell it."""
    return _nations(spark, sf_dir).select(_location().alias("location"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    nation2 = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation"))
    # Customers meet the orders, not the line items, and names of nations come last: what a line item carries through
    # each shuffle is keys and its own columns.
    ordered = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_orderdate", "c_nationkey", "c_mktsegment")
    rows = (
        t("lineitem")
        .join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(nation2, "s_nationkey")
    )
    order = F.array(*[F.lit(x) for x in ("economy", "large", "medium", "promo", "small", "standard")])
    source = F.lower("p_type")
    return rows.select(
        source.alias("source"),
        (F.array_position(order, source) - 1).cast("int").alias("source_rank"),
        F.col("s_name").alias("company"), F.col("p_name").alias("title"),
        F.concat(F.lit("https://"), source, F.lit(".example.com/ad/"), F.col("l_orderkey").cast("string"),
                 F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("?jid="), F.col("l_partkey").cast("string"),
                 F.lit("&utm_source=feed#top")).alias("url"),
        _location().alias("location"),
        F.concat("p_brand", F.lit(" & "), "c_mktsegment").alias("description"),
        F.lit(True).alias("jd_full"),
        F.col("o_orderdate").cast("date").alias("posted_at"),
        F.col("l_extendedprice").alias("salary_min"),
        F.when(F.col("l_discount") < 0.05, F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("salary_max"),
        F.when(F.col("l_returnflag") == "A", "GBP").when(F.col("l_returnflag") == "N", "USD").alias("currency"),
        F.lit(None).cast("boolean").alias("remote"), F.lit(None).cast("variant").alias("raw"),
        F.col("l_shipdate").alias("fetched_at"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        "n_name", "r_name", "s_nation", "l_linestatus", "l_returnflag", "p_size",
    )


SIGHTINGS = """
v1 as (
  select lower(p_type) source, s_name company, p_name title,
    concat('https://', lower(p_type), '.example.com/ad/', cast(l_orderkey as varchar), '-',
           cast(l_linenumber as varchar), '?jid=', cast(l_partkey as varchar), '&utm_source=feed#top') url,
    concat('https://', lower(p_type), '.example.com/ad/', cast(l_orderkey as varchar), '-',
           cast(l_linenumber as varchar), '?jid=', cast(l_partkey as varchar)) clean_url,
    concat(n.n_name, ', ', r_name) location, concat(p_brand, ' & ', c_mktsegment) description,
    cast(o_orderdate as date) posted_at, l_extendedprice salary_min,
    case when l_discount < 0.05 then l_extendedprice * (1 + l_tax) end salary_max,
    case l_returnflag when 'A' then 'GBP' when 'N' then 'USD' end currency,
    cast(l_shipdate as timestamp) scan_ts,
    l_orderkey o1, l_linenumber o2, l_partkey o3, l_suppkey o4, l_extendedprice o5,
    n.n_name, r_name, n2.n_name s_nation, l_linestatus, l_returnflag, p_size,
    substr(sha1(concat(trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), '|',
      trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 /]', '', 'g'), ' +', ' ', 'g')))), 1, 16) vacancy_key
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation n on c_nationkey = n.n_nationkey join region on n.n_regionkey = r_regionkey
    join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
    join nation n2 on s_nationkey = n2.n_nationkey
)"""


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    doc, lang, n = F.col("doc_id").cast("string"), F.col("lang"), F.col("n_chars")
    labelled = F.col("quality").isNotNull()
    status = F.when(F.col("toxic") == 1, "archived").when(F.col("quality") == 0, "rejected")
    for source, name in (("src2", "saved"), ("src3", "applied"), ("src4", "viewed"), ("src5", "expired")):
        status = status.when(F.col("source") == source, name)
    seen = F.when(F.col("source") != "src9", F.to_timestamp(F.lit(BOARD_CLOCK))
                  - F.make_dt_interval(mins=(F.col("doc_id") * 7).cast("int")))
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    return docs.select(
        F.substring(F.sha1(doc), 1, 16).alias("job_id"),
        F.substring(F.sha1(F.concat(F.lit("v"), doc)), 1, 16).alias("vacancy_key"),
        "source", F.concat(F.lit("Group "), "source", F.lit(" & "), "lang").alias("company"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit("https://boards.example.com/"), "source", F.lit("/"), doc).alias("url"),
        F.when(lang == "en", "London, UK").when(lang == "de", "Remote").when(lang == "fr", "").alias("location"),
        F.when(lang == "en", texts("Edinburgh", "London")).when(lang == "de", texts("Remote"))
        .when(lang == "fr", texts()).alias("locations"),
        F.col("text").alias("description"), (F.col("source") != "src0").alias("jd_full"),
        F.lit(None).cast("date").alias("posted_at"),
        F.when(n % 3 != 0, n * F.lit(10.0)).alias("salary_min"),
        F.when(n % 4 != 0, n * F.lit(12.5)).alias("salary_max"),
        F.when(lang == "en", "GBP").when(lang.isin("de", "fr"), "EUR").alias("currency"),
        F.lit(None).cast("boolean").alias("remote"), status.otherwise("new").alias("status"),
        F.when(labelled, F.col("quality") * 6 + n % 5 - F.col("toxic") * 3).cast("double").alias("score"),
        F.lit(None).cast("int").alias("report_num"),
        F.when(labelled, F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias("eval_reason"),
        F.when(labelled, F.to_timestamp(F.lit(BOARD_CLOCK))).alias("evaluated_at"),
        F.when(labelled, "labels").alias("engine"), seen.alias("first_seen"),
        (seen + F.make_dt_interval(hours=(n % 50).cast("int"))).alias("last_seen"),
        F.lit(None).cast("variant").alias("raw"), "doc_id",
    )


BOARD = f"""
board as (
  select substr(sha1(cast(d.doc_id as varchar)), 1, 16) job_id,
    source, concat('Group ', source, ' & ', lang) company, split_part(text, chr(10), 1) title,
    concat('https://boards.example.com/', source, '/', cast(d.doc_id as varchar)) url,
    case lang when 'en' then 'London, UK' when 'de' then 'Remote' when 'fr' then '' end as location,
    case lang when 'en' then ['Edinburgh', 'London'] when 'de' then ['Remote']
      when 'fr' then cast([] as varchar[]) end locations,
    text as description, source <> 'src0' as jd_full,
    case when n_chars % 3 <> 0 then n_chars * cast(10.0 as double) end salary_min,
    case when n_chars % 4 <> 0 then n_chars * cast(12.5 as double) end salary_max,
    case when lang = 'en' then 'GBP' when lang in ('de', 'fr') then 'EUR' end currency,
    case when toxic = 1 then 'archived' when quality = 0 then 'rejected' when source = 'src2' then 'saved'
      when source = 'src3' then 'applied' when source = 'src4' then 'viewed'
      when source = 'src5' then 'expired' else 'new' end status,
    cast(case when quality is not null then quality * 6 + n_chars % 5 - toxic * 3 end as double) score,
    case when quality is not null then concat('quality ', cast(quality as varchar)) end eval_reason,
    case when quality is not null then timestamp '{BOARD_CLOCK}' end evaluated_at,
    case when source <> 'src9' then timestamp '{BOARD_CLOCK}' - to_minutes(cast(d.doc_id * 7 as bigint)) end first_seen,
    case when source <> 'src9' then timestamp '{BOARD_CLOCK}' - to_minutes(cast(d.doc_id * 7 as bigint))
      + to_hours(cast(n_chars % 50 as bigint)) end last_seen,
    d.doc_id
  from documents d left join labels l on d.doc_id = l.doc_id
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    engine = F.when(kind == "purchase", "anthropic").when(kind == "view", "claude-cli").when(
        kind != "error", kind)
    return e.select(
        F.col("event_id").cast("string").alias("run_id"), F.lit("triage").alias("stage"),
        F.when(kind == "purchase", "claude-sonnet-4-6").when(kind == "view", "claude-haiku-4-5")
        .otherwise("unlisted").alias("model"),
        engine.alias("engine"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"),
        (k + (F.col("event_id") % 3).cast("int")).alias("jobs"), k.alias("scored"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 3).cast("int").alias("errors"),
        (k * 100).cast("bigint").alias("input_tokens"), (k * 20).cast("bigint").alias("output_tokens"),
        (k * 80).cast("bigint").alias("cache_read_tokens"),
        (F.col("event_id") % 7).alias("cache_write_tokens"),
        (F.col("value") / 1000).alias("cost_usd"), (F.col("value") > 90).alias("budget_hit"),
        F.when(F.col("event_id") % 11 == 0, "auth failed").otherwise("").alias("note"),
        "user_id", "event_id",
    )


RUNS = """
runs as (
  select cast(event_id as varchar) run_id, 'triage' stage,
    case event_type when 'purchase' then 'claude-sonnet-4-6' when 'view' then 'claude-haiku-4-5'
      else 'unlisted' end model,
    case event_type when 'purchase' then 'anthropic' when 'view' then 'claude-cli'
      when 'error' then null else event_type end engine,
    ts started_at, k + event_id % 3 jobs, k scored,
    case when event_id % 7 <> 0 then event_id % 3 end errors,
    k * 100 input_tokens, k * 20 output_tokens, k * 80 cache_read_tokens, event_id % 7 cache_write_tokens,
    value / 1000 cost_usd, value > 90 budget_hit,
    case when event_id % 11 = 0 then 'auth failed' else '' end note, user_id, event_id
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events)
)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer replies in the forms seen in practice: plain, fenced, in prose, none."""
    c = table(spark, sf_dir, "conversations")
    score = F.length("text") % 14 - 1
    body = F.concat(F.lit('{"score": '), score.cast("string"), F.lit(', "reason": "'), "role", F.lit('"}'))
    form = (F.col("conv_id") + F.col("turn")) % 4
    reply = (
        F.when(form == 0, body).when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Here you are: "), body, F.lit(" Done."))).otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", "role", "text", score.alias("raw_score"), form.alias("form"),
                    reply.alias("reply"))


REPLIES = """
replies as (
  select conv_id, turn, role, text, length(text) % 14 - 1 raw_score, (conv_id + turn) % 4 form
  from conversations
)"""
