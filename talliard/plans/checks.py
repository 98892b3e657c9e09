"""Queries of validation: rows of the tables with one planted fault each, and the first reason found."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talliard.functions import ids
from talliard.operators import validate
from talliard.plans.catalog import query
from talliard.plans.oracle import PROMPTS, USAGE
from talliard.sources import adapter
from talliard.tables import table

LATER = "2018-06-15 12:00:00"
KINDS = 24


def _faulty(rows: DataFrame, n: Column, faults: list[tuple[str, object]]) -> DataFrame:
    """Row n gets fault n modulo KINDS, if there is one of that number."""
    rows = rows.withColumn("fault", (n % KINDS).cast("int"))
    for k, (column, value) in enumerate(faults):
        rows = rows.withColumn(column, F.when(F.col("fault") == k, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(column)))
    return rows


def _sql_reason(names: list[str], n: str) -> str:
    return f"case {n} % {KINDS} " + " ".join(f"when {k} then '{c}'" for k, c in enumerate(names)) + " end"


def _hashed(mark: str, column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.concat(F.lit(mark), F.substring(F.sha2(F.col(column), 256), 1, 16))).otherwise("")


_COMMON = [("id", "0"), ("provider", "nobody"), ("tz_offset_min", 900), ("acct", "a_1"), ("acct_q", "guessed"), ("session", "s_1"), ("ws", "w_1")]
_NAMES = ["id", "source", "tz_offset_min", "acct", "acct_q", "session", "ws"]
_USAGE = [*_COMMON, ("q", "maybe"), ("ts_q", "never"), ("pv", -1), ("tok_in", -1), ("tok_out", 10**14), ("cache_w1h", 10**6)]
_USAGE_NAMES = [*_NAMES, "q", "ts_q", "pv", "tok_in", "tok_out"]


def _usage(spark, sf_dir) -> DataFrame:
    rows = adapter.usage_events(spark, sf_dir).withColumn("acct", _hashed("a_", "acct")).withColumn("ws", _hashed("w_", "ws")).withColumn("ts", F.expr("ts + interval 20 years"))
    return _faulty(rows, F.substring("seq", 1, 12).cast("long"), _USAGE)


_LATE = f"ts + interval 20 years > timestamp '{LATER}' + interval 2 days"
_USAGE_REASON = f"case when l % {KINDS} < 2 then {_sql_reason(_NAMES[:2], 'l')} when {_LATE} then 'ts' else {_sql_reason(_USAGE_NAMES, 'l')} end"
_JUDGED = f"{USAGE}, v as (select *, cast(substr(seq, 1, 12) as bigint) as l from u), j as (select *, {_USAGE_REASON} as reason, case when l % {KINDS} = 12 then 1000000 else cache_w1h end as hour from v)"


@query("fi_01_validation", f"with {_JUDGED} select reason, count(*) as n, cast(count_if(hour > cache_w) as bigint) as clamped, cast(sum(least(hour, cache_w)) as bigint) as cache_w1h from j group by all")
def fi_01(spark, sf_dir):
    rows = validate.judged(_usage(spark, sf_dir), LATER)
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("clamped").alias("clamped"), F.sum("cache_w1h").cast("long").alias("cache_w1h"))


@query("fi_06_routing", f"with {_JUDGED} select case when reason is null then 'accepted' else 'rejected' end as route, count(*) as n, cast(sum(least(hour, cache_w)) as bigint) as cache_w1h from j group by all")
def fi_06(spark, sf_dir):
    rows = validate.routed(_usage(spark, sf_dir), LATER)
    return rows.groupBy("route").agg(F.count("*").alias("n"), F.sum("cache_w1h").cast("long").alias("cache_w1h"))


@query("fi_02_activity_validation", f"select {_sql_reason(_NAMES, 'event_id')} as reason, count(*) as n, cast(count_if(event_type <> 'error') as bigint) as has_usage from events group by all")
def fi_02(spark, sf_dir):
    rows = adapter.activity_events(spark, sf_dir).withColumn("acct", _hashed("a_", "acct")).withColumn("ws", _hashed("w_", "ws"))
    rows = validate.judged_activity(_faulty(rows, F.col("seq").cast("long"), _COMMON), "2030-01-01 00:00:00")
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("has_usage").alias("has_usage"))


_PROMPT_NAMES = [*_NAMES, "text", "label", "model", "workspace"]


@query("fi_03_prompt_validation", f"""with {PROMPTS}, x as (select id, p0.text, conv_id, conv_id * 100 + turn as n, conv_id % 3 as k from p0 join p on p.id = substr(sha256(concat('v1|prompt|', p0.provider, '|', p0.source, '|', conv_id, ':', turn)), 1, 32)),
r as (select *, {_sql_reason(_PROMPT_NAMES, 'n')} as reason from x)
select id, reason, case k when 0 then 'timeline' when 1 then 'inferred' else 'recorded' end as acct_q, case when k <> 1 then 'name' else '' end as label,
  case when strlen(text) > 1064 then concat(left(text, cast(list_max(list_filter(range(0, 42), lambda j: strlen(left(text, cast(j as integer))) <= 40)) as integer)), '+') else text end as text from r where reason is null""")
def fi_03(spark, sf_dir):
    rows, k = adapter.prompt_records(spark, sf_dir), F.substring("seq", 1, 12).cast("long") % 3
    rows = rows.withColumn("acct", _hashed("a_", "acct")).withColumn("ws", F.lit("")).withColumn("acct_q", F.when(k == 2, "recorded").otherwise("")).withColumn("label", F.when(k != 1, "name").otherwise(""))
    faults = [*_COMMON, ("text", F.lit(None).cast("string")), ("label", F.repeat(F.lit("x"), F.lit(513))), ("model", F.repeat(F.lit("x"), F.lit(201))), ("workspace", F.repeat(F.lit("x"), F.lit(4097)))]
    rows = _faulty(rows, F.substring("seq", 1, 12).cast("long") * 100 + F.substring("seq", 13, 6).cast("long"), faults)
    return validate.judged_prompts(rows, "2030-01-01 00:00:00", 40, "+").where("reason is null").select("id", "reason", "acct_q", "label", "text")


_LIMIT = [
    ("id", "0"), ("source", "unheard"), ("win", "Two Words"), ("acct", "a_1"), ("acct_q", "guessed"), ("org", "o_1"), ("org_kind", "club"), ("observed_at", F.lit), ("used_percent", 100.5),
    ("resets_at", F.lit), ("plan", "a@b"), ("scope", "a\nb"), ("name", "x@y"), ("label", "no address"), ("status", "No!"), ("quota_source", "elsewhere"),
]
_LIMIT_NAMES = [c for c, _ in _LIMIT]


@query("fi_04_limit_validation", f"select {_sql_reason(_LIMIT_NAMES, 'o_orderkey')} as reason, count(*) as n, cast(count_if(o_custkey % 3 = 0) as bigint) as unowned from orders group by all")
def fi_04(spark, sf_dir):
    o, at = table(spark, sf_dir, "orders"), F.expr("o_orderdate + interval 24 years").cast("timestamp")
    empty = F.lit("")
    rows = o.select(
        "o_orderkey", "o_custkey", ids.event_id("limit", F.lit("openai"), F.lit("codex"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("openai").alias("provider"), F.lit("codex").alias("source"), F.lit("week").alias("win"),
        F.when((F.col("o_custkey") % 3 != 0) | (F.col("o_orderkey") % KINDS == 15), F.concat(F.lit("a_"), F.substring(F.sha2(F.col("o_custkey").cast("string"), 256), 1, 16))).otherwise("").alias("acct"),
        F.when(F.col("o_custkey") % 3 == 1, "recorded").otherwise("timeline").alias("acct_q"), F.lit("a_0123456789abcdef").alias("org"), F.lit("team").alias("org_kind"), at.alias("observed_at"),
        (F.col("o_totalprice") % 100).cast("double").alias("used_percent"), (at + F.expr("interval 5 days")).alias("resets_at"), F.lit("Pro").alias("plan"), empty.alias("scope"), F.lit("Some Team").alias("name"),
        empty.alias("detail"), F.lit("a@b.c").alias("label"), F.lit("full").alias("status"), F.when(F.col("o_custkey") % 3 == 1, "account-api").when(F.col("o_custkey") % 3 == 2, "login-timeline").alias("quota_source"),
    )
    faults = [(c, F.lit("2040-01-01").cast("timestamp") if v is F.lit else v) for c, v in _LIMIT]
    return validate.judged_limits(_faulty(rows, F.col("o_orderkey"), faults), "2030-01-01 00:00:00").groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("o_custkey") % 3 == 0).alias("unowned"))


_TOTAL_NAMES = ["id", "source", "acct", "acct_q", "timezone", "date", "date", "observed_at", "total_tokens"]


@query("fi_05_account_totals", f"select {_sql_reason(_TOTAL_NAMES, 'o_orderkey')} as reason, count(*) as n from orders group by all")
def fi_05(spark, sf_dir):
    at = F.expr("o_orderdate + interval 24 years").cast("timestamp")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", ids.event_id("account", F.lit("openai"), F.lit("codex"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("openai").alias("provider"), F.lit("codex").alias("source"), F.lit("a_0123456789abcdef").alias("acct"),
        F.lit("recorded").alias("acct_q"), F.lit("UTC").alias("timezone"), F.date_format(at, "yyyy-MM-dd").alias("date"), (at + F.expr("interval 1 day")).alias("observed_at"), F.floor("o_totalprice").cast("long").alias("total_tokens"),
    )
    faults = [("id", "0"), ("provider", "xai"), ("acct", ""), ("acct_q", "timeline"), ("timezone", "CET"), ("date", "2019-02-30"), ("date", "2019-2-3"), ("observed_at", F.lit("2015-01-01").cast("timestamp")), ("total_tokens", F.lit(None).cast("long"))]
    return validate.judged_account_totals(_faulty(rows, F.col("o_orderkey"), faults), "2030-01-01 00:00:00").groupBy("reason").agg(F.count("*").alias("n"))
