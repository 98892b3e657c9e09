"""Queries of fleets, whole years of heat, and a provider's answers about accounts."""

from pyspark.sql import functions as F

from talliard.functions.metrics import tokens
from talliard.operators import fleet, rollup, views
from talliard.operators.merge import merge_activity
from talliard.plans.catalog import TOK, merged, query
from talliard.plans.oracle import ACTIVITY, MERGED, keyed
from talliard.sources import adapter, quota
from talliard.tables import table

_NOW = "1999-06-30 12:00:00"
_LAST = "1998-06-17"


@query("pr_25_account_days", f"""with o as (select o_custkey, case when o_orderkey % 900 = 7 then '1997-02-30' else strftime(o_orderdate, '%Y-%m-%d') end as d, case when o_orderkey % 700 = 5 then -1 else cast(floor(o_totalprice) as bigint) end as n,
  o_orderkey % 900 = 7 or o_orderkey % 700 = 5 or o_orderdate > timestamp '{_NOW}' as bad from orders)
select concat('a_', o_custkey) as acct, d as date, max(n) as total_tokens from o where o_custkey not in (select o_custkey from o where bad) group by all""")
def pr_25(spark, sf_dir):
    """A customer's orders as one answer; some have a date or a count that cannot be."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    date = F.when(k % 900 == 7, "1997-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    bucket = F.struct(date.alias("startDate"), F.when(k % 700 == 5, F.lit(-1)).otherwise(F.floor("o_totalprice").cast("long")).alias("tokens"))
    answers = o.groupBy("o_custkey").agg(F.collect_list(bucket).alias("bs"))  # a customer's orders
    rows = answers.select(F.concat(F.lit("a_"), "o_custkey").alias("acct"), F.lit(_NOW).cast("timestamp").alias("observed_at"), F.parse_json(F.to_json(F.struct(F.col("bs").alias("dailyUsageBuckets")))).alias("v"))
    return quota.account_days(rows, _NOW).select("acct", "date", "total_tokens")


@query("cx_10_heat_weeks", f"""with {MERGED}, {ACTIVITY}, d as (select date, cast(sum({TOK}) as bigint) as value, 0::bigint as prompts from m where tok_in % 5 > 0 and cast(substr(date, 9, 2) as int) % 6 > 0 group by all
  union all select strftime(cast(date as timestamp) - interval 2200 days, '%Y-%m-%d'), 0, count(*) from am group by all),
f as (select date, sum(value) as value, sum(prompts) as prompts from d where date <= '{_LAST}' group by all),
sp as (select strftime(unnest(generate_series(cast(date_trunc('week', timestamp '{_LAST}') as timestamp) - interval 364 days, timestamp '{_LAST}', interval 1 day)), '%Y-%m-%d') as date),
x as (select date, cast(row_number() over (order by date) - 1 as int) as n, cast(coalesce(value, 0) as bigint) as value, cast(coalesce(prompts, 0) as bigint) as prompts from sp left join f using (date)),
q as (select quantile_cont(value, [0.25, 0.5, 0.75]) as q from x where value > 0)
select date, n // 7 as week, n % 7 as weekday, value, prompts, case when value <= 0 then 0 when value <= q[1] then 1 when value <= q[2] then 2 when value <= q[3] then 3 else 4 end as level, prompts > 0 and value <= 0 as untracked from x cross join q""")
def cx_10_weeks(spark, sf_dir):
    """Usage of five days in six, and prompts of another time moved into the year."""
    used = merged(spark, sf_dir).where("tok_in % 5 > 0 and cast(substr(date, 9, 2) as int) % 6 > 0").select("date", tokens().cast("long").alias("value"), F.lit(0).cast("long").alias("prompts"))
    asked = merge_activity(adapter.activity_events(spark, sf_dir)).select(F.date_format(F.date_sub(F.to_date("date"), 2200), "yyyy-MM-dd").alias("date"), F.lit(0).cast("long").alias("value"), F.lit(1).cast("long").alias("prompts"))
    return views.heat_weeks(used.unionByName(asked), F.col("value"), F.col("prompts"), _LAST)


def _machines(spark, sf_dir):
    """Suppliers as machines: some without a label, a country that is none, or never seen."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    start = F.lit("1999-01-01").cast("timestamp")
    return s.select(
        F.concat(F.lit("m_"), F.lpad(k.cast("string"), 6, "0")).alias("id"), F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name")).alias("label"), F.when(k % 3 == 0, "DE").when(k % 3 == 1, "xx").alias("cc"), F.lit("linux").alias("os"),
        F.when(k % 5 > 0, F.timestamp_add("SECOND", -(k % 1200).cast("int"), F.lit(_NOW).cast("timestamp"))).alias("last_seen_at"), F.when(k % 7 > 0, F.timestamp_add("HOUR", (k * 37 % 1000).cast("int"), start)).alias("enrolled_at"), F.lit("secret").alias("token"),
    )


_SEEN = f"""ma as (select concat('m_', lpad(cast(s_suppkey as varchar), 6, '0')) as id, case when s_suppkey % 4 = 0 then concat('m_', lpad(cast(s_suppkey as varchar), 6, '0')) else s_name end as label, case when s_suppkey % 3 = 0 then 'DE' else '' end as cc, 'linux' as os,
  coalesce(s_suppkey % 5 > 0 and s_suppkey % 1200 < 600, false) as live, case when s_suppkey % 5 > 0 then timestamp '{_NOW}' - to_seconds(s_suppkey % 1200) end as last_seen_at, case when s_suppkey % 7 > 0 then timestamp '1999-01-01' + to_hours(s_suppkey * 37 % 1000) end as first_seen_at from supplier)"""


@query("fi_14_public_machines", f"with {_SEEN} select * from ma")
def fi_14(spark, sf_dir):
    return fleet.public_machines(_machines(spark, sf_dir), _NOW)


@query("fi_14_anonymous_machines", f"with {_SEEN} select id, concat('Machine ', row_number() over (order by coalesce(first_seen_at, timestamp '0001-01-01'), id)) as label, live from ma")
def fi_14_anonymous(spark, sf_dir):
    return fleet.anonymous(fleet.public_machines(_machines(spark, sf_dir), _NOW)).select("id", "label", "live")


@query("ag_25_totals", f"with {MERGED}, {_SEEN}, a as (select distinct provider, acct from m where acct <> '') select count(*) as accounts, {', '.join(f'''count_if(provider = '{p}') as accounts_{p}''' for p in adapter.PROVIDERS)}, (select count(*) from ma) as machines, (select count_if(live) from ma) as machines_live from a")
def ag_25(spark, sf_dir):
    return fleet.totals(fleet.public_machines(_machines(spark, sf_dir), _NOW), merged(spark, sf_dir).where("acct <> ''"), adapter.PROVIDERS)


@query("jn_18_one_index", f"""with {MERGED}, x as (select coalesce(nullif(machine, ''), 'unknown') as machine, substr(date, 1, 7) as f from m group by all),
l as (select machine, list(f) as a from x where f >= '1997' and machine <> 'm_1' group by machine), d as (select machine, list(f) as b from x where f < '1998' and machine <> 'm_2' group by machine)
select machine, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') as files, case when b is null then 'live' when a is null then 'deployed' else 'both' end as source from l full join d using (machine)""")
def jn_18(spark, sf_dir):
    """Months of machines as two indexes that overlap in a year; each lacks one machine."""
    months = merged(spark, sf_dir).select(rollup.named("machine").alias("machine"), F.substring("date", 1, 7).alias("f")).distinct()
    index = lambda rows: rows.groupBy("machine").agg(F.collect_set("f").alias("files"))  # noqa: E731  a machine's months
    found = fleet.one_index(index(months.where("f >= '1997' and machine <> 'm_1'")), index(months.where("f < '1998' and machine <> 'm_2'")))
    return found.select("machine", F.array_join("files", ",").alias("files"), "source")


_KEY = b"synthetic key of the tests"


@query("sc_13_account_quotas", f"""with c as (select *, case c_custkey % 5 when 0 then 'anthropic' when 1 then 'openai' when 2 then 'xai' when 3 then 'cursor' else 'google' end as provider from customer where c_custkey % 13 <> 4 and c_custkey % 17 <> 3 and c_custkey % 19 <> 2),
w as (select *, 'week' as w, c_acctbal / 100 as used, 'ok' as status from c union all select *, 'session', null, '' from c where c_custkey % 3 > 0)
select provider, concat('a_', substr({keyed(_KEY, "provider || '|' || c_name")}, 1, 16)) as acct, case when c_custkey % 2 = 0 then concat('a_', substr({keyed(_KEY, "provider || '|org:o' || (c_custkey % 7)")}, 1, 16)) else '' end as org, case when c_custkey % 2 = 0 then 'team' else '' end as org_kind,
  w as window, used as used_percent, timestamp '1999-06-01' + to_hours(c_custkey % 900) as resets_at, timestamp '{_NOW}' - to_minutes(c_custkey % 500) as observed_at, status from w where used is null or used between 0 and 100""")
def sc_13(spark, sf_dir):
    """Customers as documents: some of another form, of a time to come, or of a kind that is none; windows below zero or of unknown names."""
    k = F.col("c_custkey")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    now = F.lit(_NOW).cast("timestamp")
    reset = iso(F.timestamp_add("HOUR", (k % 900).cast("int"), F.lit("1999-06-01").cast("timestamp")))
    none = F.lit(None).cast("double")
    window = lambda name, used, status: F.struct(F.lit(name).alias("window"), used.alias("usedPercent"), reset.alias("resetsAt"), F.lit(status).alias("status"))
    windows = F.array_compact(F.array(window("week", F.col("c_acctbal") / 100, "ok"), F.when(k % 3 > 0, window("session", none, "")), window("month", none, ""), window("plan", none, "odd")))
    team = k % 2 == 0
    document = F.to_json(F.struct(
        F.when(k % 13 == 4, 2).otherwise(1).alias("schema"), F.element_at(F.array(*map(F.lit, adapter.PROVIDERS)), (k % 5 + 1).cast("int")).alias("provider"), F.col("c_name").alias("accountId"), F.when(team, F.concat(F.lit("o"), k % 7)).alias("orgId"),
        F.when(k % 17 == 3, "club").when(team, "team").alias("orgKind"), iso(F.when(k % 19 == 2, F.timestamp_add("HOUR", F.lit(1), now)).otherwise(F.timestamp_add("MINUTE", -(k % 500).cast("int"), now))).alias("observedAt"), windows.alias("windows"),
    ))
    found = quota.account_quotas(table(spark, sf_dir, "customer").select(document.alias("value")), _KEY, _NOW)
    return found.select("provider", "acct", "org", "org_kind", "window", "used_percent", "resets_at", "observed_at", "status")
