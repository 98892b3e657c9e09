"""All usage-analytics queries by name, with their SQL for the oracle."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from talliard.functions import ids
from talliard.functions.metrics import compact, effective, tokens
from talliard.operators import archive, asof, cost, history, limits, merge, reconcile, rollup, views
from talliard.plans import checks, evidence, fleets, lineage, logged, periods, readers, scalars  # noqa: F401  they register their queries
from talliard.plans.catalog import ORACLE_SQL, QUERIES, TOK, query
from talliard.plans.catalog import merged as _merged
from talliard.plans.catalog import tagged as _tagged
from talliard.plans.oracle import ACTIVITY, MERGED, PROMPTS, USAGE, keyed
from talliard.sources import adapter
from talliard.tables import staged

FLAGSHIP = "ag_01_day_rollup"
FIRST, LAST = "1996-01-01", "1997-12-31"
NOW, LATER = "1998-06-15 12:00:00", "2018-06-15 12:00:00"
KEY = b"synthetic key of the tests"


MEAS = ["tok_in", "cache_w", "cache_w1h", "cache_r", "tok_out", "reasoning", "calls"]
SUMS = ", ".join(f"cast(sum({m}) as bigint) as {m}" for m in MEAS)


@query("mg_01_usage_merge", f"with {MERGED} select * from m")
def mg_01(spark, sf_dir):
    return _merged(spark, sf_dir)


@query("mg_10_activity_merge", f"with {ACTIVITY} select * from am")
def mg_10(spark, sf_dir):
    return merge.merge_activity(adapter.activity_events(spark, sf_dir))


@query("mg_11_prompt_upsert", f"""with {PROMPTS} select id, provider, case when source = 'claude-code' then 'native-claude' else source end as source, ts, tz_offset_min, workspace, machine, session, text, model,
case when acct_q = 'recorded' then acct else 'a_late' end as acct, 'recorded' as acct_q, case when acct_q = 'recorded' then concat('name ', substr(acct, 3)) else 'late name' end as label from p""")
def mg_11(spark, sf_dir):
    """Each prompt once more, later: with other text and model, by the app's own channel, and of a recorded account."""
    p = adapter.prompt_records(spark, sf_dir)
    later = p.withColumns({"seq": F.concat(F.lit("9"), "seq"), "text": F.lit("a later sighting"), "model": F.when(F.col("model") == "", "").otherwise("model-late"), "acct": F.lit("a_late"), "acct_q": F.lit("recorded"), "label": F.lit("late name")})
    return merge.merge_prompts(p.unionByName(later.withColumn("source", F.when(F.col("source") == "claude-code", "native-claude").otherwise(F.col("source")))))


@query("mg_09_channels", f"""with {ACTIVITY} select id, case provider when 'anthropic' then 'web-claude' else source end as source, case provider when 'anthropic' then 'm_browser' else machine end as machine from am""")
def mg_09(spark, sf_dir):
    """Every event seen again by an app and a browser: better evidence of the client moves channel and reporter, for one provider only."""
    a = adapter.activity_events(spark, sf_dir)
    seen = lambda source, machine: a.where("provider = 'anthropic'").withColumns({"source": F.lit(source), "machine": F.lit(machine), "seq": F.concat(F.lit("9"), "seq")})
    return merge.merge_activity(a.unionByName(seen("native-claude", "m_app")).unionByName(seen("web-claude", "m_browser"))).select("id", "source", "machine")


@query("mg_14_unchanged_rows", f"with {MERGED} select id, tok_in, model from m where tok_in % 2 = 0")
def mg_14(spark, sf_dir):
    rows = _merged(spark, sf_dir).select("id", "tok_in", "model")
    return merge.changed(rows, rows.withColumn("tok_in", F.when(F.col("tok_in") % 2 == 0, F.col("tok_in") + 1).otherwise(F.col("tok_in"))))


@query("mg_18_account_first_last", f"with {MERGED} select provider, acct, min(ts) as first_seen, max(ts) as last_seen from m where acct <> '' group by all")
def mg_18(spark, sf_dir):
    return _merged(spark, sf_dir).where("acct <> ''").groupBy("provider", "acct").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("mg_17_evidence_spans", f"with {USAGE} select provider, acct, session, min(ts) as ts, max(greatest(ts, case when tok_in % 3 = 0 then ts + to_days(cast(tok_in % 50 as int)) end)) as to_ts from u where acct <> '' group by all")
def mg_17(spark, sf_dir):
    rows = adapter.usage_events(spark, sf_dir).where("acct <> ''").withColumn("to_ts", F.when(F.col("tok_in") % 3 == 0, F.timestamp_add("DAY", (F.col("tok_in") % 50).cast("int"), "ts")))
    return merge.widen_spans(rows, ["provider", "acct", "session"])


_TIERS = ", ".join(f"cast(sum(case when q = 'estimated' then {'0' if not e else m} else {m if not e else '0'} end) as bigint) as {'estimated' if e else 'exact'}_{m}" for e in (0, 1) for m in MEAS)


@query("ag_01_day_rollup", f"with {MERGED} select date, provider, {_TIERS}, count(*) as events, cast(count_if(q = 'estimated') as bigint) as estimated_events from m group by all")
def ag_01(spark, sf_dir):
    return rollup.by_provider(_merged(spark, sf_dir))


@query("ag_02_by_model", f"with {MERGED} select date, provider, q as tier, coalesce(nullif(model, ''), 'unknown') as model, {SUMS}, count(*) as events from m group by all")
def ag_02(spark, sf_dir):
    return rollup.by_model(_merged(spark, sf_dir))


_PLACES = " union all ".join(
    f"select date, provider, '{k}' as kind, {v} as place, cast(sum(tok_in) as bigint) as tok_in, cast(sum(cache_w) as bigint) as cache_w, cast(sum(cache_r) as bigint) as cache_r, cast(sum(tok_out) as bigint) as tok_out, count(*) as events from m group by all"
    for k, v in (("machine", "coalesce(nullif(machine, ''), 'unknown')"), ("country", "coalesce(nullif(cc, ''), 'ZZ')"), ("workspace", "coalesce(nullif(ws, ''), 'unknown')"), ("source", "source"))
)


@query("ag_03_places", f"with {MERGED} {_PLACES}")
def ag_03(spark, sf_dir):
    return rollup.by_places(_merged(spark, sf_dir))


@query("ag_05_accounts", f"with {MERGED} select date, provider, coalesce(string_agg(distinct nullif(acct, ''), ',' order by nullif(acct, '')), '') as accts, count(distinct nullif(acct, '')) as n_accts from m group by all")
def ag_05(spark, sf_dir):
    return rollup.accounts(_merged(spark, sf_dir))


@query("ag_06_ledger", f"with {MERGED} select strftime(ts, '%Y-%m-%d') as date, provider, source, case when acct_q in ('recorded', 'session', 'timeline', 'bounded') then acct else '' end as acct, cast(sum({TOK}) as bigint) as tokens from m group by all")
def ag_06(spark, sf_dir):
    return rollup.ledger(_merged(spark, sf_dir))


@query("ag_07_cells", f"""with {MERGED}, {ACTIVITY}, {PROMPTS},
x as (select date, provider, source, model, acct, q, {', '.join(MEAS)}, 1 as events, 0 as prompts, 0 as prompts_no_usage, 0 as model_prompts from m
  union all select date, provider, source, '', acct, '', {', '.join('0' for _ in MEAS)}, 0, 1, case when has_usage then 0 else 1 end, 0 from am
  union all select strftime(ts + to_minutes(tz_offset_min), '%Y-%m-%d'), provider, source, model, acct, '', {', '.join('0' for _ in MEAS)}, 0, 0, 0, 1 from p)
select date, provider, source, model, acct, q, {SUMS}, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('events', 'prompts', 'prompts_no_usage', 'model_prompts'))} from x group by all""")
def ag_07(spark, sf_dir):
    prompts = adapter.prompt_records(spark, sf_dir).withColumn("date", ids.local_date(F.col("ts"), F.col("tz_offset_min")))
    return rollup.cells(_merged(spark, sf_dir), merge.merge_activity(adapter.activity_events(spark, sf_dir)), prompts)


@query("ag_09_dry_run", f"with {MERGED} select source, substr(date, 1, 7) as month, acct_q, cast(sum({TOK}) as bigint) as tokens, count(*) as events, min(ts) as first_ts, max(ts) as last_ts from m group by all")
def ag_09(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    return rows.groupBy("source", F.substring("date", 1, 7).alias("month"), "acct_q").agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


#: Machines by id and label: one archived name is a label, one stands for two machines.
_MACHINES = "('m_0', 'desk'), ('m_1', 'm_2'), ('m_4', 'm_3'), ('m_5', 'm_3')"
_COUNTS = f"""{PROMPTS}, ma(id, label) as (values {_MACHINES}), nm as (select id as value, id as machine_id from ma union all select label, min(id) from ma where label not in (select id from ma) group by label having count(*) = 1),
pc as (select strftime(ts + to_minutes(tz_offset_min), '%Y-%m-%d') as date, provider, coalesce(machine_id, 'unknown') as machine, coalesce(nullif(model, ''), 'unknown') as model, count(*) as n from p left join nm on p.machine = nm.value group by all),
co as (select *, bool_and(machine <> 'unknown') over (partition by date, provider) as complete from pc)"""


def _counts(spark, sf_dir):
    machines = spark.sql(f"select col1 as id, col2 as label from values {_MACHINES}")
    return archive.counts(adapter.prompt_records(spark, sf_dir).withColumn("date", ids.local_date(F.col("ts"), F.col("tz_offset_min"))), machines)


@query("ag_10_prompt_counts", f"with {_COUNTS} select * from co")
def ag_10(spark, sf_dir):
    return _counts(spark, sf_dir)


@query("jn_16_archive_overlay", f"""with {_COUNTS}, d as (select distinct date, provider from co union select strftime(date '2025-06-15' + to_days(cast(k as integer)), '%Y-%m-%d'), 'xai' from range(0, 60) t(k)),
o as (select date, provider, case when complete then model end as model, complete as known, case when complete then sum(n) end as n from co where not complete or machine = 'm_1' group by date, provider, case when complete then model end, complete)
select date, provider, model, coalesce(known, true) as known, cast(n as bigint) as n from d left join o using (date, provider)""")
def jn_16(spark, sf_dir):
    counted = _counts(spark, sf_dir)
    days = views.dates(spark, "2025-06-15", "2025-08-13").select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.lit("xai").alias("provider"))
    return archive.overlay(counted.select("date", "provider").union(days), counted, "m_1")


@query("fi_12_capture_exclusion", f"with {PROMPTS} select id, acct from p where (provider, acct) not in (('openai', 'a_1'), ('xai', 'a_2'))")
def fi_12(spark, sf_dir):
    excluded = spark.sql("select col1 as provider, col2 as acct from values ('openai', 'a_1'), ('xai', 'a_2')")
    return archive.without_accounts(adapter.prompt_records(spark, sf_dir), excluded).select("id", "acct")


@query("st_02_months", f"with {PROMPTS}, {ACTIVITY} select strftime(ts, '%Y-%m') as month from p union select strftime(ts, '%Y-%m') from a")
def st_02(spark, sf_dir):
    return archive.months(adapter.prompt_records(spark, sf_dir), adapter.activity_events(spark, sf_dir))


_FACETS = ["provider", "source", "model", "machine", "acct", "workspace"]


@query("ag_11_facets", f"with {PROMPTS} " + " union all ".join(f"select '{c}' as facet, {c} as value, count(*) as n from p where {c} <> '' group by all" for c in _FACETS))
def ag_11(spark, sf_dir):
    return archive.facets(adapter.prompt_records(spark, sf_dir), _FACETS)


@query("ag_15_period_summary", f"""with {MERGED}, s as (select * from m where date between '{FIRST}' and '{LAST}')
select cast(sum({TOK}) as bigint) as total, count(distinct date) as active_days, count(distinct substr(date, 1, 7)) as months, count(distinct provider) as providers, round(sum({TOK}) / count(distinct date), 4) as per_active_day from s where {TOK} > 0""")
def ag_15(spark, sf_dir):
    return views.period_summary(_merged(spark, sf_dir), tokens(), FIRST, LAST)


@query("ag_17_model_totals", f"with {MERGED}, t as (select provider, coalesce(nullif(model, ''), 'unknown') as model, cast(sum({TOK}) as bigint) as tokens from m where date between '{FIRST}' and '{LAST}' group by all) select *, round(100.0 * tokens / sum(tokens) over (partition by provider), 6) as share, row_number() over (partition by provider order by tokens desc, model) as rank from t")
def ag_17(spark, sf_dir):
    rows = _tagged(spark, sf_dir).where(F.col("date").between(FIRST, LAST)).withColumn("model", rollup.named("model"))
    return views.shares(rows, ["model"], "tokens", ["provider"])


@query("ag_18_countries", f"with {MERGED} select upper(coalesce(nullif(cc, ''), 'ZZ')) as place, cast(sum({TOK}) as bigint) as tokens from m group by all having sum({TOK}) > 0")
def ag_18(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy(F.upper(rollup.named("cc")).alias("place")).agg(F.sum("tokens").cast("long").alias("tokens")).where("tokens > 0")


@query("ag_21_project_ranges", f"""with {MERGED}, w(range, since, until) as (values ('year', timestamp '1997-06-15', timestamp '1998-06-15'), ('month', timestamp '1998-05-15', timestamp '1998-06-15'), ('week', timestamp '1998-06-08', timestamp '1998-06-15')),
s as (select range, lower(ws) as name, cast(sum({TOK}) as bigint) as value from m join w on ts >= since and ts < until where ts_q = 'event' group by all)
select range, name, value, round(100.0 * value / sum(value) over (partition by range), 6) as share from s""")
def ag_21(spark, sf_dir):
    rows = _merged(spark, sf_dir).where("ts_q = 'event'")
    return limits.usage_in_windows(rows, [("year", "1997-06-15", "1998-06-15"), ("month", "1998-05-15", "1998-06-15"), ("week", "1998-06-08", "1998-06-15")], "ws", tokens())


@query("ag_22_monthly_activity", f"with {MERGED} select substr(date, 1, 7) as month, provider, model, cast(sum({TOK}) as bigint) as value, count(distinct date) as days from m group by all")
def ag_22(spark, sf_dir):
    return views.monthly(_merged(spark, sf_dir), tokens())


@query("fn_07_metrics", f"with {MERGED} select provider, cast(sum({TOK}) as bigint) as tokens, round(sum(tok_in + cache_w + tok_out + cache_r / 10), 3) as effective, cast(sum(tok_out) as bigint) as output from m group by all")
def fn_07(spark, sf_dir):
    return _merged(spark, sf_dir).groupBy("provider").agg(F.sum(tokens()).cast("long").alias("tokens"), F.round(F.sum(effective()), 3).alias("effective"), F.sum("tok_out").cast("long").alias("output"))


@query("fi_15_country_collapse", f"with {MERGED} select date, provider, 'ZZ' as cc, cast(sum({TOK}) as bigint) as tokens from m group by all")
def fi_15(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("date", "provider", F.lit("ZZ").alias("cc")).agg(F.sum("tokens").cast("long").alias("tokens"))


@query("fi_16_aliases", f"with {MERGED}, d as (select distinct acct as value from m where acct <> '') select value, concat('acct', dense_rank() over (order by value)) as alias from d")
def fi_16(spark, sf_dir):
    return views.dense_aliases(_merged(spark, sf_dir), "acct", "acct")


@query("fi_11_prompt_search", f"with {PROMPTS} select id, ts, workspace from p where provider = 'openai' and contains(lower(text), 'th')")
def fi_11(spark, sf_dir):
    return archive.search(adapter.prompt_records(spark, sf_dir), text="Th", label="PROJECT", provider="openai").select("id", "ts", "workspace")


@query("so_02_keyset_page", f"with {PROMPTS} select id, ts from p where (ts, id) > (timestamp '2025-06-16 00:00:00', 'f') order by ts, id limit 50")
def so_02(spark, sf_dir):
    return archive.page(adapter.prompt_records(spark, sf_dir), 50, ("2025-06-16 00:00:00", "f")).select("id", "ts")


@query("so_01_last_page", f"with {PROMPTS} select id, ts from p order by ts desc, id desc limit 50")
def so_01(spark, sf_dir):
    return archive.page(adapter.prompt_records(spark, sf_dir), 50, descending=True).select("id", "ts")


def _series(unit: str) -> str:
    return f"""with {MERGED}, pr as (select distinct provider from m),
sp as (select strftime(unnest(generate_series(cast(date_trunc('{unit}', date '{FIRST}') as timestamp), timestamp '{LAST}', interval 1 {unit})), '%Y-%m-%d') as bucket),
g as (select strftime(date_trunc('{unit}', cast(date as date)), '%Y-%m-%d') as bucket, provider, cast(sum({TOK}) as bigint) as value from m where date between '{FIRST}' and '{LAST}' group by all)
select bucket, provider, coalesce(value, 0) as value from sp cross join pr left join g using (bucket, provider)"""


for _unit in ("day", "week", "month"):
    query(f"cx_08_series_{_unit}", _series(_unit))(lambda spark, sf_dir, unit=_unit: views.series(_merged(spark, sf_dir), tokens(), FIRST, LAST, f"1 {unit}"))


@query("cx_10_heatmap", f"""with {MERGED}, sp as (select strftime(unnest(generate_series(timestamp '{FIRST}', timestamp '{LAST}', interval 1 day)), '%Y-%m-%d') as date),
g as (select date, cast(sum({TOK}) as bigint) as value from m group by all), d as (select date, coalesce(value, 0) as value from sp left join g using (date)),
q as (select quantile_cont(value, [0.25, 0.5, 0.75]) as q from d where value > 0)
select date, value, cast(case when value <= 0 then 0 when value <= q[1] then 1 when value <= q[2] then 2 when value <= q[3] then 3 else 4 end as integer) as level from d cross join q""")
def cx_10(spark, sf_dir):
    return views.heatmap(_merged(spark, sf_dir), tokens(), FIRST, LAST)


@query("cx_11_calendar", f"""with {USAGE}, mo as (select distinct date_trunc('month', ts) as m from u), g as (select m, unnest(generate_series(cast(date_trunc('week', m) as timestamp), cast(date_trunc('week', m + interval 1 month - interval 1 day) + interval 6 days as timestamp), interval 1 day)) as d from mo)
select strftime(m, '%Y-%m') as month, strftime(d, '%Y-%m-%d') as date, cast(isodow(d) - 1 as integer) as weekday, cast(date_diff('day', date_trunc('week', m), d) // 7 as integer) as week, date_trunc('month', d) = m as inside from g""")
def cx_11(spark, sf_dir):
    return views.calendar(adapter.usage_events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM").alias("month")).distinct())


@query("cx_12_models_started", f"with {MERGED}, s as (select min(substr(date, 1, 7)) as start from m), f as (select provider, model, min(date) as first from m where model <> '' group by all) select provider, model, first, substr(first, 1, 7) > start as started from f cross join s")
def cx_12(spark, sf_dir):
    return views.first_uses(_merged(spark, sf_dir).where("model <> ''"), ["provider", "model"])


@query("wn_11_largest_remainder", f"""with {MERGED}, w as (select provider, machine, count(*) as weight from m group by all), g as (select provider, 1001 as amount, machine, weight, sum(weight) over (partition by provider) as t from w),
f as (select *, (amount * weight) // t as fl, (amount * weight) % t as rest from g), r as (select *, amount - sum(fl) over (partition by provider) as lo, row_number() over (partition by provider order by rest desc, machine) as rn from f)
select provider, machine, cast(amount as bigint) as amount, weight, cast(fl + case when rn <= lo then 1 else 0 end as bigint) as part from r""")
def wn_11(spark, sf_dir):
    rows = _merged(spark, sf_dir).groupBy("provider", "machine").agg(F.count("*").alias("weight")).withColumn("amount", F.lit(1001).cast("long"))
    return views.largest_remainder(rows, ["provider"], "machine", "amount", "weight").select("provider", "machine", "amount", "weight", "part")


_RATES = "(values ('model-0', 3.0, 15.0, 0.3, 3.75, 6.0), ('model-1', 1.0, 5.0, 0.1, 1.25, null), ('model-2', 10.0, 30.0, null, null, null), ('model-base', 2.0, 8.0, 0.2, 2.5, 4.0))"
_WINDOWS = "(values ('model-0', '1995-01-01', '1996-12-31', 4.0, 16.0, 0.4, 4.0, 8.0), ('model-0', '1997-01-01', null, 3.0, 15.0, 0.3, 3.75, 6.0), ('model-base', '1996-01-01', '1998-12-31', 2.0, 8.0, 0.2, 2.5, 4.0))"


def _prices(spark: SparkSession):
    """Synthetic rates in US dollars per million tokens."""
    rates = ", ".join(f"cast(col{k} as double) as {r}" for k, r in enumerate(cost.RATES, 2))
    later = ", ".join(f"cast(col{k} as double) as {r}" for k, r in enumerate(cost.RATES, 4))
    current = spark.sql(f"select col1 as model, {rates} from values {_RATES[8:-1]}")
    windows = spark.sql(f"select col1 as model, col2 as from_date, col3 as to_date, {later} from values {_WINDOWS[8:-1]}")
    return current, windows, spark.createDataFrame([(1, "^model-[34]$", "model-absent"), (2, "^model-[345]$", "model-base")], "ord int, pattern string, use_model string")


_COST = """case when cache_w1h > cache_w then cache_w else greatest(cache_w1h, 0) end"""
_USD = " + ".join(
    f"case when {n} > 0 then {n} * {r} / 1e6 else 0.0 end"
    for n, r in (("tok_in", "input"), ("tok_out", "output"), ("cache_r", "cache_read"), (f"(cache_w - {_COST})", "cache_write"), (f"({_COST})", "coalesce(cache_write_1h, cache_write)"))
)
_PRICED = f"""with {MERGED}, pc(pmodel, input, output, cache_read, cache_write, cache_write_1h) as {_RATES}, pw(pmodel, fd, td, input, output, cache_read, cache_write, cache_write_1h) as {_WINDOWS},
n as (select *, case when model in (select pmodel from pc) then model when model in ('model-3', 'model-4', 'model-5') then 'model-base' end as pmodel from m),
pt as (select provider, model, date, {_USD} as usd from n left join pc on n.pmodel = pc.pmodel),
pa as (select provider, model, date, {_USD} as usd from n left join pw on n.pmodel = pw.pmodel and date between fd and coalesce(td, '9999-12-31'))"""
_BY_MODEL = ", d as (select provider, model, date, sum(cast(round(usd * 1e8) as bigint)) as usd, bool_or(usd is null) as open from {} group by all) select provider, model, sum(usd) / 1e8 as usd, cast(count_if(open) as bigint) as unpriced_days from d group by all"


@query("ag_19_cost_today", _PRICED + _BY_MODEL.format("pt"))
def ag_19_today(spark, sf_dir):
    return cost.cost_by_model(cost.price_rows(_merged(spark, sf_dir), *_prices(spark), at_the_time=False))


@query("ag_19_cost_at_the_time", _PRICED + _BY_MODEL.format("pa"))
def ag_19_then(spark, sf_dir):
    return cost.cost_by_model(cost.price_rows(_merged(spark, sf_dir), *_prices(spark), at_the_time=True))


@query("ag_20_cost_by_day", _PRICED + " select date, sum(cast(round(usd * 1e8) as bigint)) / 1e8 as usd, bool_or(usd is null) as unpriced from pa group by all")
def ag_20(spark, sf_dir):
    return cost.cost_by_day(cost.price_rows(_merged(spark, sf_dir), *_prices(spark), at_the_time=True))


@query("jn_05_price_names", f"with {MERGED} select distinct model, case when model in ('model-0', 'model-1', 'model-2') then model when model in ('model-3', 'model-4', 'model-5') then 'model-base' end as priced_as from m")
def jn_05(spark, sf_dir):
    current, _, fallbacks = _prices(spark)
    return cost.price_names(_merged(spark, sf_dir).select("model"), current, fallbacks)


def _snapshots(ledger):
    """Reported totals: each labelled account's days, with a surplus on every fifth, and an older reading of each."""
    rows = ledger.where("acct <> ''").groupBy("date", "provider", "source", "acct").agg(F.sum("tokens").alias("tokens"))
    extra = F.when(F.expr("cast(substr(date, 9, 2) as int) % 5 = 0"), F.lit(1000)).otherwise(0)
    new = rows.select("date", "provider", "source", "acct", (F.col("tokens") + extra).cast("long").alias("total_tokens"), F.lit("1996-05-02").cast("timestamp").alias("observed_at"))
    return new.unionByName(new.withColumn("observed_at", F.lit("1996-05-01").cast("timestamp")).withColumn("total_tokens", F.col("total_tokens") * 2))


@query("cx_01_reconcile", f"""with {MERGED}, l as (select strftime(ts, '%Y-%m-%d') as date, provider, source, case when acct_q in ('recorded', 'session', 'timeline', 'bounded') then acct else '' end as acct, sum({TOK}) as tokens from m group by all),
s as (select date, source, acct, tokens + case when cast(substr(date, 9, 2) as int) % 5 = 0 then 1000 else 0 end as total, case when date >= '1998-06-15' then date else 'closed' end as win from l where acct <> ''),
un as (select date, source, sum(tokens) as unsure from l where acct = '' group by all), lo as (select date, source, acct, sum(tokens) as tokens from l where acct <> '' group by all),
w as (select source, acct, win, min(date) as fd, max(date) as td, sum(total) as reported, sum(greatest(0, total - coalesce(tokens, 0) - coalesce(unsure, 0))) as deficits from s left join lo using (date, source, acct) left join un using (date, source) group by all),
sp as (select source, acct, win, fd, td, strftime(unnest(generate_series(cast(fd as timestamp) - interval 1 day, cast(td as timestamp) + interval 1 day, interval 1 day)), '%Y-%m-%d') as date from w),
pe as (select distinct source, acct, win from sp where date not in (select date from l)),
mt as (select source, acct, win, coalesce(sum(tokens), 0) as matched, coalesce(sum(unsure), 0) as uncertain from sp left join lo using (date, source, acct) left join un using (date, source) where date between fd and td group by all),
j as (select w.*, matched, uncertain, greatest(0, reported - matched - uncertain) as gap, pe.win is not null as pending from w join mt using (source, acct, win) left join pe on pe.source = w.source and pe.acct = w.acct and pe.win = w.win),
k as (select *, case when pending then 'pending' when deficits > gap then 'conflict' when gap > 0 then 'recovered' else 'matched' end as status from j)
select td as date, source, acct, win, cast(reported as bigint) as reported, cast(matched as bigint) as matched, cast(uncertain as bigint) as uncertain, cast(deficits as bigint) as deficits, status, cast(case when status = 'recovered' then gap else 0 end as bigint) as recovered from k""")
def cx_01(spark, sf_dir):
    ledger = staged(rollup.ledger(_merged(spark, sf_dir)))  # days and accounts, which five branches read
    return reconcile.reconcile(_snapshots(ledger), ledger, ledger.select("date").distinct(), "1998-06-15")


@query("mg_16_newest_total", f"""with {MERGED}, l as (select strftime(ts, '%Y-%m-%d') as date, provider, source, acct, sum({TOK}) as tokens from m where acct_q in ('recorded', 'session', 'timeline', 'bounded') and acct <> '' group by all)
select date, provider, source, acct, cast(tokens + case when cast(substr(date, 9, 2) as int) % 5 = 0 then 1000 else 0 end as bigint) as total_tokens, timestamp '1996-05-02' as observed_at from l""")
def mg_16(spark, sf_dir):
    return merge.newest(_snapshots(rollup.ledger(_merged(spark, sf_dir))), ["date", "provider", "source", "acct"], F.col("observed_at"), F.col("total_tokens"))


#: Days without activity, by weight and not by leaving rows out, so that every radius occurs.
_IDLE = "machine = 'm_0' or substr(date, 9, 2) between '10' and '25'"


@query("cx_04_shares_by_radius", f"""with {MERGED}, ac as (select provider, date, machine, sum(case when {_IDLE} then 0 else {TOK} end) as weight from m group by all), h as (select distinct provider, date from m),
x as (select h.provider, h.date, o.off, ac.machine, ac.weight from h cross join (select unnest(generate_series(-7, 7)) as off) o join ac on ac.provider = h.provider and ac.date = strftime(cast(h.date as timestamp) + to_days(cast(o.off as integer)), '%Y-%m-%d') where weight > 0),
b as (select provider, date, min(abs(off)) as radius from x group by all)
select provider, date, machine, cast(radius as integer) as radius, cast(sum(weight) as bigint) as weight from x join b using (provider, date) where (radius < 2 and abs(off) = radius) or (radius >= 2 and abs(off) <= radius) group by all""")
def cx_04(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    activity = rows.groupBy("provider", "date", "machine").agg(F.sum(F.when(F.expr(_IDLE), 0).otherwise(F.col("tokens"))).alias("weight"))
    return history.shares_by_radius(rows.select("provider", "date").distinct(), activity)


@query("cx_03_rates", f"""with {MERGED}, ac as (select provider, date, machine, cast(sum({TOK}) as bigint) as tokens, cast(count_if(q = 'exact') as bigint) as logged, date_diff('day', date '1970-01-01', cast(min(date) as date)) as n from m group by provider, date, machine)
select provider, date, machine, tokens, logged, coalesce(
  sum(case when tokens > 0 and logged > 0 then tokens end) over a / sum(case when tokens > 0 and logged > 0 then logged end) over a,
  sum(case when tokens > 0 and logged > 0 then tokens end) over b / sum(case when tokens > 0 and logged > 0 then logged end) over b,
  sum(case when tokens > 0 and logged > 0 then tokens end) over c / sum(case when tokens > 0 and logged > 0 then logged end) over c, 1.0) as rate
from ac window a as (partition by provider, machine order by n range between 7 preceding and 7 following), b as (partition by provider order by n range between 7 preceding and 7 following), c as (partition by provider)""")
def cx_03(spark, sf_dir):
    rows = _tagged(spark, sf_dir).groupBy("provider", "date", "machine").agg(F.sum("tokens").cast("long").alias("tokens"), F.count_if(F.col("q") == "exact").alias("logged"))
    return history.rates(rows)


def _lookups(spark, sf_dir):
    """All activity, and the samples that a poll took of all of it, each up to ten minutes later."""
    a = adapter.activity_events(spark, sf_dir)
    at = F.expr("timestampadd(second, cast(seq as bigint) % 600, ts)")
    return a.select("id", "provider", "ts"), a.groupBy("provider", at.alias("ts")).agg(F.min("machine").alias("seen"))


_LOOKUPS = f"""{ACTIVITY}, s as (select provider, ts + to_seconds(cast(seq as bigint) % 600) as at, min(machine) as seen from a group by all),
be as (select a.id, a.provider, a.ts, s.seen, s.at from a asof left join s on a.provider = s.provider and a.ts >= s.at)"""


@query("jn_11_nearest_sample", f"""with {_LOOKUPS}, x as (select be.*, s.seen as seen_a, s.at as at_a from be asof left join s on be.provider = s.provider and be.ts < s.at),
y as (select *, coalesce(at_a is null or epoch_us(ts) - epoch_us(x."at") <= epoch_us(at_a) - epoch_us(ts), false) as back from x)
select id, provider, ts, case when back then seen else seen_a end as seen, case when back then y."at" else at_a end as at from y""")
def jn_11(spark, sf_dir):
    return asof.nearest(*_lookups(spark, sf_dir), ["provider"], "seen")


@query("jn_12_last_before", f'with {_LOOKUPS} select id, provider, ts, seen, be."at" from be')
def jn_12(spark, sf_dir):
    return asof.last_before(*_lookups(spark, sf_dir), ["provider"], "seen")


@query("wn_05_identity_runs", """with e as (select user_id, event_id, event_type, case when event_type = lag(event_type) over w then 0 else 1 end as nw from events window w as (partition by user_id order by event_id)),
r as (select *, sum(nw) over (partition by user_id order by event_id) as run from e) select user_id, event_type, min(event_id) as first, max(event_id) as last, count(*) as n from r group by user_id, run, event_type""")
def wn_05(spark, sf_dir):
    return asof.islands(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "event_id", "event_type")


@query("pr_11_counter_deltas", """with e as (select user_id, event_id, cast(floor(value) as bigint) % 7 as total from events), l as (select *, lag(total) over w as b from e window w as (partition by user_id order by event_id)),
p as (select *, cast(sum(case when total < b then 1 else 0 end) over (partition by user_id order by event_id) as bigint) as epoch from l) select user_id, event_id, total, epoch, case when total >= b then total - b else total end as delta from p where total is distinct from b""")
def pr_11(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.floor("value").cast("long") % 7).alias("total"))
    return asof.counter_deltas(rows, ["user_id"], "event_id", "total")


def _readings(spark, sf_dir):
    """Quota readings: customers' balances as percentages seen at order dates."""
    orders, customer = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.when(F.col("o_custkey") % 2 == 0, "openai").otherwise("anthropic").alias("provider"), F.concat(F.lit("a_"), (F.col("o_custkey") % 40).cast("string")).alias("acct"),
        F.when(F.col("o_orderkey") % 3 == 0, "session").when(F.col("o_orderkey") % 3 == 1, "week").otherwise("plan").alias("win"),
        F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.floor(F.col("o_totalprice") % 110)).cast("double").alias("used_percent"),
        F.expr("cast(o_orderdate as timestamp) + interval 5 days").alias("resets_at"), F.col("o_orderdate").cast("timestamp").alias("observed_at"), F.when(F.col("o_orderkey") % 4 == 0, "app").otherwise("").alias("quota_source"),
    )


_READ = """r as (select case when o_custkey % 2 = 0 then 'openai' else 'anthropic' end as provider, concat('a_', o_custkey % 40) as acct, case o_orderkey % 3 when 0 then 'session' when 1 then 'week' else 'plan' end as win,
  case when o_orderkey % 10 <> 0 then floor(o_totalprice % 110) end as used_percent, o_orderdate + interval 5 days as resets_at, o_orderdate as observed_at, case when o_orderkey % 4 = 0 then 'app' else '' end as quota_source from orders join customer on o_custkey = c_custkey),
c as (select * from (select *, row_number() over (partition by provider, acct, win order by case when provider = 'openai' and quota_source <> '' then 1 else 0 end desc, observed_at desc, coalesce(used_percent, -1) desc) as rn from r) where rn = 1)"""


@query("mg_15_newest_meter", f"with {_READ} select provider, acct, win, used_percent, observed_at from c")
def mg_15(spark, sf_dir):
    return limits.current(_readings(spark, sf_dir)).select("provider", "acct", "win", "used_percent", "observed_at")


@query("fi_13_fresh_meters", f"with {_READ} select provider, acct, win, resets_at from c where win = 'plan' or resets_at >= timestamp '1998-08-10' - interval 14 days")
def fi_13(spark, sf_dir):
    return limits.fresh(limits.current(_readings(spark, sf_dir)), "1998-08-10 00:00:00").select("provider", "acct", "win", "resets_at")


@query("fn_16_weekly_projection", f"""with {_READ}, n as (select timestamp '1998-08-10' as now)
select provider, acct, win, case when resets_at <= now then 0.0 else used_percent end as used_percent, case when resets_at <= now then resets_at + to_days(cast(7 * (floor((epoch(now) - epoch(resets_at)) / 604800) + 1) as integer)) else resets_at end as resets_at from c cross join n where win = 'week'""")
def fn_16(spark, sf_dir):
    return limits.weekly(limits.current(_readings(spark, sf_dir)).where("win = 'week'"), "1998-08-10 00:00:00").select("provider", "acct", "win", "used_percent", "resets_at")


@query("cx_16_quota_accounts", f"""with {_READ}, n as (select timestamp '1998-08-10' as now),
k as (select provider, acct, win, case when win = 'week' and resets_at <= now then 0.0 else used_percent end as used, case when win = 'week' and resets_at <= now then resets_at + to_days(cast(7 * (floor((epoch(now) - epoch(resets_at)) / 604800) + 1) as integer)) else resets_at end as resets_at from c cross join n),
g as (select provider, acct, max(case when win = 'session' and used between 0 and 100 then used end) as session_percent, max(case when win = 'week' and used between 0 and 100 then used end) as week_percent, max(case when win = 'week' then resets_at end) as resets_at from k group by all),
s as (select *, greatest(session_percent, week_percent) as worst, case when week_percent is null then 2 when week_percent >= 100 then 1 else 0 end as grp from g)
select provider, acct, session_percent, week_percent, resets_at, case when worst is null then 'unread' when worst >= 100 then 'exhausted' when worst >= 90 then 'critical' when worst >= 75 then 'warning' else 'ok' end as state,
  cast(row_number() over (partition by provider order by grp, case when grp = 0 then week_percent end, case when grp = 1 then resets_at end nulls last, acct) as integer) as place from s""")
def cx_16(spark, sf_dir):
    return limits.accounts(limits.weekly(limits.current(_readings(spark, sf_dir)), "1998-08-10 00:00:00"))


@query("jn_20_known_labels", f"""with r as (select o_orderkey, o_custkey % 40 as acct, case when o_orderkey % 9 = 0 then concat(case when o_orderkey % 2 = 0 then 'U' else 'u' end, o_custkey % 40 % 30, case when o_custkey % 40 < 5 then o_orderkey % 4 end, '@x.org') else '' end as label from orders),
k as (select acct, max(label) as label from r where label <> '' group by acct having count(distinct lower(label)) = 1)
select o_orderkey, coalesce(nullif(r.label, ''), k.label, '') as label from r left join k using (acct)""")
def jn_20(spark, sf_dir):
    acct, key = F.col("o_custkey") % 40, F.col("o_orderkey")
    name = F.concat(F.when(key % 2 == 0, "U").otherwise("u"), (acct % 30).cast("string"), F.when(acct < 5, (key % 4).cast("string")).otherwise(""), F.lit("@x.org"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.lit("openai").alias("provider"), acct.cast("string").alias("acct"), F.when(key % 9 == 0, name).otherwise("").alias("label"))
    return limits.with_known_labels(rows).select("o_orderkey", "label")


@query("ag_24_machine_scope", f"""with {MERGED}, ce as (select date, provider, ws, machine, model, cast(sum({TOK}) as bigint) as tokens from m group by all), al as (select date, provider, ws, count(distinct machine) as n from ce group by all),
da as (select date, provider, count(distinct machine) as dn from ce group by all), x as (select *, n > 1 and dn > 1 as partial from ce join al using (date, provider, ws) join da using (date, provider) where machine = 'm_1')
select date, provider, ws, case when partial then 'unknown' else model end as model, partial, cast(sum(tokens) as bigint) as tokens from x group by date, provider, ws, case when partial then 'unknown' else model end, partial""")
def ag_24(spark, sf_dir):
    cells = _tagged(spark, sf_dir).groupBy("date", "provider", "ws", "machine", "model").agg(F.sum("tokens").cast("long").alias("tokens"))
    return views.machine_scope(cells, "m_1", ["tokens"])


def _history(spark, sf_dir):
    """Account history of every day and provider, and what machines did, with days on which nobody did anything."""
    rows = _tagged(spark, sf_dir)
    idle = F.expr(_IDLE)
    tokens_ = F.when(idle | (F.col("l") % 3 == 0), 0).otherwise(F.col("tokens"))
    places = staged(rows.withColumn("l", F.conv(F.substring("id", 1, 6), 16, 10).cast("long")).groupBy("provider", "date", "machine").agg(F.sum(tokens_).cast("long").alias("tokens"), F.count_if(~idle).alias("prompts")))  # a row a day and machine, read seven times
    days = places.groupBy("provider", "date").agg(F.floor(F.sum("prompts") / 2).cast("long").alias("missing"), (F.sum("tokens") % 10007 + 1).cast("long").alias("amount"))
    activity = history.unlogged(places, days.select("provider", "date", "missing"))
    countries = spark.sql("select col1 as machine, col2 as cc from values ('m_0', 'de'), ('m_1', 'FR'), ('m_2', 'DE'), ('m_3', '')")
    return places, history.moves(days.select("provider", "date", "amount", F.col("amount").alias("zz")), activity, countries)


@query("cx_05_history_moves")
def cx_05(spark, sf_dir):
    return _history(spark, sf_dir)[1]


@query("cx_07_machine_with_history")
def cx_07(spark, sf_dir):
    places, moved = _history(spark, sf_dir)
    return history.with_assigned(places.where("machine = 'm_1'").select("provider", "date", "tokens"), moved, "m_1")


_COMPACT = "case when n <= 0 then '0' " + " ".join(
    f"when n >= {size} * 0.9995 then concat(case when n / {size} < 100 then regexp_replace(cast(cast(floor(n * 10 / {size} + 0.5) as bigint) / 10 as varchar), '[.]0$', '') else cast(cast(floor(n / {size} + 0.5) as bigint) as varchar) end, '{mark}')"
    for size, mark in (("1e12", "T"), ("1e9", "B"), ("1e6", "M"), ("1e3", "K"))
) + " else cast(cast(floor(n + 0.5) as bigint) as varchar) end"


@query("fn_13_compact", f"with {MERGED}, s as (select model, date, cast(sum({TOK}) as bigint) as n from m group by all) select model, date, n, {_COMPACT} as label from s")
def fn_13(spark, sf_dir):
    sums = _tagged(spark, sf_dir).groupBy("model", "date").agg(F.sum("tokens").cast("long").alias("n"))
    return sums.select("model", "date", "n", compact(F.col("n")).alias("label"))


@query("fn_03_account_hash", f"""with {MERGED} select distinct provider, acct, concat('a_', substr({keyed(KEY, "provider || '|' || acct")}, 1, 16)) as hash, concat('w_', substr({keyed(KEY, "'workspace|' || acct")}, 1, 16)) as tag from m where acct <> ''""")
def fn_03(spark, sf_dir):
    rows = _merged(spark, sf_dir).select("provider", "acct").where("acct <> ''").distinct()
    return rows.select("provider", "acct", ids.account_hash(KEY, F.col("provider"), F.col("acct")).alias("hash"), ids.workspace_tag(KEY, F.col("acct")).alias("tag"))
