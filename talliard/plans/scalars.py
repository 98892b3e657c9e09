"""Queries of scalar functions, each over whole tables."""

from pyspark.sql import functions as F

from talliard.functions import dates, labels
from talliard.plans.catalog import query
from talliard.plans.oracle import PROMPTS
from talliard.sources import adapter
from talliard.tables import table

KEY = b"sixteen byte key"
_D = "strftime(o_orderdate, '%Y-%m-%d')"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("date", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("fn_08_calendar_days", f"""select o_orderkey, strftime(o_orderdate + to_days(cast(o_orderkey % 40 - 20 as integer)), '%Y-%m-%d') as moved, cast(isodow(o_orderdate) - 1 as integer) as weekday,
strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as monday, strftime(date_trunc('month', o_orderdate) + interval 1 month, '%Y-%m-%d') as next_month from orders""")
def fn_08(spark, sf_dir):
    d = F.col("date")
    moved = dates.add_days(d, (F.col("o_orderkey") % 40 - 20).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", moved.alias("moved"), dates.weekday_index(d).alias("weekday"), dates.monday_of(d).alias("monday"), dates.next_month(d).alias("next_month"))


@query("fn_09_period_ranges", f"""with p as (select o_orderkey, {_D} as today, o_orderdate as d, case o_orderkey % 5 when 0 then '30d' when 1 then '60d' when 2 then '90d' when 3 then 'recent' else '1995' end as period from orders),
r as (select *, case when period like '%d' then cast(replace(period, 'd', '') as integer) end as n from p),
t as (select *, case when n is not null then strftime(d - to_days(n - 1), '%Y-%m-%d') when period = 'recent' then strftime(date_trunc('week', d) - interval 364 days, '%Y-%m-%d') else concat(period, '-01-01') end as "from",
  case when n is not null or period = 'recent' then today else least(concat(period, '-12-31'), today) end as "to" from r)
select o_orderkey, period, "from", "to", case when n is not null then concat('the last ', n, ' days') when period = 'recent' then 'the last year' else period end as phrase,
  round(case when n is not null then n / 30.44 when period = 'recent' then 12.0 else (date_diff('day', cast("from" as date), cast("to" as date)) + 1) / 30.44 end, 6) as months from t""")
def fn_09(spark, sf_dir):
    period = F.element_at(F.array(*map(F.lit, ("30d", "60d", "90d", "recent", "1995"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = _orders(spark, sf_dir).withColumn("period", period).withColumn("r", dates.period_range(F.col("period"), F.col("date")))
    return rows.select("o_orderkey", "period", "r.from", "r.to", "r.phrase", F.round("r.months", 6).alias("months"))


@query("fn_10_years_back", "select o_custkey, array_to_string(list_reverse(range(min(year(o_orderdate)), 1999)), ',') as years from orders group by o_custkey")
def fn_10(spark, sf_dir):
    first = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.min("date").alias("first"))
    return first.select("o_custkey", F.array_join(dates.years_back(F.col("first"), F.lit("1998-08-02")), ",").alias("years"))


@query("fn_14_day_labels", """with t as (select o_orderkey, o_orderdate as d, day(o_orderdate) as n, case when year(o_orderdate) = 1996 then '' else concat(', ', year(o_orderdate)) end as y from orders)
select o_orderkey, concat(strftime(d, '%b'), ' ', n, y) as short, concat(strftime(d, '%B'), ' ', n, case when n between 11 and 13 then 'th' when n % 10 = 1 then 'st' when n % 10 = 2 then 'nd' when n % 10 = 3 then 'rd' else 'th' end, y) as long from t""")
def fn_14(spark, sf_dir):
    today = F.lit("1996-06-15")
    return _orders(spark, sf_dir).select("o_orderkey", dates.day_short(F.col("date"), today).alias("short"), dates.day_long(F.col("date"), today).alias("long"))


@query("fn_15_weekly_range", """with n as (select o_orderkey, cast(epoch(o_orderdate) as bigint) as e, cast(epoch(timestamp '1996-06-15 10:00:00') as bigint) as now from orders),
a as (select *, case when e <= now then e + ((now - e) // 604800 + 1) * 604800 else e end as ahead from n)
select o_orderkey, make_timestamp((ahead - 604800) * 1000000) as since, make_timestamp(ahead * 1000000) as resets_at, e <= now as projected from a where ahead - 604800 <= now""")
def fn_15(spark, sf_dir):
    week = dates.weekly_range(F.col("o_orderdate").cast("timestamp"), F.lit("1996-06-15 10:00:00").cast("timestamp"))
    return _orders(spark, sf_dir).withColumn("w", week).where("w is not null").select("o_orderkey", "w.since", "w.resets_at", "w.projected")


@query("fn_17_countdowns", """with t as (select o_orderkey, case when o_orderkey % 50 <> 0 then o_orderkey * 977777 % 400000000 end as ms from orders), s as (select *, ms // 1000 as s, (ms + 59999) // 60000 as c from t)
select o_orderkey, case when ms is null then '—' when s >= 86400 then concat(s // 86400, 'd ', s % 86400 // 3600, 'h') when s >= 3600 then concat(s // 3600, 'h ', lpad(cast(s % 3600 // 60 as varchar), 2, '0'), 'm')
  when s >= 60 then concat(s // 60, 'm ', lpad(cast(s % 60 as varchar), 2, '0'), 's') else concat(s, 's') end as countdown,
  case when ms is null then '' else concat(case when c >= 1440 then concat(c // 1440, 'd ') else '' end, case when c >= 60 then concat(c % 1440 // 60, 'h ') else '' end, c % 60, 'm') end as clock,
  case when ms < 60000 then 'just now' when ms < 3600000 then concat(cast(floor(ms / 60000 + 0.5) as bigint), ' min ago') when ms < 86400000 then concat(cast(floor(ms / 3600000 + 0.5) as bigint), ' h ago') end as ago from s""")
def fn_17(spark, sf_dir):
    ms = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey").cast("long") * 977777 % 400000000)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ms.alias("ms"))
    return rows.select("o_orderkey", dates.countdown(F.col("ms")).alias("countdown"), dates.reset_clock(F.col("ms")).alias("clock"), dates.ago(F.col("ms")).alias("ago"))


@query("fn_18_clean_labels", r"""with t as (select doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0E-\x1F\x7F-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FFFD}]', '', 'g'), '[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) as s from documents)
select doc_id, coalesce(rtrim(left(s, 48)), '') as label, case when regexp_full_match(upper(trim(left(s, 3))), '[A-Z]{2}') then upper(trim(left(s, 3))) else '' end as country from t""")
def fn_18(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", labels.clean_label(F.col("text")).alias("label"))
    return rows.select("doc_id", "label", labels.clean_country(F.substring("label", 1, 3)).alias("country"))


@query("fn_19_truncated", "select doc_id, left(text, cast(list_max(list_filter(range(0, 42), lambda k: strlen(left(text, cast(k as integer))) <= 41)) as integer)) as text from documents")
def fn_19(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", labels.truncate_utf8(F.col("text"), 41).alias("text"))


_TIERS = ["default_claude_max_20x", "default_claude_max_5x", "x_max", "default_raven", "claude_pro", "Own Plan", "a@b.c", ""]
_SEATS = ["team_premium", "standard", ""]
_KINDS = ["claude_enterprise", "claude_team", "claude_max", "claude_pro", "other"]
_SHOWN = ["", "Max", "Team", "Ultra"]


def _of(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_of(values, n):
    return f"[{', '.join(repr(v) for v in values)}][{n} % {len(values)} + 1]"


@query("fn_24_plan_labels", f"""with t as (select c_custkey, {_sql_of(_TIERS, 'c_custkey')} as tier, {_sql_of(_KINDS, '(c_custkey // 8)')} as kind, {_sql_of(_SEATS, 'c_custkey')} as seat, {_sql_of(_SHOWN, '(c_custkey // 3)')} as shown from customer),
p as (select *, case when contains(tier, 'max_20x') then 'Max (20x)' when contains(tier, 'max_5x') then 'Max (5x)' when contains(tier, '_max') then 'Max' when contains(tier, 'pro') then 'Pro' when starts_with(tier, 'default_') or contains(tier, '@') then '' else tier end as a,
  case kind when 'claude_enterprise' then 'Enterprise' when 'claude_team' then 'Team' when 'claude_max' then 'Max' when 'claude_pro' then 'Pro' end as k, case seat when 'team_premium' then ' (Premium)' when 'standard' then ' (Standard)' else '' end as x from t),
b as (select *, case when k is null then '' else concat(k, x) end as b from p)
select c_custkey, a as tier_plan, b as organisation_plan, case when shown = '' then case when a <> '' then a else b end when starts_with(lower(a), concat(lower(shown), ' (')) then a when starts_with(lower(b), concat(lower(shown), ' (')) then b else shown end as label,
  case when starts_with(tier, 'default_') then '' else tier end as name, case when contains(tier, '@') then '' else tier end as codex from b""")
def fn_24(spark, sf_dir):
    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", _of(_TIERS, n).alias("tier"), _of(_KINDS, F.floor(n / 8)).alias("kind"), _of(_SEATS, n).alias("seat"), _of(_SHOWN, F.floor(n / 3)).alias("shown"))
    tier, kind, seat = F.col("tier"), F.col("kind"), F.col("seat")
    return rows.select(
        "c_custkey", labels.tier_plan(tier).alias("tier_plan"), labels.organisation_plan(kind, seat).alias("organisation_plan"),
        labels.plan_label(F.col("shown"), tier, kind, seat).alias("label"), labels.plan_name(tier).alias("name"), labels.codex_plan(tier).alias("codex"),
    )


@query("fn_26_resend", """with t as (select o_orderkey, o_custkey, o_orderkey % 3 = 0 as plan, cast(epoch(o_orderdate) as bigint) as seen, o_orderkey * 7 % 600 as more, o_orderkey % 11 = 0 as other from orders)
select o_orderkey, case when other then true when plan then seen // 86400 <> (seen + more) // 86400 else more >= 300 end as resend from t""")
def fn_26(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("win", F.when(F.col("o_orderkey") % 3 == 0, "plan").otherwise("week")).withColumn("at", F.col("o_orderdate").cast("timestamp"))
    later = F.timestamp_seconds(F.unix_seconds("at") + F.col("o_orderkey").cast("long") * 7 % 600)
    rows = rows.withColumn("first", labels.fingerprint("o_custkey", "win")).withColumn("second", F.when(F.col("o_orderkey") % 11 == 0, F.reverse("first")).otherwise(F.col("first")))
    marks = labels.sent_mark(F.col("first"), F.col("win"), F.col("at")), labels.sent_mark(F.col("second"), F.col("win"), later)
    return rows.select("o_orderkey", labels.should_resend(*marks).alias("resend"))


@query("fn_27_token_claims", "select c_custkey, c_name as sub, case when c_custkey % 10 <> 0 then concat('a_', c_custkey) end as email from customer")
def fn_27(spark, sf_dir):
    claims = F.to_json(F.struct(F.col("c_name").alias("sub"), F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit("a_"), F.col("c_custkey").cast("string"))).alias("email")))
    body = F.rtrim(F.translate(F.base64(F.encode(claims, "UTF-8")), "+/", "-_"), F.lit("="))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("e30."), body, F.lit(".c2ln")).alias("token"))
    return rows.select("c_custkey", *(labels.token_claim(F.col("token"), c).alias(c) for c in ("sub", "email")))


@query("fn_28_sealed_prompts", f"with {PROMPTS} select id, text from p")
def fn_28(spark, sf_dir):
    rows = adapter.prompt_records(spark, sf_dir).select("id", labels.sealed(F.col("text"), KEY, F.col("id")).alias("enc"))
    return rows.select("id", labels.opened(F.col("enc"), KEY, F.col("id")).alias("text"))


@query("fn_29_axis_steps", """with t as (select o_orderkey, o_totalprice as peak, pow(10, floor(log10(o_totalprice / 4))) as p from orders),
s as (select o_orderkey, peak, unnest([p, 2 * p, 2.5 * p, 4 * p, 5 * p, 10 * p, 20 * p, 25 * p, 40 * p, 50 * p]) as step from t) select o_orderkey, min(step) as step, cast(ceil(any_value(peak) / min(step) - 1e-9) as bigint) as ticks from s where ceil(peak / step - 1e-9) <= 4 group by o_orderkey""")
def fn_29(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("peak"))
    rows = rows.withColumn("step", labels.axis_step(F.col("peak")))
    return rows.select("o_orderkey", "step", F.ceil(F.col("peak") / F.col("step") - 1e-9).cast("long").alias("ticks"))


@query("fn_13_usd_and_counts", """with t as (select o_orderkey, case when o_orderkey % 7 = 0 then o_totalprice / 1e6 else o_totalprice / 1000 end as v, o_orderkey % 30000 as n from orders)
select o_orderkey, case when v >= 100 then concat('$', format('{:,}', cast(floor(v + 0.5) as bigint))) when v >= 0.01 then concat('$', cast(floor(v * 100 + 0.5) as bigint) // 100, '.', lpad(cast(cast(floor(v * 100 + 0.5) as bigint) % 100 as varchar), 2, '0')) when v > 0 then '<$0.01' else '$0' end as usd,
  concat(case when n < 10000 then format('{:,}', n) else concat(regexp_replace(cast(cast(floor(n * 10 / 1e3 + 0.5) as bigint) / 10 as varchar), '[.]0$', ''), 'K') end, case when n = 1 then ' day' else ' days' end) as days from t""")
def fn_13_usd(spark, sf_dir):
    price, n = F.col("o_totalprice").cast("double"), F.col("o_orderkey") % 30000
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, price / 1e6).otherwise(price / 1000).alias("v"), n.alias("n"))
    return rows.select("o_orderkey", labels.usd(F.col("v")).alias("usd"), labels.plural(F.col("n"), "day").alias("days"))
