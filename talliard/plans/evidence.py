"""Queries of account attribution and of workspaces, over whole tables; what they should give is computed by loops in the tests."""

from pyspark.sql import functions as F

from talliard.operators import accounts, workspaces
from talliard.plans import lineage
from talliard.plans.catalog import query
from talliard.plans.oracle import ACTIVITY
from talliard.sources import adapter
from talliard.tables import staged, table

_HOME = "cast(cast(seq as bigint) % 2 as string)"


def _events(spark, sf_dir):
    """Activity of two homes, one event an id; every seventh says its account itself, every eleventh an organisation."""
    a = adapter.activity_events(spark, sf_dir).withColumn("n", F.col("seq").cast("long"))
    hint = F.when(F.col("n") % 7 == 0, F.concat(F.lit("a_"), (F.col("n") % 5).cast("string"))).when(F.col("n") % 11 == 0, F.concat(F.lit("o_"), (F.col("n") % 3).cast("string"))).otherwise("")
    return a.select(
        F.col("seq").alias("id"), "provider", F.expr(_HOME).alias("home"), "ts", F.when(F.col("n") % 3 == 0, F.col("session")).otherwise("").alias("session"),
        hint.alias("hint"), F.when(hint.startswith("o_"), "org").otherwise("").alias("hint_kind"), (F.col("ts") - F.expr("interval 30 minutes")).alias("hint_at"), "n",
    )


def _probes(rows):
    """The logins that a poll saw: of each home and day, from its first event on for six hours."""
    day = rows.groupBy("provider", "home", F.to_date("ts").alias("d")).agg(F.min("ts").alias("from_ts"))
    return day.select("provider", "home", "from_ts", F.expr("least(from_ts + interval 6 hours, cast(d as timestamp) + interval 23 hours + interval 59 minutes)").alias("to_ts"), F.concat(F.lit("a_"), (F.dayofyear("d") % 4).cast("string")).alias("acct"))


def _evidence(spark, rows):
    """All kinds of evidence, each derived from events that a hash picks: records are as rare as this among events."""
    hashed = F.pmod(F.xxhash64("id"), F.lit(64))
    picked = staged(rows.where(hashed < 5).withColumn("_k", hashed))
    some = lambda k: picked.where(F.col("_k") == k).drop("_k")
    acct = F.concat(F.lit("a_"), (F.col("n") % 4).cast("string")).alias("acct")
    keys = ["provider", "home"]
    orgs = spark.sql("""select provider, home, org, acct, rank from values ('o_0', 'a_0', 1), ('o_1', 'a_1', 1), ('o_1', 'a_2', 1), ('o_2', 'a_3', 2), ('o_2', 'a_4', 1) as t(org, acct, rank)
        lateral view explode(array('anthropic', 'openai', 'xai', 'cursor', 'google')) p as provider lateral view explode(array('0', '1')) h as home""")
    in_session = rows.where("session <> '' and provider = 'xai'")
    proc = F.concat(F.lit("p"), F.dayofyear("ts") % 7).alias("proc")
    spans = in_session.groupBy(*keys, "session", F.to_date("ts").alias("d"), proc).agg(F.min("ts").alias("from_ts"), F.expr("min(ts) + interval 3 hours").alias("to_ts")).drop("d")
    owned = some(3).where("provider = 'cursor'")
    half = F.when(F.col("n") % 2 == 0, acct).otherwise("").alias("acct")
    return {
        "probes": staged(_probes(rows)), "bounds": some(0).select(*keys, "ts"), "sessions": some(1).where("session <> ''").select(*keys, "session", "ts", acct), "orgs": orgs, "samples": some(2).select(*keys, "ts", acct),
        "spans": spans, "users": some(4).where("provider = 'xai'").select(*keys, proc, "ts", acct),
        "folders": owned.select(*keys, F.col("id").alias("proc"), F.col("ts").alias("from_ts"), F.expr("ts + interval 5 hours").alias("to_ts"), half),
        "owners": owned.select(*keys, F.col("id").alias("proc"), F.expr("ts + interval 1 hour").alias("ts"), acct), "plans": lineage.plan_records(spark, rows),
    }


@query("cx_14_accounts_of_events")
def cx_14(spark, sf_dir):
    rows = staged(_events(spark, sf_dir))
    return accounts.attributed(rows, _evidence(spark, rows))


_PROBED = f"""{ACTIVITY}, e as (select seq as id, provider, cast(cast(seq as bigint) % 2 as varchar) as home, ts from a),
d as (select provider, home, cast(ts as date) as d, min(ts) as from_ts from e group by all), pr as (select provider, home, from_ts, least(from_ts + interval 6 hours, cast(d as timestamp) + interval 23 hours + interval 59 minutes) as to_ts, concat('a_', dayofyear(d) % 4) as acct from d),
b as (select e.*, pr.acct as b_acct, pr.from_ts as b_from, pr.to_ts as b_to from e asof left join pr on e.provider = pr.provider and e.home = pr.home and e.ts >= pr.from_ts),
x as (select b.*, pr.acct as a_acct, pr.from_ts as a_from from b asof left join pr on b.provider = pr.provider and b.home = pr.home and b.ts < pr.from_ts),
y as (select *, epoch_us(ts) - epoch_us(b_to) as behind, epoch_us(a_from) - epoch_us(ts) as ahead, b_to >= ts as inside from x),
z as (select *, b_acct is not null and (a_acct is null or behind <= ahead) as earlier from y)"""


@query("jn_10_by_login", f"with {_PROBED} select id, case when coalesce(inside, false) or earlier then b_acct else a_acct end as acct, case when coalesce(inside, false) or (case when earlier then behind else ahead end) <= 120000000 then 'timeline' else 'inferred' end as acct_q from z")
def jn_10(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return accounts.by_probe(rows, _probes(rows))


@query("cx_13_workspaces")
def cx_13(spark, sf_dir):
    """Customers as projects, each under several spellings, in folders of one another."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    path = F.concat(F.lit("/home/u"), (n % 5).cast("string"), F.lit("/project-"), (n % 97).cast("string"))
    forms = F.array(path, F.concat(path, F.lit("/sub/dir"), (n % 3).cast("string")), F.regexp_replace(path, "/", "-"), F.concat(F.lit("\\\\wsl$\\Ubuntu"), F.replace(path, F.lit("/"), F.lit("\\"))), F.sha2(path, 256), F.concat(F.lit("/mnt/c"), path), F.concat(F.lit("file://"), path))
    return workspaces.canonical(c.select(F.explode(forms).alias("raw"), F.lit(1).alias("n")))
