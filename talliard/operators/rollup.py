"""Day rollups in long form, the account ledger, and flat cells."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talliard.functions.ids import utc_day
from talliard.functions.metrics import TOKENS
from talliard.operators.merge import MEASURES, acct_rank

#: What an empty key is called.
UNKNOWN = {"model": "unknown", "machine": "unknown", "cc": "ZZ", "ws": "unknown"}


def named(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(UNKNOWN[column]))


def totals(names=MEASURES) -> list[Column]:
    return [F.sum(m).cast("long").alias(m) for m in names]


def by_provider(usage: DataFrame) -> DataFrame:
    """date, provider: each measure of exact and of estimated events, and their numbers."""
    tier = lambda m, estimated: F.sum(F.when((F.col("q") == "estimated") == estimated, F.col(m)).otherwise(0)).cast("long")
    sums = [tier(m, e).alias(f"{'estimated' if e else 'exact'}_{m}") for e in (False, True) for m in MEASURES]
    return usage.withColumn("events", F.lit(1)).groupBy("date", "provider").agg(*sums, F.count("*").alias("events"), F.count_if(F.col("q") == "estimated").alias("estimated_events"))


def by_model(usage: DataFrame) -> DataFrame:
    tier = F.when(F.col("q") == "estimated", "estimated").otherwise("exact")
    return usage.groupBy("date", "provider", tier.alias("tier"), named("model").alias("model")).agg(*totals(), F.count("*").alias("events"))


def by_places(usage: DataFrame) -> DataFrame:
    """One pass for machines, countries, workspaces and sources: date, provider, kind, place and the four disjoint measures."""
    places = F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("place")) for kind, value in (("machine", named("machine")), ("country", named("cc")), ("workspace", named("ws")), ("source", F.col("source")))))
    return usage.withColumn("p", F.explode(places)).groupBy("date", "provider", "p.kind", "p.place").agg(*totals(TOKENS), F.count("*").alias("events"))


def accounts(usage: DataFrame) -> DataFrame:
    """date, provider, the sorted accounts as text and their number."""
    found = F.sort_array(F.collect_set(F.nullif(F.col("acct"), F.lit(""))))
    return usage.groupBy("date", "provider").agg(F.array_join(found, ",").alias("accts"), F.size(found).cast("long").alias("n_accts"))


def ledger(usage: DataFrame) -> DataFrame:
    """UTC date, provider, source, account where it is labelled: tokens."""
    acct = F.when(acct_rank() >= 3, F.col("acct")).otherwise("")
    return usage.groupBy(utc_day(F.col("ts")).alias("date"), "provider", "source", acct.alias("acct")).agg(F.sum(sum((F.col(m) for m in TOKENS), F.lit(0))).cast("long").alias("tokens"))


def cells(usage: DataFrame, activity: DataFrame, prompts: DataFrame) -> DataFrame:
    """(date, provider, source, model, acct, q): measures, events, prompts, prompts without usage, prompts with a model."""
    keys = ["date", "provider", "source", "model", "acct", "q"]
    counts = [*MEASURES, "events", "prompts", "prompts_no_usage", "model_prompts"]
    zero = lambda df: df.withColumns({c: F.lit(0) for c in counts if c not in df.columns}).select(*keys, *counts)
    parts = [
        zero(usage.withColumn("events", F.lit(1))),
        zero(activity.withColumns({"model": F.lit(""), "q": F.lit(""), "prompts": F.lit(1), "prompts_no_usage": (~F.col("has_usage")).cast("int")})),
        zero(prompts.withColumns({"q": F.lit(""), "model_prompts": F.lit(1)})),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in counts))
