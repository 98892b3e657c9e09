"""Machines and accounts of a fleet as others may see them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that may be shown, how long ago a live machine was seen, in minutes, and lengths of texts.
SHOWN = ["id", "label", "cc", "os", "live", "last_seen_at", "first_seen_at"]
LIVE = 10
LABEL, OS = 64, 32


def public_machines(machines: DataFrame, now: str, live_minutes: int = LIVE) -> DataFrame:
    """The columns that may be shown, and nothing else a row holds; machines (id, label, cc, os, last_seen_at, enrolled_at, ...)."""
    label = F.substring(F.trim(F.coalesce("label", F.lit(""))), 1, LABEL)
    seen = F.col("last_seen_at") > F.lit(now).cast("timestamp") - F.expr(f"interval {live_minutes} minutes")
    rows = machines.withColumns({
        "label": F.when(label == "", F.col("id")).otherwise(label), "cc": F.when(F.col("cc").rlike("^[A-Z]{2}$"), F.col("cc")).otherwise(""),
        "os": F.substring(F.coalesce("os", F.lit("")), 1, OS), "live": F.coalesce(seen, F.lit(False)), "first_seen_at": F.col("enrolled_at"),
    })
    return rows.select(*SHOWN)


def anonymous(machines: DataFrame) -> DataFrame:
    """public_machines() for those who are not signed in: numbered in the order they came, with their id and whether they are live.

    A fleet's machines are people's computers, so one task can number them.
    """
    order = F.struct(F.coalesce("first_seen_at", F.lit("0001-01-01").cast("timestamp")), "id")
    ranked = machines.groupBy(F.lit(1).alias("one")).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "id", "live"))).alias("ms")).select(F.posexplode("ms").alias("n", "m"))
    none, moment = F.lit(""), F.lit(None).cast("timestamp")
    return ranked.select("m.id", F.concat(F.lit("Machine "), F.col("n") + 1).alias("label"), none.alias("cc"), none.alias("os"), "m.live", moment.alias("last_seen_at"), moment.alias("first_seen_at"))


def totals(machines: DataFrame, accounts: DataFrame, providers: list[str]) -> DataFrame:
    """One row: accounts (provider, acct), those of each provider, machines and those that are live."""
    held = accounts.select("provider", "acct").distinct().agg(F.count("*").alias("accounts"), *(F.count_if(F.col("provider") == p).alias(f"accounts_{p}") for p in providers))
    return held.crossJoin(F.broadcast(machines.agg(F.count("*").alias("machines"), F.count_if("live").alias("machines_live"))))


def one_index(live: DataFrame, deployed: DataFrame) -> DataFrame:
    """(machine, files, source): what two indexes (machine, files) list, each file once; source tells which of them know the machine."""
    both = live.select("machine", F.col("files").alias("_l")).join(deployed.select("machine", F.col("files").alias("_d")), "machine", "full")
    none = F.array().cast("array<string>")
    source = F.when(F.col("_d").isNull(), "live").when(F.col("_l").isNull(), "deployed").otherwise("both")
    return both.select("machine", F.sort_array(F.array_union(F.coalesce("_l", none), F.coalesce("_d", none))).alias("files"), source.alias("source"))
