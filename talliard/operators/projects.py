"""Recorded usage by project and time period, for every account at once: named tags, nine windows, and what they leave out."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talliard.functions import ids
from talliard.functions.metrics import TOKENS
from talliard.operators.merge import acct_rank

# Periods in minutes, and days of a plan's week.
PERIODS = {"30m": 30, "1h": 60, "3h": 180, "6h": 360, "12h": 720, "24h": 1440, "3d": 4320, "7d": 10080}
WEEK = 7
UNASSIGNED = "unassigned"


def names_of_tags(activity: DataFrame, prompts: DataFrame, until: str, key: bytes | None = None) -> DataFrame:
    """(ws, name): what prompts (provider, session, ts, workspace, name) say of tags; a tag that is named in two ways has no name.

    A prompt names the tag of an activity of its session at its very moment, unless prompts of that moment disagree; and where the fleet's key
    is known, the tag that its workspace has by it.
    """
    known = prompts.where((F.coalesce("workspace", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "") & (F.col("ts") <= F.lit(until).cast("timestamp")))
    at = ["provider", "session", "ts"]
    agreed = known.where("session <> ''").groupBy(*at).agg(F.min("name").alias("name"), F.max("name").alias("other")).where("name = other").drop("other")
    offers = activity.where("ws <> '' and session <> ''").select(*at, "ws").join(agreed, at).select("ws", "name")
    if key is not None:
        offers = offers.unionByName(known.select("workspace", "name").distinct().select(ids.workspace_tag(key, F.col("workspace")).alias("ws"), "name"))
    return offers.groupBy("ws").agg(F.min("name").alias("name"), F.max("name").alias("other")).where("name = other").drop("other")


def weekly_range(resets_at: Column, now: str) -> Column:
    """(since, until, projected) of the plan's week around now; a reset that has passed stands for those every seven days behind it."""
    day = 86_400_000_000
    t, end = F.unix_micros(F.lit(now).cast("timestamp")), F.unix_micros(resets_at)
    passed = end <= t
    until = F.when(passed, end + (F.floor((t - end) / (WEEK * day)) + 1) * (WEEK * day)).otherwise(end)
    found = F.struct(F.timestamp_micros(until - WEEK * day).alias("since"), F.timestamp_micros(until).alias("resets_at"), passed.alias("projected"))
    return F.when(until - WEEK * day <= t, found)


def windows(accounts: DataFrame, weekly: DataFrame, now: str) -> DataFrame:
    """(provider, acct, range, since, resets_at, projected): eight periods up to now, and the plan's week where its newest reading (provider, acct, resets_at, observed_at) tells it."""
    newest = weekly.groupBy("provider", "acct").agg(F.max_by("resets_at", "observed_at").alias("at"))
    rows = accounts.select("provider", "acct").distinct().join(newest, ["provider", "acct"], "left").withColumn("week", weekly_range(F.col("at"), now))
    moment = F.lit(now).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    periods = [F.struct(F.lit(name).alias("range"), F.timestamp_add("MINUTE", F.lit(-m), moment).alias("since"), none.alias("resets_at"), F.lit(False).alias("projected")) for name, m in PERIODS.items()]
    week = F.when(F.col("week").isNotNull(), F.struct(F.lit("reset").alias("range"), F.col("week.since").alias("since"), F.col("week.resets_at").alias("resets_at"), F.col("week.projected").alias("projected")))
    return rows.select("provider", "acct", F.explode(F.array(*periods, week)).alias("w")).where("w is not null").select("provider", "acct", "w.*")


def _in_windows(usage: DataFrame, spans: DataFrame, now: str) -> DataFrame:
    """Usage of accounts in each of their windows, with tokens, and whether its time is known and its account is certain."""
    earliest = spans.groupBy("provider", "acct").agg(F.min("since").alias("_first"))
    rows = usage.where(F.col("ts") < F.lit(now).cast("timestamp")).join(earliest, ["provider", "acct"]).where("ts >= _first").drop("_first")
    rows = rows.join(spans.select("provider", "acct", "range", "since"), ["provider", "acct"]).where("ts >= since")
    loose = (F.col("ts_q") == "session-start") | ((F.col("source") == "cursor") & (F.col("ts_q") != "event"))
    return rows.withColumns({"tokens": sum((F.col(m) for m in TOKENS), F.lit(0)).cast("long"), "loose": loose, "certain": acct_rank() >= 3})


def _sums() -> list[Column]:
    tier = lambda q: F.sum(F.when((F.col("q") == "estimated") == (q == "estimated"), F.col("tokens")).otherwise(0)).cast("long").alias(f"{q}_tokens")
    return [F.sum("tokens").cast("long").alias("tokens"), tier("exact"), tier("estimated"), F.sum(F.when(F.col("calls") > 0, F.col("calls")).otherwise(1)).cast("long").alias("calls")]


def by_project(usage: DataFrame, spans: DataFrame, tags: DataFrame, labels: DataFrame, now: str) -> DataFrame:
    """(provider, acct, range, project, tokens, exact_tokens, estimated_tokens, calls, percent, place): projects by label, whatever its case, the largest first.

    tags: (ws, name); labels: (name, label). Usage whose tag has no name is unassigned.
    """
    rows = _in_windows(usage, spans, now).where("not loose and certain and tokens > 0")
    named = rows.join(tags, "ws", "left").join(labels, "name", "left")
    project = F.coalesce(F.nullif(F.lower("label"), F.lit("")), F.lit(UNASSIGNED))
    sums = named.groupBy("provider", "acct", "range", project.alias("project")).agg(*_sums())
    of = Window.partitionBy("provider", "acct", "range")
    ranked = sums.withColumn("percent", F.round(100.0 * F.col("tokens") / F.sum("tokens").over(of), 6))
    return ranked.withColumn("place", F.row_number().over(of.orderBy(F.desc("tokens"), "project")))


def totals(usage: DataFrame, spans: DataFrame, now: str) -> DataFrame:
    """(provider, acct, range): sums, tokens of uncertain accounts, and timing_limited where some usage has no time of its own."""
    rows = _in_windows(usage, spans, now)
    counted = rows.where("not loose and certain and tokens > 0").groupBy("provider", "acct", "range").agg(*_sums())
    rest = rows.groupBy("provider", "acct", "range").agg(F.sum(F.when(~F.col("loose") & ~F.col("certain"), F.col("tokens")).otherwise(0)).cast("long").alias("uncertain_tokens"), F.max("loose").alias("loose"))
    keys = ["provider", "acct", "range"]
    found = spans.join(counted, keys, "left").join(rest, keys, "left").fillna(0, ["tokens", "exact_tokens", "estimated_tokens", "calls", "uncertain_tokens"])
    return found.withColumn("timing_limited", (F.col("provider") == "cursor") | F.coalesce("loose", F.lit(False))).drop("loose")
