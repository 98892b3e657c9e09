"""Plan-quota readings: the newest of each meter, what is stale, and accounts by what is left."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliard.functions.metrics import severity
from talliard.operators.merge import newest

STALE_DAYS = 14


def current(readings: DataFrame) -> DataFrame:
    """Of each (provider, acct, win) the newest reading; of codex those with a quota source before any without."""
    attributed = ((F.col("provider") == "openai") & (F.coalesce("quota_source", F.lit("")) != "")).cast("int")
    return newest(readings, ["provider", "acct", "win"], attributed, F.col("observed_at"), F.coalesce("used_percent", F.lit(-1.0)))


def fresh(readings: DataFrame, now: str) -> DataFrame:
    """Without meters whose reset is longer past; plans and meters without a reset stay."""
    return readings.where((F.col("win") == "plan") | F.col("resets_at").isNull() | (F.col("resets_at") >= F.expr(f"timestamp'{now}' - interval {STALE_DAYS} days")))


def weekly(readings: DataFrame, now: str) -> DataFrame:
    """Weekly meters whose reset is past count as unused, with the reset of the week that holds now."""
    week, t = 7 * 86400, F.unix_seconds(F.lit(now).cast("timestamp"))
    behind = (F.col("win") == "week") & (F.col("resets_at") <= F.lit(now).cast("timestamp"))
    ahead = F.timestamp_seconds(F.unix_seconds("resets_at") + (F.floor((t - F.unix_seconds("resets_at")) / week) + 1) * week)
    return readings.withColumn("used_percent", F.when(behind, 0.0).otherwise(F.col("used_percent"))).withColumn("resets_at", F.when(behind, ahead).otherwise(F.col("resets_at")))


def accounts(readings: DataFrame) -> DataFrame:
    """(provider, acct) with its session and week percentages, state, and place among its provider's accounts.

    The weekly meter alone decides the place: most left first, then those with nothing left by soonest reset, then those without a
    reading; ties by account. Percentages outside 0 to 100 are no readings.
    """
    used = F.when(F.col("used_percent").between(0, 100), F.col("used_percent"))
    pick = lambda win, value: F.max(F.when(F.col("win") == win, value))
    rows = readings.groupBy("provider", "acct").agg(pick("session", used).alias("session_percent"), pick("week", used).alias("week_percent"), pick("week", F.col("resets_at")).alias("resets_at"))
    week = F.col("week_percent")
    group = F.when(week.isNull(), 2).when(week >= 100, 1).otherwise(0)
    order = Window.partitionBy("provider").orderBy(group, F.when(group == 0, week), F.when(group == 1, F.col("resets_at")).asc_nulls_last(), "acct")
    return rows.withColumn("state", severity(F.greatest("session_percent", "week_percent"))).withColumn("place", F.row_number().over(order))


def with_known_labels(readings: DataFrame) -> DataFrame:
    """Readings without a label get that of their account, if all its readings name the same one, whatever its case."""
    label = F.nullif(F.btrim("label"), F.lit(""))
    known = readings.where(label.isNotNull() & (F.coalesce("acct", F.lit("")) != "")).groupBy("provider", "acct").agg(F.max(label).alias("_label"), F.min(F.lower(label)).alias("_a"), F.max(F.lower(label)).alias("_b")).where("_a = _b")
    return readings.join(known.drop("_a", "_b"), ["provider", "acct"], "left").withColumn("label", F.coalesce(label, "_label", F.lit(""))).drop("_label")


def usage_in_windows(usage: DataFrame, windows: list[tuple[str, str, str]], name: str, value) -> DataFrame:
    """(range, name, value, share) for several time windows from one read; windows are (range, since, until), a few rows."""
    w = F.explode(F.array(*(F.struct(F.lit(r).alias("range"), F.lit(a).cast("timestamp").alias("since"), F.lit(b).cast("timestamp").alias("until")) for r, a, b in windows)))
    rows = usage.withColumn("w", w).where((F.col("ts") >= F.col("w.since")) & (F.col("ts") < F.col("w.until")))
    sums = rows.groupBy(F.col("w.range").alias("range"), F.lower(name).alias("name")).agg(F.sum(value).cast("long").alias("value"))
    return sums.withColumn("share", F.round(100.0 * F.col("value") / F.sum("value").over(Window.partitionBy("range")), 6))
