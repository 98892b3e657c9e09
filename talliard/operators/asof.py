"""As-of, nearest and interval lookups of identity at an event's time.

Keys are few and hot (a provider may hold a third of all rows), so lookups go by (keys, UTC day): a day's rows are one
window, and what the days before and after give it comes from one row a day.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def around(events: DataFrame, samples: DataFrame, keys: list[str], value: str, ahead: bool) -> DataFrame:
    """events' columns, _b (the last sample not later: at, value) and, if asked for, _a (the first one later)."""
    none = lambda schema, c: F.lit(None).cast(schema[c].dataType).alias(c)
    mine = events.select("id", *keys, "ts", none(samples.schema, value).alias("_v"), F.lit(1).alias("_e"))
    theirs = samples.select(none(events.schema, "id"), *keys, "ts", F.col(value).alias("_v"), F.lit(0).alias("_e"))
    both = mine.unionByName(theirs).withColumn("_day", F.to_date("ts"))
    sample = F.when(F.col("_e") == 0, F.struct(F.col("ts").alias("at"), F.col("_v").alias(value)))
    days = both.groupBy(*keys, "_day").agg(F.max(sample).alias("_last"), F.min(sample).alias("_first"))
    over_days = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    edges = days.withColumn("_before", F.last("_last", True).over(over_days)).withColumn("_after", F.last("_first", True).over(back)).drop("_last", "_first")
    order = ["ts", "_e", "_v"]
    in_day = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_b", F.last(sample, True).over(in_day))
    if ahead:  # over the reversed order, as frames that shrink cost the square of their rows
        found = found.withColumn("_a", F.last(sample, True).over(Window.partitionBy(*keys, "_day").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)))
    found = found.where("_e = 1").join(edges, [*keys, "_day"]).withColumn("_b", F.coalesce("_b", "_before"))
    return found.withColumn("_a", F.coalesce("_a", "_after")) if ahead else found


def last_before(events: DataFrame, samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """events (id, keys, ts) with value and at of the last sample not later; no range join."""
    return around(events, samples, keys, value, False).select("id", *keys, "ts", f"_b.{value}", "_b.at")


def nearest(events: DataFrame, samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The sample nearest in time, ties to the earlier one."""
    gap = lambda c: F.abs(F.unix_micros("ts") - F.unix_micros(F.col(f"{c}.at")))
    pick = F.when(F.col("_a").isNull() | (gap("_b") <= gap("_a")), F.col("_b")).otherwise(F.col("_a"))
    return around(events, samples, keys, value, True).withColumn("_s", pick).select("id", *keys, "ts", f"_s.{value}", "_s.at")


def intervals(records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, from_ts, to_ts) from state changes (keys, ts, value): each lasts until a different one; the last is open."""
    w = Window.partitionBy(*keys).orderBy("ts", value)
    changed = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True))
    starts = records.select(*keys, "ts", value, changed.alias("_new")).where("_new")
    return starts.select(*keys, value, F.col("ts").alias("from_ts"), F.lead("ts").over(w).alias("to_ts"))


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values in order: keys, value, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True)).cast("int")
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def counter_deltas(rows: DataFrame, keys: list[str], order: str, total: str) -> DataFrame:
    """A cumulative counter's rows without repeats, with its epoch: one more each time the total falls."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_before", F.lag(total).over(w))
    marked = marked.withColumn("epoch", F.sum((F.coalesce(F.col(total) < F.col("_before"), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(~F.col(total).eqNullSafe(F.col("_before"))).withColumn("delta", F.when(F.col(total) >= F.col("_before"), F.col(total) - F.col("_before")).otherwise(F.col(total))).drop("_before")
