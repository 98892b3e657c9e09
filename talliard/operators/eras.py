"""Eras of one plan: runs of plan marks that no unexplained change of plan breaks, and the one account seen in each.

A record (provider, home, stream, plan, ts, to_ts) says that a stream of work ran under a plan from ts to to_ts; its two ends
are marks. A change of plan between two marks in a row breaks the era, unless some stream ran under both plans and was
alive at the change: then one login saw both. Marks of a key may be very many, so everything in time goes by (key, day), and days
hand on one row each; what remains by key alone are the breaks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talliard.operators.asof import last_before
from talliard.tables import staged

KEYS = ["provider", "home"]


def previous(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """rows with _prev, the values of the row before in order (which begins with a time); null for a key's first row."""
    held = F.struct(*values)
    rows = rows.withColumn("_day", F.to_date(order[0]))
    days = rows.groupBy(*keys, "_day").agg(F.max_by(held, F.struct(*order)).alias("_last"))
    before = days.withColumn("_edge", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day"))).drop("_last")
    own = F.lag(held).over(Window.partitionBy(*keys, "_day").orderBy(*order))
    return rows.withColumn("_own", own).join(before, [*keys, "_day"]).withColumn("_prev", F.coalesce("_own", "_edge")).drop("_own", "_edge", "_day")


def largest_so_far(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """rows with _max, the largest value up to each row in order (which begins with a time)."""
    rows = rows.withColumn("_v", value).withColumn("_day", F.to_date(order[0]))
    days = rows.groupBy(*keys, "_day").agg(F.max("_v").alias("_top"))
    before = days.withColumn("_edge", F.max("_top").over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    own = F.max("_v").over(Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(before, [*keys, "_day"]).withColumn("_max", F.greatest("_own", "_edge")).drop("_own", "_edge", "_v", "_day")


def _breaks(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(KEYS, t1, t2) of the marks around each break, and (KEYS, first, last) of all marks."""
    end = F.greatest("ts", "to_ts")
    marks = records.select(*KEYS, "stream", "plan", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("ts").alias("at")), F.struct(F.lit(1).alias("k"), end.alias("at")))).alias("m"), F.col("ts").alias("begun"))
    marks = marks.select(*KEYS, F.col("m.at").alias("at"), "begun", "stream", "plan", F.col("m.k").alias("k"))
    changed = previous(marks, KEYS, ["at", "begun", "stream", "plan", "k"], ["at", "plan"]).where("_prev.plan <> plan")
    changed = changed.select(*KEYS, F.col("_prev.at").alias("t1"), F.col("at").alias("t2"), F.least("plan", "_prev.plan").alias("a"), F.greatest("plan", "_prev.plan").alias("b"))
    streams = records.groupBy(*KEYS, "stream").agg(F.min("ts").alias("first"), F.max(end).alias("last"), F.sort_array(F.collect_set("plan")).alias("plans")).where("size(plans) > 1")
    pairs = streams.withColumn("a", F.explode("plans")).withColumn("b", F.explode("plans")).where("a < b")
    # some stream of both plans begins by t2 and ends at t1 or later, if the latest end of those that begin by t2 does
    spans = pairs.select(*KEYS, "a", "b", F.col("first").alias("at"), F.lit(0).alias("asked"), "last", F.lit(None).cast("timestamp").alias("t1"))
    asked = changed.select(*KEYS, "a", "b", F.col("t2").alias("at"), F.lit(1).alias("asked"), F.lit(None).cast("timestamp").alias("last"), "t1")
    judged = largest_so_far(spans.unionByName(asked), [*KEYS, "a", "b"], ["at", "asked"], F.col("last")).where("asked = 1")
    broken = judged.where(~F.coalesce(F.col("_max") >= F.col("t1"), F.lit(False))).select(*KEYS, "t1", F.col("at").alias("t2"))
    return broken, records.groupBy(*KEYS).agg(F.min("ts").alias("first"), F.max(end).alias("last"))


def plan_eras(records: DataFrame, anchors: DataFrame) -> DataFrame:
    """(provider, home, from_ts, to_ts, acct): each era, and the account of the anchors (provider, home, ts, acct) in it if they all agree.

    Marks at one moment go by their record's start, stream and plan. Bounds belong to an era, so an anchor may lie in two.
    """
    broken, whole = _breaks(records.where("ts is not null and plan is not null and stream is not null"))
    w = Window.partitionBy(*KEYS).orderBy("from_ts", "k")
    begins = whole.select(*KEYS, F.col("first").alias("from_ts"), F.lit(None).cast("timestamp").alias("before"), F.lit(0).alias("k"))
    begins = begins.unionByName(broken.select(*KEYS, F.col("t2").alias("from_ts"), F.col("t1").alias("before"), F.lit(1).alias("k")))
    eras = begins.withColumn("next", F.lead("before").over(w)).join(whole.select(*KEYS, "last"), KEYS)
    eras = staged(eras.select(*KEYS, "from_ts", F.coalesce("next", "last").alias("to_ts")).distinct())  # few rows, read five times
    found = in_eras(anchors.withColumn("id", F.struct(*KEYS, "ts", "acct")).select("id", *KEYS, "ts").distinct(), eras)
    named = found.groupBy(*KEYS, "from_ts", "to_ts").agg(F.min("id.acct").alias("lo"), F.max("id.acct").alias("hi")).where("lo = hi")
    return eras.join(named.select(*KEYS, "from_ts", "to_ts", F.col("lo").alias("acct")), [*KEYS, "from_ts", "to_ts"], "left")


def in_eras(events: DataFrame, eras: DataFrame) -> DataFrame:
    """(id, provider, home, from_ts, to_ts) of the eras around each event (id, provider, home, ts), bounds included.

    Eras follow each other, so one is found as of the event's time, and others can only end or begin at that very moment.
    """
    span = eras.select(*KEYS, F.col("from_ts").alias("ts"), F.struct("from_ts", "to_ts").alias("era"))
    within = last_before(events, span, KEYS, "era").where("ts <= era.to_ts").select("id", *KEYS, "era.*")
    ends = events.join(eras.withColumn("ts", F.col("to_ts")), [*KEYS, "ts"]).select("id", *KEYS, "from_ts", "to_ts")
    starts = events.join(eras.withColumn("ts", F.col("from_ts")), [*KEYS, "ts"]).select("id", *KEYS, "from_ts", "to_ts")
    return within.unionByName(ends).unionByName(starts).distinct()


def by_era(events: DataFrame, eras: DataFrame) -> DataFrame:
    """(id, acct) of events in an era with an account, the earliest such era."""
    known = staged(eras.where("acct is not null"))
    found = in_eras(events.select("id", *KEYS, "ts"), known).join(known, [*KEYS, "from_ts", "to_ts"])
    return found.groupBy("id").agg(F.min_by("acct", F.struct("from_ts", "to_ts")).alias("acct"))
