"""What a dashboard asks of day rows (date, provider, tier, model, machine, measures): summaries, series, heat, feeds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talliard.functions.metrics import heat_level
from talliard.tables import staged


def _sequence(first: str, last: str, step: str) -> str:
    start = {"1 day": f"date'{first}'", "1 week": f"cast(date_trunc('week', date'{first}') as date)", "1 month": f"trunc(date'{first}', 'month')"}[step]
    return f"explode(sequence({start}, date'{last}', interval {step})) as date"


def dates(spark, first: str, last: str, step: str = "1 day") -> DataFrame:
    """(date) from first to last; monday-based weeks and months when the step says so."""
    return spark.sql(f"select {_sequence(first, last, step)}")


def period_summary(days: DataFrame, value: Column, first: str, last: str) -> DataFrame:
    """One row: total, active days, months with any, per month, distinct providers."""
    rows = days.where(F.col("date").between(first, last)).withColumn("v", value)
    some = F.when(F.col("v") > 0, F.col("date"))
    return rows.agg(
        F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("total"), F.count_distinct(some).alias("active_days"),
        F.count_distinct(F.substring(some, 1, 7)).alias("months"), F.count_distinct(F.when(F.col("v") > 0, F.col("provider"))).alias("providers"),
    ).withColumn("per_active_day", F.when(F.col("active_days") > 0, F.round(F.col("total") / F.col("active_days"), 4)).otherwise(0.0))


def series(days: DataFrame, value: Column, first: str, last: str, step: str) -> DataFrame:
    """(bucket, provider, value) for each bucket, zero where nothing was; weeks begin on Monday."""
    unit = step.split()[1]
    rows = days.where(F.col("date").between(first, last))
    found = rows.groupBy(F.date_format(F.date_trunc(unit, F.to_date("date")), "yyyy-MM-dd").alias("bucket"), "provider").agg(F.sum(value).cast("long").alias("value"))
    every = days.select("provider").distinct().selectExpr("provider", _sequence(first, last, step)).select("provider", F.date_format("date", "yyyy-MM-dd").alias("bucket"))
    return every.join(found, ["bucket", "provider"], "left").select("bucket", "provider", F.coalesce("value", F.lit(0)).alias("value"))


def heatmap(days: DataFrame, value: Column, first: str, last: str) -> DataFrame:
    """(date, value, level) of all days; levels by quartiles of the days that have any."""
    found = days.groupBy("date").agg(F.sum(value).cast("long").alias("value"))
    all_days = dates(days.sparkSession, first, last).select(F.date_format("date", "yyyy-MM-dd").alias("date")).join(found, "date", "left").fillna(0, ["value"])
    quartiles = all_days.where("value > 0").agg(F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    return all_days.crossJoin(F.broadcast(quartiles)).select("date", "value", F.coalesce(heat_level(F.col("value"), F.col("q")), F.lit(0)).alias("level"))


def heat_weeks(days: DataFrame, value: Column, prompts: Column, last: str, weeks: int = 53) -> DataFrame:
    """(date, week, weekday, value, prompts, level, untracked) of whole weeks from a Monday to the last date; a day with prompts but no value is untracked."""
    spine = days.sparkSession.range(1).select(F.lit(last).cast("date").alias("to"))
    first = F.date_sub(F.date_trunc("week", "to").cast("date"), 7 * (weeks - 1))
    spine = spine.select(first.alias("from"), F.explode(F.sequence(first, F.col("to"))).alias("d"))
    spine = spine.select(F.date_format("d", "yyyy-MM-dd").alias("date"), F.floor(F.datediff("d", "from") / 7).cast("int").alias("week"), F.weekday("d").alias("weekday"))
    found = days.where(F.col("date") <= last).groupBy("date").agg(F.sum(value).cast("long").alias("value"), F.sum(prompts).cast("long").alias("prompts"))
    shown = spine.join(found, "date", "left").fillna(0, ["value", "prompts"])
    quartiles = shown.where("value > 0").agg(F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    level = F.coalesce(heat_level(F.col("value"), F.col("q")), F.lit(0))
    return shown.crossJoin(F.broadcast(quartiles)).select("date", "week", "weekday", "value", "prompts", level.alias("level"), ((F.col("prompts") > 0) & (F.col("value") <= 0)).alias("untracked"))


def shares(rows: DataFrame, keys: list[str], value: str, within: list[str]) -> DataFrame:
    """Each key's total, its percentage of the group, and its rank by value, ties by key."""
    totals = rows.groupBy(*within, *keys).agg(F.sum(value).cast("long").alias(value))
    group = Window.partitionBy(*within)
    return totals.withColumn("share", F.round(100.0 * F.col(value) / F.sum(value).over(group), 6)).withColumn("rank", F.row_number().over(group.orderBy(F.desc(value), *keys)).cast("long"))


def first_uses(days: DataFrame, keys: list[str]) -> DataFrame:
    """When each key was first used, and whether it began after the history did."""
    start = days.agg(F.min(F.substring("date", 1, 7)).alias("start"))
    return days.groupBy(*keys).agg(F.min("date").alias("first")).crossJoin(F.broadcast(start)).select(*keys, "first", (F.substring("first", 1, 7) > F.col("start")).alias("started"))


def monthly(days: DataFrame, value: Column) -> DataFrame:
    return days.groupBy(F.substring("date", 1, 7).alias("month"), "provider", "model").agg(F.sum(value).cast("long").alias("value"), F.count_distinct("date").alias("days"))


def calendar(months: DataFrame) -> DataFrame:
    """The grid of whole weeks of each month: (month, date, weekday from Monday 0, week, inside)."""
    first = F.to_date(F.concat("month", F.lit("-01")))
    start, end = F.date_trunc("week", first).cast("date"), F.last_day(first)
    days = months.select("month", start.alias("s"), F.explode(F.sequence(start, F.date_add(end, 6 - F.weekday(end)))).alias("d"))
    return days.select("month", F.date_format("d", "yyyy-MM-dd").alias("date"), F.weekday("d").alias("weekday"), F.floor(F.datediff("d", "s") / 7).cast("int").alias("week"), (F.date_format("d", "yyyy-MM") == F.col("month")).alias("inside"))


def dense_aliases(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """(value, alias) of the distinct values in order: prefix1, prefix2, ...

    Values are dealt in ranges, numbered in each, and each range begins behind the sum of those before: one row a range.
    """
    values = rows.select(F.col(column).alias("value")).where("value <> ''").distinct()
    ranges = staged(values.repartitionByRange("value").withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranges.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy("value"))).join(sizes.select("_range", before.alias("_before")), "_range")
    return numbered.select("value", F.concat(F.lit(prefix), (F.col("_k") + F.col("_before")).cast("string")).alias("alias"))


def machine_scope(cells: DataFrame, machine: str, values: list[str]) -> DataFrame:
    """One machine's part of cells (date, provider, ws, machine, model, values): models are exact where a day's provider or workspace had
    this machine alone, else unknown and partial."""
    alone = cells.groupBy("date", "provider", "ws").agg(F.min("machine").alias("a"), F.max("machine").alias("b"))
    day = alone.groupBy("date", "provider").agg(F.min("a").alias("day_a"), F.max("b").alias("day_b"))
    own = cells.where(F.col("machine") == machine).join(alone, ["date", "provider", "ws"]).join(day, ["date", "provider"])
    partial = (F.col("a") != F.col("b")) & (F.col("day_a") != F.col("day_b"))
    return own.groupBy("date", "provider", "ws", F.when(partial, "unknown").otherwise(F.col("model")).alias("model"), partial.alias("partial")).agg(*(F.sum(v).cast("long").alias(v) for v in values))


def largest_remainder(rows: DataFrame, within: list[str], key: str, amount: str, weight: str) -> DataFrame:
    """Splits each group's whole amount by weight: floors, then one each by the largest remainder, ties by key; sums are exact."""
    group = Window.partitionBy(*within)
    parted = (
        rows.withColumn("_w", F.sum(weight).over(group))
        .withColumn("_floor", F.expr(f"({amount} * {weight}) div _w")).withColumn("_rest", F.expr(f"({amount} * {weight}) % _w"))
        .withColumn("_left", F.col(amount) - F.sum("_floor").over(group))
        .withColumn("_rank", F.row_number().over(group.orderBy(F.desc("_rest"), key)))
    )
    return parted.withColumn("part", (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).cast("long")).drop("_w", "_floor", "_rest", "_left", "_rank")
