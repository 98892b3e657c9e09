"""API-equivalent cost: prices by model name or pattern, and by date."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliard.functions.metrics import TOKENS, cost

RATES = ["input", "output", "cache_read", "cache_write", "cache_write_1h"]


def price_names(models: DataFrame, current: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """(model, priced_as): the id itself if it has a price, else the first pattern in order whose model has one.

    The pattern table is a configuration of a few rows, matched on distinct models only.
    """
    names = models.select("model", F.lower(F.trim("model")).alias("name")).distinct()
    known = current.select(F.col("model").alias("known"))
    usable = fallbacks.join(known, fallbacks.use_model == known.known).select("ord", "pattern", "use_model")
    matched = names.join(F.broadcast(usable), F.expr("name rlike pattern")).groupBy("model").agg(F.min_by("use_model", "ord").alias("fallback"))
    return names.join(known, names.name == known.known, "left").join(matched, "model", "left").select("model", F.coalesce("known", "fallback").alias("priced_as"))


def price_rows(usage: DataFrame, current: DataFrame, windows: DataFrame, fallbacks: DataFrame, at_the_time: bool) -> DataFrame:
    """usage with usd: null where the model, the day or a used bucket has no price."""
    names = price_names(usage.select("model"), current, fallbacks)
    rows = usage.join(names, "model", "left")
    if not at_the_time:
        priced = rows.join(current.withColumnRenamed("model", "priced_as"), "priced_as", "left")
    else:
        w = windows.withColumnRenamed("model", "priced_as")
        days = rows.select("priced_as", "date").distinct().join(w, "priced_as").where("date >= from_date and date <= coalesce(to_date, '9999-12-31')")
        first = days.groupBy("priced_as", "date").agg(F.min_by(F.struct(*RATES), "from_date").alias("r")).select("priced_as", "date", "r.*")
        priced = rows.join(first, ["priced_as", "date"], "left")
    has = sum((F.col(m) for m in TOKENS), F.lit(0)) > 0
    return priced.withColumn("usd", F.when(has & F.col("input").isNull() & F.col("output").isNull(), None).otherwise(cost())).drop("priced_as", *RATES)


def _exact():
    """Dollars as whole hundred-millionths, so that sums do not depend on their order."""
    return F.round(F.col("usd") * 1e8).cast("long")


def cost_by_model(priced: DataFrame) -> DataFrame:
    """Null where no day had a price; unpriced counts the days without one."""
    days = priced.groupBy("provider", "model", "date").agg(F.sum(_exact()).alias("usd"), F.bool_or(F.col("usd").isNull()).alias("open"))
    return days.groupBy("provider", "model").agg((F.sum("usd") / 1e8).alias("usd"), F.count_if("open").alias("unpriced_days"))


def cost_by_day(priced: DataFrame) -> DataFrame:
    return priced.groupBy("date").agg((F.sum(_exact()) / 1e8).alias("usd"), F.bool_or(F.col("usd").isNull()).alias("unpriced"))
