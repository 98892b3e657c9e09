"""Measures of a usage row, costs, heat levels and short labels as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = ["tok_in", "cache_w", "cache_r", "tok_out"]


def tokens(unattributed: Column | None = None) -> Column:
    total = F.col("tok_in") + F.col("cache_w") + F.col("cache_r") + F.col("tok_out")
    return total if unattributed is None else total + F.coalesce(unattributed, F.lit(0))


def effective() -> Column:
    """Cache reads count a tenth."""
    return F.col("tok_in") + F.col("cache_w") + F.col("tok_out") + F.col("cache_r") / 10


def cost(unattributed: Column | None = None) -> Column:
    """US dollars by the rates of the row (a million tokens each); null where a used bucket has no rate or tokens are unattributed."""
    hour = F.least(F.greatest(F.col("cache_w1h"), F.lit(0)), F.col("cache_w"))
    buckets = [
        (F.col("tok_in"), F.col("input")), (F.col("tok_out"), F.col("output")), (F.col("cache_r"), F.col("cache_read")),
        (F.col("cache_w") - hour, F.col("cache_write")), (hour, F.coalesce("cache_write_1h", "cache_write")),
    ]
    total = sum((F.when(n > 0, n * rate / 1e6).otherwise(0.0) for n, rate in buckets), F.lit(0.0))
    return total if unattributed is None else F.when(F.coalesce(unattributed, F.lit(0)) == 0, total)


def heat_level(value: Column, quartiles: Column) -> Column:
    """0 for none, else 1 to 4 by the quartiles of the days that have any."""
    return F.when(value <= 0, 0).when(value <= quartiles[0], 1).when(value <= quartiles[1], 2).when(value <= quartiles[2], 3).otherwise(4)


def severity(used_percent: Column) -> Column:
    return F.when(used_percent.isNull(), "unread").when(used_percent >= 100, "exhausted").when(used_percent >= 90, "critical").when(used_percent >= 75, "warning").otherwise("ok")


def compact(n: Column) -> Column:
    """A count as 950, 12.3K, 150K, 4.5M: one digit below a hundred units, none where it is zero; 0 for none."""
    text = F.floor(n + 0.5).cast("string")
    for size, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        tenths = F.floor(n * 10 / size + 0.5).cast("bigint")
        whole = F.floor(tenths / 10).cast("string")
        fine = F.when(tenths % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), (tenths % 10).cast("string")))
        label = F.when(n / size < 100, fine).otherwise(F.floor(n / size + 0.5).cast("string"))
        text = F.when(n >= size * 0.9995, F.concat(label, F.lit(mark))).otherwise(text)
    return F.when(F.coalesce(n > 0, F.lit(False)), text).otherwise("0")


def window_of_minutes(minutes: Column) -> Column:
    """Up to half a day a session, from a day on a week, else the minutes."""
    return F.when(minutes <= 720, "session").when(minutes >= 1440, "week").otherwise(F.concat(minutes.cast("string"), F.lit("m")))
