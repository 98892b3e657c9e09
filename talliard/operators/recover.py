"""Keeping what an older rollup held: history whose logs are gone is not lost when a rollup is built anew."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["date", "provider", "source", "model", "acct", "q"]
#: Counters of a cell; those that the account ledger sums.
COUNTERS = ["tok_in", "cache_w", "cache_w1h", "cache_r", "tok_out", "reasoning", "events", "prompts", "prompts_no_usage", "model_prompts"]
LEDGER = ["tok_in", "cache_w", "cache_r", "tok_out"]


def compared(old: DataFrame, new: DataFrame, one_source: dict[str, str] | None = None, moved: DataFrame | None = None) -> DataFrame:
    """(cell, o_ and n_ counters, _old): old's and new's cells side by side. moved: cells of new that old held under another source."""
    now = new.select(*CELL, *COUNTERS)
    if moved is not None:
        target = F.lit(None).cast("string")
        for k, v in (one_source or {}).items():
            target = F.when(F.col("source") == k, v).otherwise(target)
        away = moved.select(*CELL, *((-F.col(c)).alias(c) for c in COUNTERS))
        there = moved.withColumn("source", F.coalesce(target, "source")).select(*CELL, *COUNTERS)
        now = now.unionByName(away).unionByName(there)
    both = old.select(*CELL, *(F.col(c).alias(f"o_{c}") for c in COUNTERS), *(F.lit(0).alias(f"n_{c}") for c in COUNTERS), F.lit(1).alias("_old"))
    both = both.unionByName(now.select(*CELL, *(F.lit(0).alias(f"o_{c}") for c in COUNTERS), *(F.col(c).alias(f"n_{c}") for c in COUNTERS), F.lit(0).alias("_old")))
    return both.groupBy(*CELL).agg(*(F.sum(f"{v}_{c}").alias(f"{v}_{c}") for v in "on" for c in COUNTERS), F.max("_old").alias("_old"))


def with_gifts(cells: DataFrame, one_source: dict[str, str] | None = None) -> DataFrame:
    """Cells as of compared(), with g_ counters: what each of old's cells gets of what new lacks."""
    source = F.col("source")
    for k, v in (one_source or {}).items():
        source = F.when((F.col("provider") == "anthropic") & (F.col("source") == k), v).otherwise(source)
    whole = Window.partitionBy("date", "provider", "_level", "model")
    # only cells that old has get something; a counter's surpluses in the order of the cells' names
    before = whole.orderBy(F.desc("_old"), F.concat_ws("|", "provider", "source", "model", "acct", "q")).rowsBetween(Window.unboundedPreceding, -1)
    surplus = {c: F.when(F.col("_old") == 1, F.greatest(F.lit(0), F.col(f"o_{c}") - F.col(f"n_{c}"))).otherwise(0) for c in COUNTERS}
    gap = {c: F.sum(f"o_{c}").over(whole) - F.sum(f"n_{c}").over(whole) for c in COUNTERS}
    cells = cells.withColumn("_level", source).withColumns({f"s_{c}": surplus[c] for c in COUNTERS}).withColumns({f"_g_{c}": gap[c] for c in COUNTERS})
    left = {c: F.greatest(F.lit(0), F.col(f"_g_{c}") - F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0))) for c in COUNTERS}
    return cells.withColumns({f"g_{c}": F.least(F.col(f"s_{c}"), left[c]).cast("long") for c in COUNTERS})


def gifts(cells: DataFrame) -> DataFrame:
    """(cell, counters) of what with_gifts() gives."""
    return cells.select(*CELL, *(F.col(f"g_{c}").alias(c) for c in COUNTERS)).where(" or ".join(f"{c} > 0" for c in COUNTERS))


def given_back(old: DataFrame, new: DataFrame, one_source: dict[str, str] | None = None, moved: DataFrame | None = None) -> DataFrame:
    """(cell, counters): what of old's cells new lacks.

    Old and new are compared by date, provider, source and model, counter by counter, so that history read again under another
    account or quality counts once. Where old held more, the gap goes to its cells that hold more than their namesakes
    in new, in the order of their names, up to that surplus: a cell's part follows from the sum of the surpluses before it.

    one_source: sources of anthropic that count as another one here. moved: cells of new that old held under that other source.
    """
    return gifts(with_gifts(compared(old, new, one_source, moved), one_source))


def filled(cells: DataFrame) -> DataFrame:
    """salvaged() from cells of with_gifts() that say by _new whether new has them, and where nothing moved: no join."""
    some = " or ".join(["_new = 1", *(f"g_{c} > 0" for c in COUNTERS)])
    return cells.where(some).select(*CELL, *((F.col(f"n_{c}") + F.col(f"g_{c}")).cast("long").alias(c) for c in COUNTERS))


def salvaged(old: DataFrame, new: DataFrame, given: DataFrame) -> DataFrame:
    """The cells of new with what was given back. No counter is below new's, and by date, provider, source and model none below old's."""
    return new.select(*CELL, *COUNTERS).unionByName(given).groupBy(*CELL).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTERS))


def unledgered(given: DataFrame) -> DataFrame:
    """(date, provider, source) whose account totals lack something, as what was given back has no UTC day."""
    return given.where(" or ".join(f"{c} > 0" for c in LEDGER)).select("date", "provider", "source").distinct()


def ids_kept(old_ids: DataFrame, given: DataFrame) -> DataFrame:
    """(day, id) that count as seen from now on: those old had on the dates where something was given back, under each day around the date."""
    dates = given.select("date").distinct()
    held = old_ids.join(dates, "date").select(F.to_date("date").alias("d"), "id")
    return held.select(F.explode(F.array(F.date_sub("d", 1), F.col("d"), F.date_add("d", 1))).alias("day"), "id").distinct()
