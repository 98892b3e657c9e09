"""Shares of account history among machines, by what each did on days nearby."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RADIUS = 7


def shares_by_radius(history: DataFrame, activity: DataFrame) -> DataFrame:
    """(provider, date, machine, radius, weight): the smallest radius with any activity decides.

    history: provider, date, amount. activity: provider, date, machine, weight. Radius 0 is the day, 1 its two neighbours,
    from 2 on the whole window. Only dates within the radius meet, by an exploded list of dates.
    """
    near = history.select("provider", "date", F.explode(F.sequence(F.lit(-RADIUS), F.lit(RADIUS))).alias("off"))
    near = near.withColumn("other", F.date_format(F.expr("date_add(to_date(date), off)"), "yyyy-MM-dd"))
    met = near.join(activity.withColumnRenamed("date", "other"), ["provider", "other"]).where("weight > 0")
    best = met.groupBy("provider", "date").agg(F.min(F.abs("off")).alias("radius"))
    used = met.join(best, ["provider", "date"]).where("(radius < 2 and abs(off) = radius) or (radius >= 2 and abs(off) <= radius)")
    return used.groupBy("provider", "date", "machine", "radius").agg(F.sum("weight").cast("long").alias("weight"))


def rates(activity: DataFrame) -> DataFrame:
    """activity (provider, date, machine, tokens, logged) with tokens a logged prompt within a week: of the machine, else the fleet, else ever, else 1.

    The fleet's windows go over one row a provider and day, not over its machines' rows.
    """
    day = activity.withColumn("n", F.datediff(F.to_date("date"), F.lit("1970-01-01")))
    ok = (F.col("tokens") > 0) & (F.col("logged") > 0)
    day = day.withColumn("_t", F.when(ok, F.col("tokens"))).withColumn("_l", F.when(ok, F.col("logged")))
    ratio = lambda w: F.try_divide(F.sum("_t").over(w), F.sum("_l").over(w))
    week = lambda *keys: Window.partitionBy(*keys).orderBy("n").rangeBetween(-RADIUS, RADIUS)
    fleet = day.groupBy("provider", "n").agg(F.sum("_t").alias("_t"), F.sum("_l").alias("_l"))
    fleet = fleet.select("provider", "n", F.coalesce(ratio(week("provider")), ratio(Window.partitionBy("provider")), F.lit(1.0)).alias("_fleet"))
    own = day.withColumn("_own", ratio(week("provider", "machine"))).drop("_t", "_l")
    return own.join(fleet, ["provider", "n"]).withColumn("rate", F.coalesce("_own", "_fleet")).drop("n", "_own", "_fleet")


def unlogged(places: DataFrame, budget: DataFrame) -> DataFrame:
    """places (provider, date, machine, tokens, prompts) with unlogged: prompts without recorded tokens, of which budget (provider, date, missing) knows the sum.

    They are the one prompting machine's, else those machines' that prompted without any tokens, in proportion; at most their prompts.
    """
    day = Window.partitionBy("provider", "date")
    prompting = (F.col("machine") != "unknown") & (F.col("prompts") > 0)
    rows = places.join(budget, ["provider", "date"], "left").withColumn("_n", F.count_if(prompting).over(day))
    silent = prompting & (F.col("tokens") <= 0)
    rows = rows.withColumn("_silent", F.sum(F.when(silent, F.col("prompts"))).over(day))
    sole = F.least("missing", "prompts").cast("double")
    part = F.when(prompting & (F.col("_n") == 1), sole).when(silent & (F.col("_n") > 1), F.col("prompts") * F.least(F.lit(1.0), F.col("missing") / F.col("_silent")))
    return rows.withColumn("unlogged", F.coalesce(F.when(F.col("missing") > 0, part), F.lit(0.0))).drop("missing", "_n", "_silent")


def attribution(history: DataFrame, activity: DataFrame) -> DataFrame:
    """(provider, date, machine, rule, weight): what share of a day's account history (provider, date, amount) goes to which machine.

    activity: provider, date, machine, tokens, prompts, unlogged. Prompts without records explain the amount first, up to the tokens they
    most probably used; the rest goes by recorded tokens: of the same day, the adjacent ones, the nearest within a week, else all to the
    machine with the most tokens ever. Only a provider that no machine used gets nothing.
    """
    seen = activity.where((F.col("machine") != "unknown") & ((F.col("tokens") > 0) | (F.col("prompts") > 0)))
    seen = rates(seen.withColumn("unlogged", F.least("prompts", "unlogged")).withColumn("logged", F.col("prompts") - F.col("unlogged")))
    seen = seen.withColumn("expected", F.greatest(F.lit(0.0), F.col("unlogged") * F.col("rate"))).withColumn("recorded", F.greatest(F.lit(0), F.col("tokens")))
    near = history.select("provider", "date", "amount", F.explode(F.sequence(F.lit(-RADIUS), F.lit(RADIUS))).alias("off"))
    near = near.withColumn("other", F.date_format(F.expr("date_add(to_date(date), off)"), "yyyy-MM-dd"))
    met = near.join(seen.select("provider", F.col("date").alias("other"), "machine", "recorded", "expected"), ["provider", "other"]).where("recorded > 0 or expected > 0")
    best = met.groupBy("provider", "date").agg(F.min(F.abs("off")).alias("radius"))
    used = met.join(best, ["provider", "date"]).where("(radius < 2 and abs(off) = radius) or (radius >= 2 and abs(off) <= radius)")
    sums = used.groupBy("provider", "date", "amount", "radius", "machine").agg(F.sum("recorded").alias("t"), F.sum("expected").alias("e"))
    day = Window.partitionBy("provider", "date")
    sums = sums.withColumn("ts", F.sum("t").over(day)).withColumn("es", F.sum("e").over(day)).withColumn("first", F.least("amount", "es"))
    both = F.col("first") * F.col("e") / F.col("es") + (F.col("amount") - F.col("first")) * F.col("t") / F.col("ts")
    weight = F.when(F.col("es") <= 0, F.col("t").cast("double")).when(F.col("ts") <= 0, F.col("e")).otherwise(both)
    rule = F.when(F.col("radius") == 0, "same-day").when(F.col("radius") == 1, "adjacent-day").otherwise("nearest")
    placed = sums.select("provider", "date", "machine", rule.alias("rule"), weight.alias("weight")).where("weight > 0")
    ever = seen.groupBy("provider", "machine").agg(F.sum("tokens").alias("t"), F.sum("prompts").alias("p"))
    top = ever.groupBy("provider").agg(F.min_by("machine", F.struct(-F.col("t"), -F.col("p"), "machine")).alias("machine"))
    left = history.join(best, ["provider", "date"], "left_anti").join(top, "provider").select("provider", "date", "machine", F.lit("most-used").alias("rule"), F.lit(1.0).alias("weight"))
    return placed.unionByName(left)


def split(amounts: DataFrame, keys: list[str], place: str, shares: DataFrame) -> DataFrame:
    """(keys, place, assigned): each amount in whole tokens by weight, the largest remainders rounded up, ties by place; nothing is lost."""
    group = Window.partitionBy(*keys)
    rows = amounts.where("amount > 0").join(shares, [c for c in keys if c in shares.columns]).withColumn("_exact", F.col("amount") * (F.col("weight") / F.sum("weight").over(group)))
    rows = rows.withColumn("_floor", F.floor("_exact").cast("long")).withColumn("_left", F.col("amount") - F.sum("_floor").over(group))
    rows = rows.withColumn("_k", F.row_number().over(group.orderBy(F.desc(F.col("_exact") - F.col("_floor")), place)))
    return rows.select(*keys, place, (F.col("_floor") + (F.col("_k") <= F.col("_left")).cast("long")).cast("long").alias("assigned")).where("assigned > 0")


def moves(history: DataFrame, activity: DataFrame, countries: DataFrame) -> DataFrame:
    """(provider, date, kind, place, assigned): account history leaves machine unknown and country ZZ for where it most probably was.

    history: provider, date, amount, zz (what of it is under ZZ). countries: machine, cc. Sums of a day and provider stay as they are.
    """
    to = split(history, ["provider", "date"], "machine", attribution(history, activity))
    known = countries.select("machine", F.when(F.upper("cc").rlike("^[A-Z]{2}$"), F.upper("cc")).alias("cc"))
    by_cc = to.join(known, "machine", "left").groupBy("provider", "date", F.coalesce("cc", F.lit("ZZ")).alias("cc")).agg(F.sum("assigned").cast("double").alias("weight"))
    regions = split(history.select("provider", "date", F.least("amount", "zz").alias("amount")), ["provider", "date"], "cc", by_cc)
    rows = lambda df, kind, column, none: df.select("provider", "date", F.lit(kind).alias("kind"), F.col(column).alias("place"), "assigned").unionByName(
        df.groupBy("provider", "date").agg((-F.sum("assigned")).alias("assigned")).select("provider", "date", F.lit(kind).alias("kind"), F.lit(none).alias("place"), "assigned"))
    out = rows(to, "machine", "machine", "unknown").unionByName(rows(regions, "country", "cc", "ZZ"))
    return out.groupBy("provider", "date", "kind", "place").agg(F.sum("assigned").cast("long").alias("assigned"))


def with_assigned(days: DataFrame, moved: DataFrame, machine: str) -> DataFrame:
    """One machine's own days (provider, date, tokens) with the history assigned to it, also on days it has none of."""
    own = days.select("provider", "date", "tokens", F.lit(0).cast("long").alias("assigned"))
    more = moved.where((F.col("kind") == "machine") & (F.col("place") == machine)).select("provider", "date", F.lit(0).cast("long").alias("tokens"), "assigned")
    return own.unionByName(more).groupBy("provider", "date").agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("assigned").cast("long").alias("assigned"))
