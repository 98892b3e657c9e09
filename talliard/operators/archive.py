"""The prompt archive: predicates, pages, counts and facets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliard.operators.validate import PROVIDER_OF

MOST_ROWS = 2000


def search(prompts: DataFrame, text: str = "", label: str = "", **exact: str) -> DataFrame:
    """Equal columns, and substrings whatever their case."""
    for column, value in exact.items():
        prompts = prompts.where(F.col(column) == value)
    if text:
        prompts = prompts.where(F.contains(F.lower("text"), F.lit(text.lower())))
    return prompts.where(F.contains(F.lower("workspace"), F.lit(label.lower()))) if label else prompts


def page(prompts: DataFrame, limit: int = 500, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """The next limit prompts (1 to 2000) by (ts, id) behind a cursor (ts, id[, order]), which holds for its own order only."""
    if after and len(after) > 2 and after[2] != ("desc" if descending else "asc"):
        raise ValueError("the cursor is of another order")
    order = [F.desc("ts"), F.desc("id")] if descending else [F.asc("ts"), F.asc("id")]
    if after:
        at = F.struct(F.lit(after[0]).cast("timestamp").alias("ts"), F.lit(after[1]).alias("id"))
        prompts = prompts.where(F.struct("ts", "id") < at if descending else F.struct("ts", "id") > at)
    return prompts.orderBy(*order).limit(min(max(limit, 1), MOST_ROWS))


def facets(prompts: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of all columns in one pass; empty values do not count."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return prompts.select(F.explode(pairs).alias("p")).select("p.*").where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def machine_names(machines: DataFrame) -> DataFrame:
    """(value, machine_id): what an archived prompt may call a machine, its id or a label that one machine alone has; ids go first."""
    ids = machines.select(F.col("id").alias("value"), F.col("id").alias("machine_id"))
    labels = machines.where("label <> ''").groupBy(F.col("label").alias("value")).agg(F.min("id").alias("machine_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    return ids.unionByName(labels.join(ids.select("value"), "value", "left_anti"))


def counts(prompts: DataFrame, machines: DataFrame, source: str = "") -> DataFrame:
    """(date, provider, machine, model, n, complete): complete says of a day and provider that every prompt has a known machine."""
    if source and source not in PROVIDER_OF:
        raise ValueError(f"unknown source: {source}")
    rows = (prompts.where(F.col("source") == source) if source else prompts).withColumnRenamed("machine", "value").join(machine_names(machines), "value", "left")
    named = rows.select("date", "provider", F.coalesce("machine_id", F.lit("unknown")).alias("machine"), F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")).alias("model"))
    sums = named.groupBy("date", "provider", "machine", "model").agg(F.count("*").alias("n"))
    return sums.withColumn("complete", F.min(F.col("machine") != "unknown").over(Window.partitionBy("date", "provider")))


def overlay(days: DataFrame, counted: DataFrame, machine: str = "all") -> DataFrame:
    """days (date, provider) with model and n of the archive; for one machine known is false where some prompts have no machine."""
    own = counted if machine == "all" else counted.where(~F.col("complete") | (F.col("machine") == machine))
    known = F.lit(True) if machine == "all" else F.col("complete")
    own = own.groupBy("date", "provider", F.when(known, F.col("model")).alias("model"), known.alias("known")).agg(F.sum("n").alias("n"))
    own = own.withColumn("n", F.when(F.col("known"), F.col("n")))
    return days.select("date", "provider").distinct().join(own, ["date", "provider"], "left").withColumn("known", F.coalesce("known", F.lit(True)))


def without_accounts(prompts: DataFrame, excluded: DataFrame) -> DataFrame:
    """Prompts but those of accounts (provider, acct) that are not to be captured."""
    return prompts.join(excluded.select("provider", "acct").distinct(), ["provider", "acct"], "left_anti")


def item(prompts: DataFrame, id: str, month: str = "") -> DataFrame:
    """One prompt, in a month if that is known, so that only its partition is read."""
    found = prompts.where(F.col("id") == id)
    return found.where(F.date_format("ts", "yyyy-MM") == month) if month else found


def months(*rows: DataFrame) -> DataFrame:
    """The months in which any of the tables has a row."""
    found = [df.select(F.date_format("ts", "yyyy-MM").alias("month")).distinct() for df in rows]
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out.distinct()
