"""Typed events from the driver's star schema: usage, activity, prompts, account totals and quota readings.

The tables hold no token events, so these views derive them by fixed expressions; the SQL of the oracle states the same.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.functions import ids
from talliard.tables import table

PROVIDERS = ["anthropic", "openai", "xai", "cursor", "google"]
SOURCES = ["claude-code", "codex", "grok-cli", "cursor", "gemini-cli"]


def _nth(values: list[str], n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def usage_events(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Sightings of usage events; the same id comes several times. placed: with l_orderkey, which an id determines and by which they are dealt.

    Customers come to orders first, so that lines are shuffled once, by their order, and before they are widened.
    """
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    order = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "n_name")
    rows = line.join(order, line.l_orderkey == order.o_orderkey)
    provider, source = _nth(PROVIDERS, F.col("l_suppkey") % 5), _nth(SOURCES, F.col("l_suppkey") % 5)
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), (F.col("l_partkey") % 2).cast("string"))
    padded = [F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("l_orderkey", 12), ("l_linenumber", 3), ("l_partkey", 12), ("l_suppkey", 12))]
    return rows.select(
        *(["l_orderkey"] if placed else []), ids.event_id("usage", provider, source, key).alias("id"), provider.alias("provider"), source.alias("source"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.when(F.col("l_linenumber") % 5 == 0, "session-start").otherwise("event").alias("ts_q"),
        ((F.col("l_orderkey") % 3 - 1) * 480).cast("long").alias("tz_offset_min"),
        F.when(F.col("l_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("model-"), (F.col("l_partkey") % 7).cast("string"))).alias("model"),
        F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.concat(F.lit("a_"), (F.col("o_custkey") % 9).cast("string"))).alias("acct"),
        _nth(["unknown", "recorded", "timeline", "inferred"], F.col("l_linenumber") % 4).alias("acct_q"),
        F.when(F.col("l_returnflag") == "R", "estimated").otherwise("exact").alias("q"),
        (1 + F.col("l_partkey") % 3).cast("long").alias("pv"),
        ids.session_key(provider, F.concat(F.lit("sess-"), (F.col("o_custkey") % 50).cast("string"))).alias("session"),
        F.col("l_quantity").cast("long").alias("tok_in"), (F.col("l_linenumber") * 10).cast("long").alias("cache_w"),
        (F.col("l_linenumber") * 4).cast("long").alias("cache_w1h"), F.floor("l_extendedprice").cast("long").alias("cache_r"),
        (F.col("l_quantity") * 2).cast("long").alias("tok_out"), F.col("l_quantity").cast("long").alias("reasoning"), F.lit(1).cast("long").alias("calls"),
        F.concat(F.lit("m_"), (F.col("o_custkey") % 4).cast("string")).alias("machine"),
        F.when(F.col("o_custkey") % 4 == 3, "").otherwise(F.col("n_name")).alias("cc"),
        F.concat(F.lit("w_"), (F.col("o_custkey") % 6).cast("string")).alias("ws"),
        F.concat(*padded, F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string")).alias("seq"),
    )


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of prompts without their text, from events."""
    e, user = table(spark, sf_dir, "events"), F.col("user_id")
    provider, source = _nth(PROVIDERS, user % 5), _nth(SOURCES, user % 5)
    return e.select(
        ids.event_id("activity", provider, source, F.floor(F.col("event_id") / 2).cast("string")).alias("id"), provider.alias("provider"), source.alias("source"),
        F.col("ts").cast("timestamp").alias("ts"), ((user % 3 - 1) * 480).cast("long").alias("tz_offset_min"),
        F.when(user % 4 == 0, "").otherwise(F.concat(F.lit("a_"), (user % 9).cast("string"))).alias("acct"),
        _nth(["unknown", "recorded", "timeline", "inferred"], user % 4).alias("acct_q"),
        ids.session_key(provider, F.concat(F.lit("sess-"), (user % 50).cast("string"))).alias("session"),
        F.concat(F.lit("w_"), (user % 6).cast("string")).alias("ws"), (F.col("event_type") != "error").alias("has_usage"),
        F.concat(F.lit("m_"), (user % 4).cast("string")).alias("machine"), F.lit("").alias("cc"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("seq"),
    )


def prompt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with their text, from what users say in conversations."""
    c, conv = table(spark, sf_dir, "conversations").where("role = 'user'"), F.col("conv_id")
    provider, source = _nth(PROVIDERS, conv % 5), _nth(SOURCES, conv % 5)
    return c.select(
        ids.event_id("prompt", provider, source, F.concat(conv.cast("string"), F.lit(":"), F.col("turn").cast("string"))).alias("id"), provider.alias("provider"), source.alias("source"),
        F.timestamp_seconds(F.lit(1_750_000_000) + conv * 3600 + F.col("turn") * 60).alias("ts"), ((conv % 3 - 1) * 480).cast("long").alias("tz_offset_min"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("model-"), (conv % 7).cast("string"))).alias("model"),
        F.concat(F.lit("a_"), (conv % 9).cast("string")).alias("acct"), _nth(["inferred", "recorded", "timeline", "bounded"], conv % 4).alias("acct_q"), F.concat(F.lit("name "), (conv % 9).cast("string")).alias("label"),
        F.concat(F.lit("m_"), (conv % 4).cast("string")).alias("machine"),
        F.concat(F.lit("/home/u/project-"), (conv % 6).cast("string")).alias("workspace"),
        ids.session_key(provider, conv.cast("string")).alias("session"), "text", F.concat(F.lpad(conv.cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("seq"),
    )
