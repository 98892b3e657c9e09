"""Merging sightings of the same event by id; no result depends on the order of rows, but first sightings go by seq.

All of an id's sightings meet in one shuffle, or in none where they are already dealt by what an id determines.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talliard.functions.ids import local_date

# Qualities of an account by rank.
RANK = {"recorded": 6, "session": 5, "timeline": 4, "bounded": 3, "lineage": 2, "inferred": 1}
MEASURES = ["tok_in", "cache_w", "cache_w1h", "cache_r", "tok_out", "reasoning", "calls"]


def acct_rank(quality: Column | str = "acct_q") -> Column:
    quality, found = F.col(quality) if isinstance(quality, str) else quality, F.lit(0)
    for name, rank in RANK.items():
        found = F.when(quality == name, rank).otherwise(found)
    return found


def best_account(where: Column | None = None) -> Column:
    """The account of the highest rank, ties to the smaller hash, as a struct of rank and acct; null without any."""
    has = F.coalesce(F.col("acct"), F.lit("")) != ""
    return F.min(F.when(has if where is None else has & where, F.struct((-acct_rank()).alias("r"), "acct", "acct_q")))


def least_filled(column: str) -> Column:
    return F.min(F.nullif(F.col(column), F.lit("")))


def first_seen(value: Column, where: Column) -> Column:
    return F.min(F.when(where, F.struct("seq", value.alias("v"))))["v"]


def channel() -> Column:
    """How good the evidence of a chat's client is; the better one brings its reporter along."""
    return F.when(F.col("source") == "web-claude", 2).when(F.col("source") == "native-claude", 1).otherwise(0)


def reporter() -> Column:
    """machine and cc together: of the best channel's first sighting that has a machine."""
    return F.min(F.when(F.col("machine") != "", F.struct((-channel()).alias("r"), "seq", "machine", "cc")))


def merge_usage(sightings: DataFrame, combine: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """One row an id: the highest parser version's measures, the best account, and the first sighting's reporter and day.

    Whatever only counts in the highest version is an extreme of (version, value), so one grouping does it. Rows are dealt by id
    first, and sorted once; combine groups them in their own tasks before, for sources that send the same ids many times over.
    within names columns that an id determines: where the sightings are dealt by them, as after a join, they are not shuffled again.
    """
    rows = sightings if combine or within else sightings.repartition("id")
    newest_first = (-F.col("pv")).alias("p")
    time_rank = F.when(F.col("ts_q") == "event", 2).when(F.col("ts_q") == "session-start", 1).otherwise(0)
    ws = F.nullif("ws", F.lit(""))
    merged = rows.groupBy(*within, "id").agg(
        F.min("provider").alias("provider"), F.min(F.struct(newest_first, (-channel()).alias("r"), "seq", "source")).alias("_s"), F.max("pv").alias("pv"),
        *(F.max(F.struct("pv", m)).alias(m) for m in MEASURES),
        F.min(F.struct(newest_first, (-time_rank).alias("r"), "ts", "ts_q")).alias("_t"), F.min(F.struct(newest_first, (F.col("q") != "exact").alias("q"))).alias("_q"),
        best_account().alias("_a"), F.coalesce(least_filled("model"), F.lit("")).alias("model"), F.coalesce(least_filled("session"), F.lit("")).alias("session"),
        F.min(F.struct(newest_first, ws.isNull().alias("n"), ws.alias("ws"))).alias("_w"), least_filled("ws").alias("_any_ws"), reporter().alias("_m"),
        F.min(F.struct(newest_first, "seq", "tz_offset_min")).alias("_z"), F.min(F.struct("seq", local_date(F.col("ts"), F.col("tz_offset_min")).alias("date"))).alias("_d"),
    )
    return merged.select(
        "id", "provider", F.col("_s.source").alias("source"), "pv", *(F.col(f"{m}.{m}").alias(m) for m in MEASURES), F.col("_t.ts").alias("ts"), F.col("_t.ts_q").alias("ts_q"),
        F.when(F.col("_q.q"), "estimated").otherwise("exact").alias("q"), F.coalesce("_a.acct", F.lit("")).alias("acct"), F.coalesce("_a.acct_q", F.lit("unknown")).alias("acct_q"), "model", "session",
        F.coalesce("_w.ws", "_any_ws", F.lit("")).alias("ws"), F.coalesce("_m.machine", F.lit("")).alias("machine"), F.coalesce("_m.cc", F.lit("")).alias("cc"),
        F.col("_z.tz_offset_min").alias("tz_offset_min"), F.col("_d.date").alias("date"),
    )


def merge_activity(sightings: DataFrame) -> DataFrame:
    merged = sightings.groupBy("id").agg(
        F.min("provider").alias("provider"), F.min(F.struct((-channel()).alias("r"), "seq", "source")).alias("_s"), F.min("ts").alias("ts"), F.bool_or("has_usage").alias("has_usage"),
        best_account().alias("_a"), F.coalesce(least_filled("session"), F.lit("")).alias("session"), F.coalesce(least_filled("ws"), F.lit("")).alias("ws"),
        reporter().alias("_m"), first_seen(local_date(F.col("ts"), F.col("tz_offset_min")), F.lit(True)).alias("date"),
    )
    return merged.select(
        "id", "provider", F.col("_s.source").alias("source"), "ts", "has_usage", F.coalesce("_a.acct", F.lit("")).alias("acct"), F.coalesce("_a.acct_q", F.lit("unknown")).alias("acct_q"),
        "session", "ws", F.coalesce("_m.machine", F.lit("")).alias("machine"), F.coalesce("_m.cc", F.lit("")).alias("cc"), "date",
    )


def merge_prompts(sightings: DataFrame) -> DataFrame:
    """The first sighting's text, place and session; the first model that is filled; account and label of the highest quality, the earlier one among equals."""
    first = F.min_by(F.struct("provider", "source", "ts", "tz_offset_min", "workspace", "machine", "session", "text"), "seq")
    rank = F.when(F.coalesce(F.col("acct"), F.lit("")) == "", 0).otherwise(acct_rank())
    owner = F.min(F.struct((-rank).alias("r"), "seq", "acct", "acct_q", "label"))
    merged = sightings.groupBy("id").agg(first.alias("f"), first_seen(F.col("model"), F.col("model") != "").alias("model"), owner.alias("o"), F.min(F.struct((-channel()).alias("r"), "seq", "source")).alias("s"))
    return merged.select("id", "f.provider", "s.source", "f.ts", "f.tz_offset_min", "f.workspace", "f.machine", "f.session", "f.text", "o.acct", "o.acct_q", "o.label", F.coalesce("model", F.lit("")).alias("model"))


def newest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key the row that is last by order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def widen_spans(records: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence with the same key as one record, from the first to the last time seen."""
    return records.groupBy(*keys).agg(F.min("ts").alias("ts"), F.max(F.greatest("ts", F.coalesce("to_ts", "ts"))).alias("to_ts"))


def changed(incoming: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose fields differ from what is stored; an unchanged row needs no write."""
    fields = sorted(c for c in incoming.columns if c != key)
    digest = lambda df: df.withColumn("_digest", F.xxhash64(*(F.col(c) for c in fields)))
    return digest(incoming).join(digest(stored).select(key, "_digest"), [key, "_digest"], "left_anti").select(*incoming.columns)
