"""Days of events that stay open for late sightings until they are sealed: versions by batch, an index from id to day, and a seal that only rises.

A table is a folder of versions. Each batch writes what it changed below its own number, and at last a manifest: the seal, and for each open
day and each bucket of the index the batch that wrote its newest version. Nothing is overwritten, so a reader sees the last
whole batch, and a batch that failed half-way, or comes again, starts from the same state and writes the same. A table belongs to one stream.

Sightings are kept by their id's home, the day of the sighting that came first, as they are; merged rows follow from all of an id's
sightings, so their order among batches doesn't matter. Each batch reads the index buckets of its ids and its homes' days,
whose size follows the open days, not the history: what lies before the seal leaves a bucket when it is next asked for, and its
days are never read again.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from talliard.functions.ids import local_date
from talliard.operators.merge import merge_usage

#: Days that stay open behind the newest event, and buckets of the index.
OPEN_DAYS, BUCKETS = 7, 64


class State(NamedTuple):
    """What a manifest says: its batch, the seal (a date), and the batch that wrote each day's and each bucket's newest version."""

    batch: int
    seal: str
    days: dict[str, int]
    buckets: dict[int, int]


NONE = State(-1, "", {}, {})
_MANIFEST = "kind string, name string, version long"


def _state(spark: SparkSession, path: str, batch: int) -> State | None:
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/batch={batch}").collect()  # a row for each open day and bucket
    except AnalysisException:
        return None
    of = lambda kind: {r.name: r.version for r in rows if r.kind == kind}
    return State(batch, next(iter(of("seal"))), of("day"), {int(k): v for k, v in of("bucket").items()}) if rows else None


def state(spark: SparkSession, path: str, before: int | None = None) -> State:
    """The last whole batch's, or the last one's before a batch."""
    if before is not None and (found := _state(spark, path, before - 1)):
        return found
    try:
        known = spark.read.schema(f"{_MANIFEST}, batch long").parquet(f"{path}/manifest").select("batch").distinct()
    except AnalysisException:
        return NONE
    last = (known if before is None else known.where(F.col("batch") < before)).agg(F.max("batch")).first()[0]
    return NONE if last is None else _state(spark, path, last) or NONE


def _versions(spark: SparkSession, path: str, folder: str, names: dict, schema) -> DataFrame | None:
    """The newest versions of some days or buckets."""
    if not names:
        return None
    key = {"sightings": "home", "merged": "home", "index": "bucket"}[folder]
    paths = [f"{path}/{folder}/batch={v}/{key}={n}" for n, v in names.items()]
    read = spark.read.schema(schema) if schema else spark.read
    return read.parquet(*paths)


def _written(df: DataFrame, path: str, folder: str, key: str, batch: int) -> None:
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(f"{path}/{folder}/batch={batch}")


def upsert(sightings: DataFrame, path: str, batch: int) -> tuple[list[str], int]:
    """Takes a batch of sightings into the table; returns the dates whose merged rows may have changed, and how many sightings came behind the seal."""
    spark = sightings.sparkSession
    new = sightings.withColumn("_date", local_date(F.col("ts"), F.col("tz_offset_min"))).withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")).persist()
    try:
        old = state(spark, path, batch)
        newest, buckets, total = new.agg(F.max("_date"), F.collect_set("_bucket"), F.count("*")).first()  # at most BUCKETS numbers
        if not total:
            _commit(spark, path, State(batch, old.seal, old.days, old.buckets))
            return [], 0
        seal = max(old.seal, spark.sql(f"select date_format(date_sub('{newest}', {OPEN_DAYS}), 'yyyy-MM-dd') as d").first().d)
        index = _versions(spark, path, "index", {b: old.buckets[b] for b in buckets if b in old.buckets}, "id string, home string")
        known = index.where(F.col("home") >= old.seal) if index is not None else spark.createDataFrame([], "id string, home string")
        first = new.groupBy("id").agg(F.min_by("_date", F.struct("seq", "_date")).alias("_first"))
        homed = new.join(first, "id").join(known, "id", "left")
        # an id whose home is open stays there; a new one is taken unless its day is sealed
        homed = homed.withColumn("home", F.coalesce("home", F.when(F.col("_first") >= old.seal, F.col("_first"))))
        taken = homed.where("home is not null").select(*sightings.columns, "home").persist()
        try:
            homes, n_taken = taken.agg(F.collect_set("home"), F.count("*")).first()  # the open days
            stored = _versions(spark, path, "sightings", {h: old.days[h] for h in homes if h in old.days}, None)
            whole = taken
            if stored is not None:
                at = F.regexp_extract(F.col("_metadata.file_path"), r"/home=([^/]*)/", 1)
                whole = stored.withColumn("home", at).select(*taken.columns).unionByName(taken)
            whole = whole.distinct()  # a batch's sightings may have come before
            _written(whole, path, "sightings", "home", batch)
            now = spark.read.schema(whole.schema).parquet(f"{path}/sightings/batch={batch}")
            merged = merge_usage(now.drop("home")).join(now.select("id", "home").distinct(), "id")
            before = _versions(spark, path, "merged", {h: old.days[h] for h in homes if h in old.days}, None)
            _written(merged, path, "merged", "home", batch)
            changed = spark.read.schema(merged.schema).parquet(f"{path}/merged/batch={batch}").select("date")
            dates = sorted(r.date for r in (changed if before is None else changed.union(before.select("date"))).distinct().collect())  # days
            # buckets are rewritten whole, without what is sealed by now
            more = taken.select("id", "home").distinct().join(known.select("id"), "id", "left_anti") if index is not None else taken.select("id", "home").distinct()
            kept = known.unionByName(more).where(F.col("home") >= seal).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
            _written(kept, path, "index", "bucket", batch)
            filled = {r.bucket for r in kept.select("bucket").distinct().collect()}
        finally:
            taken.unpersist()
        days = {d: v for d, v in {**old.days, **dict.fromkeys(homes, batch)}.items()}
        lists = {b: v for b, v in old.buckets.items() if b not in buckets} | dict.fromkeys(filled, batch)
        _commit(spark, path, State(batch, seal, days, lists))
        return dates, total - n_taken
    finally:
        new.unpersist()


def _commit(spark: SparkSession, path: str, s: State) -> None:
    rows = [("seal", s.seal, s.batch), *(("day", d, v) for d, v in s.days.items()), *(("bucket", str(b), v) for b, v in s.buckets.items())]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={s.batch}")


def current(spark: SparkSession, path: str, dates: list[str] | None = None) -> DataFrame | None:
    """The merged rows, all or of some dates; None before the first batch."""
    rows = _versions(spark, path, "merged", state(spark, path).days, None)
    return rows if rows is None or dates is None else rows.where(F.col("date").isin(dates))


def into_days(path: str, after: Callable[[DataFrame, list[str], int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: takes each batch into the table, then hands on the rows of the dates it touched, these dates and the batch.

    after may run again for a batch that comes again, with equal rows; writing by the batch's number makes that harmless.
    """

    def run(batch: DataFrame, number: int) -> None:
        dates, _ = upsert(batch, path, number)
        if after and dates:
            after(current(batch.sparkSession, path, dates), dates, number)

    return run
