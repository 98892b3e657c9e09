"""Usage as it arrives: deduplicated windows, growth of events that are still written, and upserts of merged days."""

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from talliard.functions.ids import local_date
from talliard.functions.metrics import TOKENS
from talliard.operators.merge import MEASURES, merge_usage
from talliard.tables import staged

#: Days stay open for late events this long; then they are sealed.
SEAL = "7 days"
#: An event may grow this long after it was last seen, and for as long as its day is open.
LIVE_MS = 2 * 3600 * 1000


def hourly(stream: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, provider): events, tokens and the latest time; an id counts once, events behind the seal are dropped."""
    once = stream.withWatermark("ts", SEAL).dropDuplicatesWithinWatermark(["id"])
    spans = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = once.groupBy(spans.alias("w"), "provider").agg(
        F.count("*").alias("events"), F.sum(sum((F.col(m) for m in TOKENS), F.lit(0))).cast("long").alias("tokens"), F.max("ts").alias("latest")
    )
    return sums.select(F.col("w.start").alias("start"), "provider", "events", "tokens", "latest")


class Growth(StatefulProcessor):
    """State: an event's measures so far, which a timer ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", f"until long, {', '.join(f'{m} long' for m in MEASURES)}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = tuple(self.seen.get()) if self.seen.exists() else None
        until, before = (old[0], old[1:]) if old else (0, (0,) * len(MEASURES))
        after, first, latest = before, None, timerValues.getCurrentWatermarkInMs()
        for r in rows:
            after = tuple(max(a, r[m] or 0) for a, m in zip(after, MEASURES, strict=True))
            latest = max(latest, int(r.ts.timestamp() * 1000))
            first = r if first is None or r.seq < first.seq else first
        if latest + LIVE_MS > until:
            if until:
                self.handle.deleteTimer(until)
            until = latest + LIVE_MS
            self.handle.registerTimer(until)
        self.seen.update((until, *after))
        if after != before:
            yield Row(id=key[0], provider=first.provider, ts=first.ts, **{m: a - b for m, a, b in zip(MEASURES, after, before, strict=True)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def growth(stream: DataFrame) -> DataFrame:
    """(id, provider, ts, measures): what each event's measures grew by, so that plain sums count every event once.

    State ends by event time: timeouts by the clock would keep a query over all available files from ever ending. Needs the RocksDB
    state store (see pending.rocksdb).
    """
    out = "id string, provider string, ts timestamp, " + ", ".join(f"{m} long" for m in MEASURES)
    kept = stream.select("id", "provider", "ts", "seq", *MEASURES).withWatermark("ts", SEAL)
    return kept.groupBy("id").transformWithState(Growth(), out, "append", "eventTime")


def upsert(batch: DataFrame, path: str) -> list[str]:
    """Merges a batch of sightings into the table at path, partitioned by date; rewrites only the days it touches, and returns them.

    What is stored came first, so it wins where first sightings decide. Doing a batch again changes nothing.
    """
    spark = batch.sparkSession
    new = batch.withColumn("date", local_date(F.col("ts"), F.col("tz_offset_min")))
    try:
        old = spark.read.parquet(path).withColumn("seq", F.lit("")).withColumn("date", F.col("date").cast("string"))
    except AnalysisException:
        days = None
        merged = merge_usage(batch)
    else:
        known = old.select("id", "date").join(new.select("id").distinct(), "id", "left_semi").select("date")
        days = sorted(r.date for r in known.union(new.join(old.select("id"), "id", "left_anti").select("date")).distinct().toLocalIterator())
        both = old.where(F.col("date").isin(days)).unionByName(new.select(*old.columns))
        merged = merge_usage(both.drop("date"))
        first = both.groupBy("id").agg(F.min_by("date", "seq").alias("date"))
        merged = merged.drop("date").join(first, "id")
    rows = staged(merged)
    rows.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return days if days is not None else sorted(r.date for r in rows.select("date").distinct().toLocalIterator())


def into_days(path: str, after: Callable[[DataFrame, list[str]], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: upserts each batch, then hands the touched days to after, as for their rollups."""

    def run(batch: DataFrame, _: int) -> None:
        days = upsert(batch, path)
        if after and days:
            after(batch.sparkSession.read.parquet(path).where(F.col("date").isin(days)), days)

    return run
