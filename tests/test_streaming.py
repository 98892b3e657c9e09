"""Streams over files that are written here, against the same work in one batch."""

import random

import pytest
from pyspark.sql import functions as F

from talliard.operators.merge import MEASURES, merge_usage
from talliard.streaming import live, pending

COLUMNS = f"id string, provider string, source string, ts timestamp, ts_q string, tz_offset_min long, model string, acct string, acct_q string, q string, pv long, session string, {', '.join(f'{m} long' for m in MEASURES)}, machine string, cc string, ws string, seq string"


def sightings(spark, n=120, ids=30, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        i = rng.randrange(ids)
        acct = rng.choice(["", "a1", "a2"])
        ts = f"2026-09-{10 + i % 4:02d} 0{rng.randrange(9)}:00:00"
        rows.append((f"id{i}", "openai", "codex", ts, rng.choice(["event", "session-start"]), 60, rng.choice(["", "m"]), acct, rng.choice(["recorded", "inferred"]) if acct else "unknown", rng.choice(["exact", "estimated"]), rng.randrange(1, 3), "s", *(rng.randrange(9) for _ in MEASURES), rng.choice(["", "m1", "m2"]), "US", f"w{i}", f"{k:05d}"))
    plain = COLUMNS.replace("ts timestamp", "ts string")
    return spark.createDataFrame(rows, plain).withColumn("ts", F.to_timestamp("ts"))


def run(query):
    done = query.trigger(availableNow=True).start()
    done.awaitTermination()


@pytest.fixture
def stream(spark, tmp_path):
    rows = sightings(spark)
    for k, part in enumerate((rows.where("seq < '00060'"), rows.where("seq >= '00060'"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    return lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_merge_does_not_depend_on_order(spark):
    rows = sightings(spark)
    assert sorted(merge_usage(rows).collect()) == sorted(merge_usage(rows.orderBy("model", "pv")).collect())


def test_upserts_equal_one_merge(spark, tmp_path):
    rows, path = sightings(spark), str(tmp_path / "days")
    for part in ("seq < '00040'", "seq >= '00040' and seq < '00080'", "seq >= '00080'", "seq >= '00080'"):
        days = live.upsert(rows.where(part), path)
    want = merge_usage(rows)
    got = spark.read.parquet(path).withColumn("date", F.col("date").cast("string")).select(*want.columns)
    assert days and sorted(got.collect()) == sorted(want.collect())


def test_stream_into_days(spark, stream, tmp_path):
    path, seen = str(tmp_path / "out"), []
    run(stream().writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(live.into_days(path, lambda df, days: seen.extend(days))))
    assert spark.read.parquet(path).count() == 30 and len(set(seen)) == 4


def test_growth_sums_to_the_maximum(spark, stream, tmp_path):
    with pending.rocksdb(spark):
        run(live.growth(stream()).writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("memory").queryName("grown").outputMode("append"))
    got = spark.sql("select id, sum(tok_out) as n from grown group by id order by id").collect()
    want = sightings(spark).groupBy("id").agg({"tok_out": "max"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_hourly_counts_an_id_once(spark, stream, tmp_path):
    run(live.hourly(stream()).writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("memory").queryName("hours").outputMode("update"))
    assert spark.sql("select sum(n) as n from (select max(events) as n from hours group by start, provider)").first().n == 30


def test_growth_ends_by_event_time(spark, tmp_path):
    """What was last seen long before the watermark is forgotten; state is then empty but for the newest."""
    rows = sightings(spark)
    late = rows.where("id = 'id1'").withColumn("ts", F.to_timestamp(F.lit("2026-12-01 00:00:00"))).withColumn("id", F.lit("last"))
    for k, part in enumerate((rows, late, late)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        with pending.rocksdb(spark):
            grown = live.growth(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
            done = grown.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            done.awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "cp"))
    assert [r[0] for r in state.select("key.id").collect()] == ["last"]
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("id").count().where("id = 'last' and count > 1").count() == 0
