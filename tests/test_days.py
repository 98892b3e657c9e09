"""Versioned days: batches that are replayed, reordered, interrupted or late, against one merge."""

import random

import pytest
from pyspark.sql import functions as F
from test_streaming import sightings

from talliard.operators.merge import merge_usage
from talliard.streaming import days


def same(spark, path, rows):
    want = merge_usage(rows)
    got = days.current(spark, path).select(*want.columns)
    return sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order(spark, tmp_path, seed):
    rows, path = sightings(spark), str(tmp_path / "t")
    parts = [rows.where(f"cast(seq as int) % 4 = {k}") for k in range(4)]
    order = [0, 1, 2, 3, 1]
    random.Random(seed).shuffle(order)
    for n, k in enumerate(order):
        days.upsert(parts[k], path, n)
    assert same(spark, path, rows)


def test_a_replayed_or_broken_batch(spark, tmp_path, monkeypatch):
    rows, path = sightings(spark), str(tmp_path / "t")
    days.upsert(rows.where("seq < '00050'"), path, 0)
    for _ in range(2):
        days.upsert(rows.where("seq >= '00050' and seq < '00090'"), path, 1)
    monkeypatch.setattr(days, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        days.upsert(rows.where("seq >= '00090'"), path, 2)
    monkeypatch.undo()
    assert same(spark, path, rows.where("seq < '00090'")) and days.state(spark, path).batch == 1
    days.upsert(rows.where("seq >= '00090'"), path, 2)
    assert same(spark, path, rows)


def test_seal(spark, tmp_path):
    rows, path = sightings(spark), str(tmp_path / "t")
    at = lambda day, ids: rows.where(F.col("id").isin(ids)).withColumn("ts", F.to_timestamp(F.lit(f"2026-09-{day:02d} 05:00:00")))
    first = at(1, ["id1", "id2"])
    assert days.upsert(first, path, 0)[1] == 0
    days.upsert(at(10, ["id3"]), path, 1)
    s = days.state(spark, path)
    assert s.seal == "2026-09-03" and s.days == {"2026-09-01": 0, "2026-09-10": 1}
    late = at(2, ["id4", "id1"])
    dates, behind = days.upsert(late, path, 2)
    assert behind == late.count() and dates == [] and days.state(spark, path).seal == "2026-09-03"  # the seal never falls
    dates, behind = days.upsert(at(3, ["id5"]), path, 3)
    assert behind == 0 and dates == ["2026-09-03"]
    assert same(spark, path, first.unionByName(at(10, ["id3"])).unionByName(at(3, ["id5"])))


def test_reads_do_not_grow_with_history(spark, tmp_path, monkeypatch):
    """A bucket that is read holds what is open; those that no batch asks for are not read."""
    monkeypatch.setattr(days, "BUCKETS", 1)
    rows, path = sightings(spark, n=40, ids=8), str(tmp_path / "t")
    sizes = []
    for k in range(12):
        day = rows.withColumn("ts", F.to_timestamp(F.lit(f"2026-{1 + k // 2:02d}-{1 + k % 2 * 14:02d} 05:00:00"))).withColumn("id", F.concat(F.lit(f"{k}-"), "id"))
        days.upsert(day, path, k)
        s = days.state(spark, path)
        index = days._versions(spark, path, "index", s.buckets, "id string, home string")
        sizes.append(index.count())
    assert max(sizes) <= 2 * 8 and days.current(spark, path).count() == 12 * 8


def test_stream(spark, tmp_path):
    rows, path, seen = sightings(spark), str(tmp_path / "t"), []
    for k in range(3):
        rows.where(f"cast(seq as int) % 3 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = days.into_days(path, lambda df, dates, n: seen.append((n, df.count(), dates)))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(run).trigger(availableNow=True).start().awaitTermination()
    assert same(spark, path, rows) and [n for n, *_ in seen] == [0, 1, 2]


def test_empty_batch(spark, tmp_path):
    rows, path = sightings(spark), str(tmp_path / "t")
    assert days.upsert(rows.limit(0), path, 0) == ([], 0) and days.current(spark, path) is None
    days.upsert(rows, path, 1)
    assert days.upsert(rows.limit(0), path, 2) == ([], 0) and same(spark, path, rows)
