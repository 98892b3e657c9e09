"""Lookups by time over days, ties and gaps, against a scan of all samples."""

import random
from datetime import datetime, timedelta

from talliard.operators import asof


def made(n, seed):
    rng = random.Random(seed)
    start = datetime(2026, 9, 1)
    return [(f"{seed}-{k}", rng.choice("ab"), start + timedelta(hours=rng.choice([0, 1, 23, 24, 25, 200, 201, 400]), minutes=rng.choice([0, 30]))) for k in range(n)]


def test_lookups(spark):
    events, samples = made(60, 1), sorted(set((k, t) for _, k, t in made(12, 2)))
    samples = [(k, t, f"v{i}") for i, (k, t) in enumerate(samples)]
    e = spark.createDataFrame(events, "id string, key string, ts timestamp")
    s = spark.createDataFrame(samples, "key string, ts timestamp, seen string")
    before = {r.id: r.seen for r in asof.last_before(e, s, ["key"], "seen").collect()}
    near = {r.id: r.seen for r in asof.nearest(e, s, ["key"], "seen").collect()}
    for i, key, ts in events:
        own = [(t, v) for k, t, v in samples if k == key]
        earlier = [x for x in own if x[0] <= ts]
        assert before[i] == (max(earlier)[1] if earlier else None)
        assert near[i] == min(own, key=lambda x: (abs(x[0] - ts), x[0]))[1]


def test_intervals(spark):
    rows = [("a", datetime(2026, 9, d), v) for d, v in ((1, "x"), (2, "x"), (3, "y"), (5, "x"))]
    got = asof.intervals(spark.createDataFrame(rows, "key string, ts timestamp, plan string"), ["key"], "plan").orderBy("from_ts").collect()
    assert [(r.plan, r.from_ts.day, r.to_ts and r.to_ts.day) for r in got] == [("x", 1, 3), ("y", 3, 5), ("x", 5, None)]
