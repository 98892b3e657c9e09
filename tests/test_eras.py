"""Plan eras against a loop over all marks and streams."""

import random
from datetime import datetime, timedelta

import pytest

from talliard.operators import accounts, eras

START = datetime(2026, 1, 1)
RECORDS = "provider string, home string, stream string, plan string, ts timestamp, to_ts timestamp"
ANCHORS = "provider string, home string, ts timestamp, acct string"


def made(seed, n=140):
    rng = random.Random(seed)
    at = lambda: START + timedelta(minutes=rng.randrange(0, 20 * 1440, 7))
    records = []
    for k in range(n):
        t = at()
        day = (t - START).days
        plan = f"p{(day // 2 + (rng.random() < 0.02)) % 3}"
        records.append((rng.choice(["openai", "xai"]), "h", f"s{day // 2 if rng.random() < 0.97 else k % 5}", plan, t, rng.choice([None, t, t + timedelta(minutes=rng.randrange(300)), t - timedelta(minutes=9)])))
    anchors = [("openai", "h", at() if rng.random() < 0.7 else rng.choice(records)[4], f"a{rng.randrange(2)}") for _ in range(25)]
    return records, anchors


def brute(records, anchors):
    out = set()
    for key in {r[:2] for r in records}:
        mine = [r for r in records if r[:2] == key]
        marks = sorted((at, ts, stream, plan, k) for _, _, stream, plan, ts, to in mine for k, at in ((0, ts), (1, max(ts, to or ts))))
        streams = {}
        for _, _, s, p, ts, to in mine:
            first, last, plans = streams.get(s, (ts, ts, set()))
            streams[s] = min(first, ts), max(last, ts, to or ts), plans | {p}
        runs = [[marks[0][0], marks[0][0]]]
        for (t1, _, _, a, _), (t2, _, _, b, _) in zip(marks, marks[1:], strict=False):
            linked = any({a, b} <= plans and first <= t2 and last >= t1 for first, last, plans in streams.values())
            if a != b and not linked:
                runs.append([t2, t2])
            runs[-1][1] = t2
        for a, b in runs:
            seen = {x[3] for x in anchors if x[:2] == key and a <= x[2] <= b}
            out.add((*key, a, b, min(seen) if len(seen) == 1 else None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_eras(spark, seed):
    records, anchors = made(seed)
    got = eras.plan_eras(spark.createDataFrame(records, RECORDS), spark.createDataFrame(anchors, ANCHORS))
    want = brute(records, anchors)
    assert {tuple(r) for r in got.collect()} == want
    assert len(want) > 3
    events = [(k, r[0], r[1], r[4]) for k, r in enumerate(records)]
    found = {r.id: r.acct for r in eras.by_era(spark.createDataFrame(events, "id long, provider string, home string, ts timestamp"), got).collect()}
    for k, p, h, t in events:
        inside = sorted((a, b, acct) for q, g, a, b, acct in want if (q, g) == (p, h) and a <= t <= b and acct)
        assert found.get(k) == (inside[0][2] if inside else None)


def test_eras_carry_accounts_on(spark):
    hour = lambda h: START + timedelta(hours=h)
    plans = spark.createDataFrame([("openai", "h", "s1", "plus", hour(0), hour(10)), ("openai", "h", "s2", "pro", hour(20), hour(30))], RECORDS)
    none = lambda schema: spark.createDataFrame([], f"provider string, home string, {schema}")
    samples = spark.createDataFrame([("openai", "h", hour(2), "a1"), ("openai", "h", hour(21), "a2")], ANCHORS)
    evidence = {
        "probes": none("from_ts timestamp, to_ts timestamp, acct string"), "bounds": none("ts timestamp"), "sessions": none("session string, ts timestamp, acct string"), "orgs": none("org string, acct string, rank int"),
        "spans": none("session string, proc string, from_ts timestamp, to_ts timestamp"), "users": none("proc string, ts timestamp, acct string"), "folders": none("proc string, from_ts timestamp, to_ts timestamp, acct string"),
        "owners": none("proc string, ts timestamp, acct string"), "samples": samples, "plans": plans,
    }
    events = spark.createDataFrame([(k, "openai", "h", hour(t), "", "", "", None) for k, t in enumerate((9, 15, 22))], "id long, provider string, home string, ts timestamp, session string, hint string, hint_kind string, hint_at timestamp")
    assert {(r.id, r.acct, r.acct_q) for r in accounts.attributed(events, evidence).collect()} == {(0, "a1", "lineage"), (1, "a2", "inferred"), (2, "a2", "lineage")}


def test_no_records(spark):
    assert eras.plan_eras(spark.createDataFrame([], RECORDS), spark.createDataFrame([], ANCHORS)).count() == 0
