"""Account history against a plain computation, on random days."""

import datetime
import random

from talliard.operators import history


def around(date, offs):
    return [(datetime.date.fromisoformat(date) + datetime.timedelta(days=o)).isoformat() for o in offs]


def plain_unlogged(rows, missing):
    out = {}
    for key in {r[:2] for r in rows}:
        day = [r for r in rows if r[:2] == key and r[2] != "unknown" and r[4] > 0]
        m = missing.get(key, 0)
        quiet = [r for r in day if r[3] <= 0]
        for r in day:
            if m > 0 and len(day) == 1:
                out[r[:3]] = min(m, r[4])
            elif m > 0 and r in quiet:
                out[r[:3]] = r[4] * min(1, m / sum(q[4] for q in quiet))
    return out


def plain_weights(acts, key, amount, expected):
    provider, date = key
    for radius in range(history.RADIUS + 1):
        offs = [0] if radius == 0 else [-1, 1] if radius == 1 else range(-radius, radius + 1)
        near = set(around(date, offs))
        t, e = {}, {}
        for (p, d, m), (tokens, _) in acts.items():
            if p == provider and d in near:
                if tokens > 0:
                    t[m] = t.get(m, 0) + tokens
                if expected.get((p, d, m), 0) > 0:
                    e[m] = e.get(m, 0) + expected[p, d, m]
        if not t and not e:
            continue
        if not e or not t:
            return t or e
        first = min(amount, sum(e.values()))
        return {m: (first * e[m] / sum(e.values()) if m in e else 0) + ((amount - first) * t[m] / sum(t.values()) if m in t else 0) for m in {*t, *e}}
    ever = {}
    for (p, _, m), (tokens, prompts) in acts.items():
        if p == provider:
            ever[m] = tuple(a + b for a, b in zip(ever.get(m, (0, 0)), (tokens, prompts), strict=True))
    return {min(ever, key=lambda m: (-ever[m][0], -ever[m][1], m)): 1} if ever else {}


def test_history_goes_to_machines(spark):
    rng = random.Random(4)
    days = around("2024-02-20", range(60))
    rows = [(p, d, m, rng.choice([0, 0, rng.randrange(1, 5000)]), rng.choice([0, rng.randrange(1, 9)])) for p in "xy" for d in days if rng.random() < 0.3 for m in ("a", "b", "c", "unknown") if rng.random() < 0.6]
    missing = {(p, d): rng.randrange(0, 6) for p in "xy" for d in days}
    amounts = {(p, d): rng.randrange(1, 10000) for p in "xyz" for d in days}
    places = spark.createDataFrame(rows, "provider string, date string, machine string, tokens long, prompts long")
    budget = spark.createDataFrame([(*k, v) for k, v in missing.items()], "provider string, date string, missing long")
    found = history.unlogged(places, budget)
    lost = plain_unlogged(rows, missing)
    got = {(r.provider, r.date, r.machine): r.unlogged for r in found.collect()}
    assert all(abs(got[r[:3]] - lost.get(r[:3], 0)) < 1e-9 for r in rows)

    acts = {r[:3]: (r[3], r[4]) for r in rows if r[2] != "unknown" and (r[3] > 0 or r[4] > 0)}
    lost = {k: min(v, acts[k][1]) for k, v in lost.items() if k in acts}

    def rate(p, dates, machine):
        some = [(t, n - lost.get(k, 0)) for k, (t, n) in acts.items() if k[0] == p and (dates is None or k[1] in dates) and machine in (None, k[2]) and t > 0 and n > lost.get(k, 0)]
        return sum(t for t, _ in some) / sum(n for _, n in some) if some else None

    expected = {}
    for k, v in lost.items():
        near = set(around(k[1], range(-7, 8)))
        expected[k] = v * next((r for r in (rate(k[0], near, k[2]), rate(k[0], near, None), rate(k[0], None, None)) if r is not None), 1)
    asked = spark.createDataFrame([(*k, v) for k, v in amounts.items()], "provider string, date string, amount long")
    weights = {}
    for r in history.attribution(asked, found).collect():
        weights.setdefault((r.provider, r.date), {})[r.machine] = r.weight
    for k, amount in amounts.items():
        want = plain_weights(acts, k, amount, expected)
        total, mine = sum(want.values()), weights.get(k, {})
        assert set(mine) == {m for m, w in want.items() if w > 0}
        assert all(abs(w / sum(mine.values()) - want[m] / total) < 1e-9 for m, w in mine.items())

    countries = spark.createDataFrame([("a", "de"), ("b", "FR"), ("c", "")], "machine string, cc string")
    moved = history.moves(asked.selectExpr("*", "cast(amount / 2 as bigint) as zz"), found, countries)
    sums = {}
    for r in moved.collect():
        key = (r.provider, r.date)
        sums.setdefault(key, {}).setdefault(r.kind, []).append((r.place, r.assigned))
        assert r.assigned > 0 or r.place in ("unknown", "ZZ")
    for key, kinds in sums.items():
        assert key[0] != "z" and sum(n for _, n in kinds["machine"]) == 0 and sum(n for _, n in kinds.get("country", [])) == 0
        assert dict(kinds["machine"])["unknown"] == -amounts[key]
    own = history.with_assigned(places.where("machine = 'a'"), moved, "a")
    assert own.agg({"assigned": "sum"}).first()[0] == sum(n for k in sums.values() for m, n in k["machine"] if m == "a")
