"""Rollups that keep what an older one held, against loops over cells and counters."""

import random

import pytest

from talliard.operators import recover

SCHEMA = ", ".join(f"{c} string" for c in recover.CELL) + ", " + ", ".join(f"{c} long" for c in recover.COUNTERS)


def made(seed, n, sources=("claude-code", "native-claude", "codex")):
    rng = random.Random(seed)
    cells = {}
    for _ in range(n):
        source = rng.choice(sources)
        key = (f"2026-01-0{rng.randrange(1, 4)}", "openai" if source == "codex" else "anthropic", source, rng.choice(["m", ""]), rng.choice(["", "a1", "a2"]), rng.choice(["exact", "estimated"]))
        cells[key] = tuple(rng.randrange(9) for _ in recover.COUNTERS)
    return cells


def brute(old, new, moved):
    level = lambda k: (*k[:2], "claude-code" if k[2] == "native-claude" else k[2], k[3])
    add = lambda into, k, v, sign=1: into.__setitem__(k, tuple(a + sign * b for a, b in zip(into.get(k, (0,) * len(v)), v, strict=True)))
    now, out, given = dict(new), dict(new), {}
    for k, v in moved.items():
        add(now, k, v, -1)
        add(now, (*k[:2], "claude-code", *k[3:]), v)
    for lev in {level(k) for k in old}:
        for i in range(len(recover.COUNTERS)):
            need = sum(v[i] for k, v in old.items() if level(k) == lev) - sum(v[i] for k, v in now.items() if level(k) == lev)
            for k in sorted((k for k in old if level(k) == lev), key=lambda k: "|".join(k[1:])):
                part = min(need, old[k][i] - now.get(k, (0,) * 10)[i])
                if part > 0:
                    gift = tuple(part if j == i else 0 for j in range(10))
                    add(out, k, gift)
                    add(given, k, gift)
                    need -= part
    return out, given


@pytest.mark.parametrize("seed", range(4))
def test_salvage(spark, seed):
    old, new = made(seed, 40), made(seed + 10, 30)
    moved = {k: tuple(x // 2 for x in v) for k, v in new.items() if k[2] == "native-claude"} if seed % 2 else {}
    df = lambda cells: spark.createDataFrame([(*k, *v) for k, v in cells.items()], SCHEMA)
    given = recover.given_back(df(old), df(new), {"native-claude": "claude-code"}, df(moved) if moved else None)
    want, gifts = brute(old, new, moved)
    assert {tuple(r[:6]): tuple(r[6:]) for r in given.collect()} == gifts
    got = {tuple(r[:6]): tuple(r[6:]) for r in recover.salvaged(df(old), df(new), given).collect()}
    assert got == want and gifts
    at = [recover.COUNTERS.index(c) for c in recover.LEDGER]
    assert {tuple(r) for r in recover.unledgered(given).collect()} == {k[:3] for k, v in gifts.items() if any(v[i] for i in at)}


def test_seen_ids_of_filled_dates(spark):
    given = spark.createDataFrame([("2026-03-01", "p", "s", "m", "", "exact", *([1] * 10))], SCHEMA)
    ids = spark.createDataFrame([("2026-03-01", "x"), ("2026-03-01", "x"), ("2026-03-05", "y")], "date string, id string")
    assert {(str(r.day), r.id) for r in recover.ids_kept(ids, given).collect()} == {("2026-02-28", "x"), ("2026-03-01", "x"), ("2026-03-02", "x")}


def test_no_old_rollup(spark):
    none, new = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("d", "p", "s", "m", "", "exact", *range(10))], SCHEMA)
    given = recover.given_back(none, new)
    assert given.count() == 0 and recover.salvaged(none, new, given).collect() == new.collect()
