"""Near duplicates among embeddings against all cosines: copies, tight and wide groups, chains, odd vectors, recall at the threshold."""

import math

import numpy as np
import pytest

from talliard.llm import embedding_dedup as E
from talliard.llm.cross_polytope import Plan, rotated

SCHEMA = "vec_id long, embedding array<double>, label int, node long, cluster long"


def brute(rows, cosine=0.9):
    usable = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.zeros((len(usable), max(len(rows[k][1]) for k in usable)))
    for a, k in enumerate(usable):
        x[a, : len(rows[k][1])] = rows[k][1]
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label, ids = np.arange(len(x)), [rows[k][0] for k in usable]
    for _ in range(len(x)):
        least = np.minimum(label, np.where(near, label[None, :], len(x)).min(1, initial=len(x)))
        if (least == label).all():
            break
        label = least
    out = [[i, 0, i, True] for i, _ in rows]
    for a, k in enumerate(usable):
        group = [i for i, c in zip(ids, label, strict=True) if c == label[a] and i is not None]
        component = min(group) if group else None
        out[k][1:] = [int(near[a].sum()), component, component == rows[k][0]]
    return sorted(map(tuple, out), key=str)


def around(rng, centre, n, cosine):
    """n vectors whose cosines with each other are about cosine."""
    z = rng.normal(size=(n, len(centre)))
    z -= (z @ centre)[:, None] * centre
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return (math.sqrt(cosine) * centre + math.sqrt(1 - cosine) * z) * rng.uniform(0.1, 9, (n, 1))


def check(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3) for i, v in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, E.near_duplicates(df, **more).collect()), key=str)


@pytest.fixture
def vectors():
    rng = np.random.default_rng(3)
    units = rng.normal(size=(400, 24))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rows = [list(v) for v in units]
    for centre, n, cosine in ((units[0], 180, 0.98), (units[1], 90, 0.9), (units[2], 60, 0.93), (units[3], 5, 0.95), (units[4], 2, 0.99)):
        rows += [list(v) for v in around(rng, centre, n, cosine)]
    rows += [rows[7]] * 30 + [rows[410]] * 20 + [[2 * x for x in rows[8]]]
    step = units[5]
    for k in range(12):  # a chain: neighbours link, ends don't
        step = step + 0.35 * around(rng, units[6], 1, 0.5)[0] / 9
        rows.append(list(step))
    out = [(k * 2 if k % 40 else None, v) for k, v in enumerate(rows)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [math.nan] * 24, [math.inf] + [1.0] * 23, [1e300] * 24, [1e-300] * 24, [-0.0] * 23 + [1.0], [1.0], [5.0, 0.0]]
    return out + [(10_001 + k, v) for k, v in enumerate(odd)] + [out[9], (out[10][0], rows[0])]


@pytest.mark.parametrize("block", [32, 1024])
def test_classes_and_links(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    assert check(spark, vectors, recall=0.999999) == brute(vectors)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.901 * a + math.sqrt(1 - 0.901**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    rows = [(k, list(v)) for k, v in enumerate(np.concatenate([a, b]))]
    want, got = brute(rows), check(spark, rows)
    linked = sum(r[1] for r in want)
    assert linked > 300 and sum(r[1] for r in got) >= 0.97 * linked
    real = {r[0]: r for r in want}
    assert all(r[1] <= real[r[0]][1] for r in got)


def test_no_vectors(spark):
    assert check(spark, []) == [] and check(spark, [(1, None), (None, [])]) == [(1, 0, 1, True), (None, 0, None, True)]
    assert check(spark, [(5, [3.0]), (4, [1.0]), (6, [-1.0])]) == [(4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)]


def test_rotations_keep_angles():
    x = np.random.default_rng(1).normal(size=(50, 64))
    assert np.allclose(rotated(x, 3) @ rotated(x, 3).T, x @ x.T) and not np.allclose(rotated(x, 3), rotated(x, 4))


def test_plan_follows_the_number_of_vectors():
    small, large = Plan(1_000, 64, 0.9, 0.99, 2), Plan(100_000_000, 64, 0.9, 0.99, 2)
    assert math.prod(2 * k for k in large.takes) >= 100_000_000 and large.tables > small.tables
