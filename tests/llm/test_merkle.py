"""The Merkle manifest against a tree built in a loop: nulls, repeated rows, many and large groups, any partitions."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from talliard.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos long, grp string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grown(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def leaf(row):
    return digest(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS))


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = grown([leaf(r) for r in groups[s]])
    top = grown([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for k, r in enumerate(groups[s]):
            path = []
            for tree, place in ((trees[s], k), (top, i)):
                for level in tree[:-1]:
                    first = place - place % 16
                    path.append((level[first:place], level[place + 1 : first + 16]))
                    place //= 16
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            node = leaf(r | {"text": r["text"].translate(LOWER)} if hit else r)
            for left, right in path:
                node = digest(*left, node, *right)
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], root, digest(*(x for a, b in path for x in a + b)), node, node == root))
    return sorted(out, key=str)


def made(sizes):
    rows = []
    for n, (source, size) in enumerate(sizes):
        for k in range(size):
            text = [None, "", "Some Text ü", "plain", "X" * 3000][k % 5]
            rows.append((None if k % 17 == 3 else n * 10_000 + k * 7, text, ["en", None][k % 2], source, [None, k][k % 3 > 0], "clash", 1, "clash"))
            if k % 50 == 9:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("sizes", [[("one", 1)], [(None, 1), ("", 17), ("a", 256), ("ä", 300), ("b", 16)], [("hot", 4500), (None, 3)], [(f"s{k}", 1 + k % 3) for k in range(300)]])
def test_manifest(spark, tmp_path, monkeypatch, sizes):
    rows = made(sizes)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(merkle, "table", lambda *_: df)
    got = sorted(map(tuple, merkle.op13(spark, "").collect()), key=str)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    assert got == brute([dict(zip(names, r, strict=True)) for r in rows])


def test_empty(spark):
    m = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert m.root is None and merkle.proofs(m).count() == 0


def test_real_proofs_lead_to_the_root(spark):
    df = spark.createDataFrame(made([("a", 600), ("b", 5)]), SCHEMA)
    m = merkle.manifest(df)
    found = merkle.proofs(m).collect()
    assert len(found) == df.count() and all(merkle.folded(r.leaf, r.proof) == m.root == r.root for r in found)
    assert not any(merkle.folded(digest("other"), r.proof) == m.root for r in found[:20])


def test_any_partitions_give_one_root(spark):
    df = spark.createDataFrame(made([("a", 900), (None, 40)]), SCHEMA)
    assert merkle.manifest(df.repartition(7)).root == merkle.manifest(df.coalesce(1).orderBy(F.desc("doc_id"))).root
