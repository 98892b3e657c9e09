"""Near duplicates among embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

Vectors whose cosine reaches COSINE link; classes are what links reach. Candidates share a bucket, one as its own and
the other as its own or as a probe; only pairs whose cosine was computed, or is bounded by the triangle inequality of
angles, are links. The plan (see cross_polytope.Plan) takes about as many buckets as vectors and as many tables as
bring pairs at the very threshold to RECALL, so it follows the number of vectors.

1. Equal vectors are one node with a weight, so copies make no pairs.
2. Buckets of HOT nodes or more tell where vectors lie densely. Such nodes form clusters: each takes the fullest bucket that
   it, or another node of one of its buckets, has. All others stay single, so no bucket holds HOT single ones of its own.
3. Single nodes that share a bucket are pairs, filtered by 64-bit sketches and verified once each.
4. A node that shares a bucket with members of a cluster, and is in none or in an earlier one, is a guest of that cluster,
   whatever the number of members. Members are compared with each other and with guests in blocks of BLOCK, by matrices.
5. In clusters above BLOCK, members within half the angle of the threshold around a pivot, the mean of some members, are the
   core: they all link, uncompared. The other members and guests link with the whole core, with none of it, or are compared with it,
   as their angle to the pivot tells. So a tight group of any size takes one pass. A large group that is wider than that is
   compared in pairs of blocks, which takes the square of its size in comparisons, never in rows sent.

Counts travel as sums by node and links as trees, so no step sends all pairs of a group.

Null vectors, those of length zero, empty ones and those with null or non-finite components link with nothing. Vectors of
different lengths are compared as if the shorter ones ended in zeros. Rows with equal ids are vectors of their own. A null id takes
part in links but is never a class's id, unless the class has no other. An empty table gives no rows. Only the id and the
vector are read; other columns may have any name. Dimensions only widen rows; a task holds 2 BLOCK vectors.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.llm.common import stored
from talliard.llm.cross_polytope import Plan, unit
from talliard.llm.jaccard_join import components
from talliard.tables import table

COSINE = 0.9
RECALL = 0.99
PROBES = 2
#: Nodes that make a bucket hot, vectors of a block, and members whose mean is a pivot.
HOT, BLOCK, MEAN_OF = 16, 1024, 64
#: Vectors that are hashed at once.
AT_ONCE = 2048
#: Angles this near to a bound are compared.
EPS = 1e-7
NO_ID = (1 << 63) - 1
_COUNTS = "node long, other long, links long"


def _vectors(double: bool):
    """(id, raw): the bytes of a vector with a direction, else null."""

    def run(batches):
        kind = np.float64 if double else np.float32
        for batch in batches:
            raw = []
            for v in batch.column(1):
                if not v.is_valid or not len(v.values) or v.values.null_count:
                    raw.append(None)
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # one zero
                raw.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "raw"])

    return run


def _keys(plan: Plan, kind: str, probes: bool):
    """(key, node, base, sketch, cluster) for each table, with its probes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                x = unit(part.column(1).to_pylist(), kind, plan.width)
                sketch = pa.array(plan.sketches(x))
                for t in range(plan.tables):
                    keys = plan.keys(x, t)
                    for p in range(keys.shape[1] if probes else 1):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[:, p]), part.column(0), pa.array(np.full(len(x), p == 0)), sketch, part.column(2)], ["key", "node", "base", "sketch", "cluster"]
                        )

    return run


def _clusters(own: DataFrame) -> DataFrame:
    """(node, cluster) of nodes in hot buckets; own: (key, node)."""
    hot = own.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") >= HOT)
    at = stored(own.select("key", "node").join(hot, "key").select("key", "node", F.struct("size", "key").alias("rank")))
    best = at.groupBy("node").agg(F.max("rank").alias("best"))
    leader = at.join(best, "node").groupBy("key").agg(F.max("best").alias("leader"))
    return stored(at.join(leader, "key").groupBy("node").agg(F.max("leader").alias("l")).select("node", F.col("l.key").alias("cluster")))


def _verified(cosine: float, kind: str, width: int):
    def run(batches):
        for batch in batches:
            x, y = (unit(batch.column(k).to_pylist(), kind, width) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x * y).sum(1) >= cosine))

    return run


def _forest(rows: np.ndarray, columns: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links between places of rows and columns, as trees over nodes."""
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        joined.setdefault(x, x)
        while joined[x] != x:
            joined[x] = x = joined[joined[x]]
        return x

    found = []
    for i, j in zip(rows[a].tolist(), columns[b].tolist(), strict=True):
        x, y = root(i), root(j)
        if x != y:
            joined[max(x, y)] = min(x, y)
            found.append((i, j))
    return found


def _compared(cosine: float, kind: str, width: int):
    """Of a cell: what each node links with (node, null, links), and trees of links (node, other, null).

    Rows of side 0 are compared with those of side 1; without side 1, with each other.
    """

    def run(t: pa.Table) -> pa.Table:
        side, node, weight = (t[c].to_numpy() for c in ("side", "node", "weight"))
        x = unit(t["raw"].to_pylist(), kind, width)
        a = np.flatnonzero(side == 0)
        alone = len(a) == len(side)
        b = a if alone else np.flatnonzero(side == 1)
        links, edges = np.zeros(len(node), np.int64), []
        for at in range(0, len(a), AT_ONCE // 4):
            rows = a[at : at + AT_ONCE // 4]
            near = x[rows] @ x[b].T >= cosine
            if alone:
                near[np.arange(len(rows)), at + np.arange(len(rows))] = False
            links[rows] += near @ weight[b]
            if not alone:
                links[b] += near.T @ weight[rows]
            # a row's first link and each column's first row hold together what the rows link
            i, j = np.nonzero(near)
            edges += _forest(node[rows], node[b], i, j)
        use = np.flatnonzero(links)
        none = pa.nulls(len(use), pa.int64())
        counts = pa.Table.from_arrays([pa.array(node[use]), none, pa.array(links[use])], ["node", "other", "links"])
        ends = pa.Table.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)] + [pa.nulls(len(edges), pa.int64())], ["node", "other", "links"])
        return pa.concat_tables([counts, ends])

    return run


def _mean(kind: str, width: int):
    def run(t: pa.Table) -> pa.Table:
        mean = unit(t["raw"].to_pylist(), kind, width).sum(0)
        return pa.table({"cluster": t["cluster"][:1], "pivot": pa.array([mean.tobytes()], pa.binary())})

    return run


def _angles(kind: str, width: int):
    """Rows with their angle to the pivot; a right one where the mean has no direction."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            x = unit(batch.column(names.index("raw")).to_pylist(), kind, width)
            p = np.array([np.frombuffer(v, np.float64) for v in batch.column(names.index("pivot")).to_pylist()]).reshape(len(x), width)
            n = np.linalg.norm(p, axis=1)
            cosine = (x * p).sum(1) / np.where(n > 0, n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arccos(np.clip(cosine, -1, 1)))], [*names, "angle"])

    return run


def _cells(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """Blocks of left, of the same cluster, with blocks of right or with each other: (cell, side, node, raw, weight), a row for each cell."""

    def blocks(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        sizes = df.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        return df, sizes

    _, a = blocks(left, "na")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    if right is None:
        cut = left.join(a, "cluster").withColumn("own", own("na")).withColumn("with", F.explode(F.expr("sequence(0, na - 1)")))
        cell = F.struct("cluster", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
        # within a block all are compared with each other, else one block is side 1
        return cut.select(cell.alias("cell"), F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"), "node", "raw", "weight")
    _, b = blocks(right, "nb")
    sizes = stored(a.join(b, "cluster"))
    first = left.join(sizes, "cluster").withColumn("i", own("na")).withColumn("j", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("side", F.lit(0))
    second = right.join(sizes, "cluster").withColumn("j", own("nb")).withColumn("i", F.explode(F.expr("sequence(0, na - 1)"))).withColumn("side", F.lit(1))
    both = [df.select(F.struct("cluster", "i", "j").alias("cell"), "side", "node", "raw", "weight") for df in (first, second)]
    return both[0].unionByName(both[1])


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(key, n_links, component_id, kept) of each row of df."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    double = "double" in df.select(q(vector)).dtypes[0][1]
    kind, bytes_of = ("f8", 8) if double else ("f4", 4)
    wide = F.col("v").cast("array<double>" if double else "array<float>")
    rows = df.select(q(key).cast("long").alias("id"), q(vector).alias("v")).select("id", wide.alias("v")).mapInArrow(_vectors(double), "id long, raw binary")
    grouped = rows.where("raw is not null").groupBy("raw").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    nodes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "raw", "weight", F.coalesce("least", F.lit(NO_ID)).alias("least")))
    n, longest = nodes.agg(F.count("*"), F.max(F.length("raw"))).first()
    if not n:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    plan = Plan(n, longest // bytes_of, cosine, recall, PROBES)
    width, limit = plan.width, math.acos(cosine)
    hashed = "key long, node long, base boolean, sketch long, cluster long"
    none = F.lit(None).cast("long").alias("cluster")
    clusters = _clusters(nodes.select("node", "raw", none).mapInArrow(_keys(plan, kind, False), hashed))
    grouped = stored(nodes.join(clusters, "node", "left"))
    keys = stored(grouped.select("node", "raw", "cluster").mapInArrow(_keys(plan, kind, True), hashed))
    vectors = grouped.select("node", "raw", "weight")

    # single nodes
    single = keys.where("cluster is null")
    a, b = single.where("base").alias("a"), single.alias("b")
    meet = a.join(b, "key").where(F.expr(f"a.node <> b.node and (not b.base or a.node < b.node) and bit_count(a.sketch ^ b.sketch) <= {plan.most_bits}"))
    pairs = meet.select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct()
    raw = lambda name: vectors.select(F.col("node").alias(name), F.col("raw").alias(f"raw_{name}"))
    true = stored(pairs.join(raw("x"), "x").join(raw("y"), "y").select("x", "y", "raw_x", "raw_y").mapInArrow(_verified(cosine, kind, width), "x long, y long"))
    weight = nodes.select("node", "weight")
    counted = [true.select(F.col(p).alias("node"), F.col(o).alias("to")).join(weight.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.sum("weight").alias("links")) for p, o in (("x", "y"), ("y", "x"))]
    edges = [true.select(F.col("x").alias("a"), F.col("y").alias("b"))]

    # clusters and their guests
    if clusters.head(1):
        here = keys.where("cluster is not null").groupBy("key", F.col("cluster").alias("c")).agg(F.max("base").alias("b"), F.bit_and("sketch").alias("all"), F.bit_or("sketch").alias("any"))
        apart = "bit_count((sketch ^ all) & (all | ~any))"  # bits in which a node differs from every member in the bucket
        met = keys.join(here, "key").where(f"(cluster is null or cluster < c) and (base or b) and {apart} <= {plan.most_bits}")
        guests = met.select("node", F.col("c").alias("cluster")).distinct().join(vectors, "node")
        members = grouped.where("cluster is not null").select("cluster", "node", "raw", "weight")
        size = stored(members.groupBy("cluster").agg(F.count("*").alias("size")))
        large = size.where(F.col("size") > BLOCK).select("cluster")
        found = []
        if large.head(1):
            some = members.join(large, "cluster").groupBy("cluster", F.pmod(F.xxhash64("node"), F.lit(MEAN_OF)).alias("k")).agg(F.min("node").alias("node"))
            mean = _mean(kind, width)
            pivots = stored(some.select("cluster", "node").join(vectors, "node").groupBy("cluster").applyInArrow(lambda t: mean(t), "cluster long, pivot binary"))
            both = members.withColumn("guest", F.lit(False)).unionByName(guests.select("cluster", "node", "raw", "weight", F.lit(True).alias("guest")))
            turned = both.join(pivots, "cluster").mapInArrow(_angles(kind, width), "cluster long, node long, raw binary, weight long, guest boolean, pivot binary, angle double")
            turned = stored(turned.drop("pivot").withColumn("core", ~F.col("guest") & (F.col("angle") <= limit / 2 - EPS)))
            core = turned.where("core")
            cores = core.groupBy("cluster").agg(F.max("angle").alias("reach"), F.min("node").alias("at"), F.sum("weight").alias("held"))
            judged = turned.where("not core").join(cores, "cluster", "left")
            judged = stored(judged.withColumn("all", F.coalesce(F.col("angle") + F.col("reach") <= limit - EPS, F.lit(False))).withColumn("far", F.coalesce(F.col("angle") - F.col("reach") > limit + EPS, F.lit(True))))
            more = judged.where("all").groupBy("cluster").agg(F.sum("weight").alias("more"))
            known = cores.join(more, "cluster", "left")
            counted.append(core.join(known, "cluster").select("node", (F.col("held") - F.col("weight") + F.coalesce("more", F.lit(0))).alias("links")))
            counted.append(judged.where("all").select("node", F.col("held").alias("links")))
            edges += [df.select(F.col("at").alias("a"), F.col("node").alias("b")).where("a <> b") for df in (core.join(cores, "cluster"), judged.where("all"))]
            plain = ["cluster", "node", "raw", "weight"]
            found.append(_cells(judged.where("not all and not far").select(*plain), core.select(*plain)))
            rest = members.join(large, "cluster", "left_anti").unionByName(judged.where("not guest").select(*plain))
        else:
            rest = members
        found += [_cells(rest, None), _cells(guests, rest)]
        compare = _compared(cosine, kind, width)
        for cells in found:
            made = stored(cells.groupBy("cell").applyInArrow(lambda t: compare(t), _COUNTS))
            counted.append(made.where("other is null").select("node", "links"))
            edges.append(made.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))

    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    sums = union(counted).groupBy("node").agg(F.sum("links").alias("links"))
    links = stored(union(edges))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least"), "node")
    classes = components(ends, links).select("node", F.col("least").alias("reached"))
    known = stored(nodes.join(sums, "node", "left").join(classes, "node", "left").select("raw", "weight", F.col("least").alias("id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("reached", "least").alias("component")))
    once = known.where("weight = 1").select(F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "n_links", "component")
    copies = rows.where("raw is not null").join(known.where("weight > 1").drop("id"), "raw").select("id", "n_links", "component")
    alone = rows.where("raw is null").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("id", F.lit(NO_ID)).alias("component"))
    component = F.when(F.col("component") != NO_ID, F.col("component"))
    out = once.unionByName(copies).unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
