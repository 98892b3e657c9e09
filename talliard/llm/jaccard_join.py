"""N-gram Jaccard join: a metric-space join with pivots, Voronoi regions and triangle-inequality windows, recursive and exact.

Two documents link when their sets of word shingles have a Jaccard similarity of PERCENT or more; classes are what
links reach. Distances are symmetric differences, a metric; linked sets differ in at most a share of their sizes. A
set's sketch has a bit for each bucket of shingles, set where an odd number of them falls in; the bits in which two
sketches differ are a metric too, never above the distance of the sets. The join goes from coarse to fine regions:

1. Rings. The empty set is a pivot, a set's size its distance. Sets are cut into rings by size, and by the triangle
   inequality a set is copied into each ring where a smaller partner can lie.
2. Parts. Random texts are at distance 1 of each other and of any pivot, so pivots over a whole ring would copy all of
   them into all regions. So sets of a ring first come together by hashes of parts of their shingles: linked ones
   agree in a part that holds shingles (see shingle_sets.part_keys). Groups with the same members are one.
3. Groups. Each group takes a member as pivot; members no farther from it than links reach are done, and its ball holds
   all members that are at most one link farther than the farthest of these, where by the triangle inequality all their
   partners lie.
   The others go on with the next pivot, until none is left. Balls that share members are one family, so each set
   is in one family and all of its partners are too. Groups of very many members are cut into pairs of blocks.
4. Families. A family's sets come together in a task. It takes pivots, gives each set to the nearest one (its Voronoi
   region) and copies it into those that are farther by no more than the window of the triangle inequality. Large
   regions are cut again in the same way; in small ones all sets are compared, by sketches and then by elements,
   unless links join them already. Where the windows are wider than the regions, as all sets are near each other, the
   whole region is compared in the same way. Families above LEAF_BYTES are cut into pairs of blocks, each a task's work.
   Links go on as a tree, so no number of pairs is ever sent.

Equal sets are one node, so copies make no pairs. Texts stay where they are; only keys are shuffled, and sets of families.

Null and empty texts have no shingles and link with nothing. Texts with fewer words than a shingle are one shingle.
Rows with the same doc_id are one document and share its class; null doc_ids stand as one document before all others.
Ties go to the smaller doc_id. Empty tables give no rows. Only doc_id and text are read.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.llm import chunks as C
from talliard.llm import shingle_sets as S
from talliard.llm.common import parts, small, stored
from talliard.tables import table

SHINGLE = 3
PERCENT = 90
#: Bytes of text whose sets are in memory at once, but for a single text.
BATCH_BYTES = 4 << 20
#: Keys that a task holds before it sends them on.
SEND_KEYS = 1 << 20
#: Members of a group that one task sees; larger groups are cut into pairs of blocks.
GROUP = 4096
#: Bytes of sets that one task sees at once; larger families are cut.
LEAF_BYTES = 24 << 20
#: Pivots of a region, and sets of a region in which all are compared.
PIVOTS, LEAF = 16, 128
#: Bits of a set's digest that its keys carry. Sets that share them are told apart by their numbers from then on.
TAG_BITS = 48
#: Bytes of text of a bucket at most, on average.
BUCKET_BYTES = 16 << 20
_SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("tags", pa.binary()), ("docs", pa.binary()), ("rows", pa.binary()), ("sizes", pa.binary()), ("nodes", pa.binary()), ("sketches", pa.list_(pa.binary()))])
_SENT_DDL = "bucket int, keys binary, tags binary, docs binary, rows binary, sizes binary, nodes binary, sketches array<binary>"
_MET = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sketch", pa.binary()), ("tag", pa.int64()), ("group", pa.int64())])
_MET_DDL = "doc long, row long, n long, node binary, sketch binary, tag long, group long"


def _tags(nodes: bytes, bits: int) -> np.ndarray:
    """A node's first bits; 0 where a text has no set."""
    return np.frombuffer(nodes, np.uint64)[::2] >> np.uint64(64 - bits)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else bytes(16)


def _slices(sizes: list[int], most: int):
    """Runs (from, to) of places with most in all, one place at least."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
    if sizes:
        yield start, len(sizes)


def _describe(buckets: int, shingle: int, percent: int, bits: int):
    """For each document its node and sketch; for each node that is new in the task, its keys, by buckets."""

    def run(batches):
        from pyspark import TaskContext

        known, seen, spread = S.WordHashes(), set(), TaskContext.get().partitionId()
        keys, tags, held = [], [], 0

        def sent():
            k, t = np.concatenate(keys), np.concatenate(tags)
            by_bucket = C.by_target((k % np.uint64(buckets)).astype(np.int64), [k, t])
            return [(b, k.tobytes(), C.planes(t)[: -(-bits // 8) * len(t)], None, None, None, None, None) for b, (k, t) in by_bucket]

        for batch in batches:
            content = batch.column(2)
            for a, z in _slices(pc.binary_length(content).to_pylist(), BATCH_BYTES):
                sets = [S.shingle_set(t, known, shingle) for t in content.slice(a, z - a).to_pylist()]
                nodes = list(map(_digest, sets))
                n = np.array([len(s) for s in sets], np.int64)
                fresh = []
                for k, node in enumerate(nodes):
                    if n[k] and node not in seen:
                        seen.add(node)
                        fresh.append(k)
                sketches = [None] * len(sets)
                for k in fresh:
                    sketches[k] = S.sketch(sets[k], S.width(int(n[k]))).tobytes()
                spread += 1
                rows = [(spread % buckets, None, None, batch.column(0).slice(a, z - a).to_numpy().tobytes(), batch.column(1).slice(a, z - a).to_numpy().tobytes(), n.tobytes(), b"".join(nodes), sketches)]
                if fresh:
                    of, found = S.part_keys(np.concatenate([sets[k] for k in fresh]), n[fresh], percent)
                    keys.append(found)
                    tags.append(_tags(b"".join(nodes[k] for k in fresh), bits)[of])
                    held += len(found)
                if held >= SEND_KEYS:
                    rows += sent()
                    keys, tags, held = [], [], 0
                yield from C.row_table(rows, _SENT).to_batches()
        if held:
            yield from C.row_table(sent(), _SENT).to_batches()

    return run


def _meet(t: pa.Table, bits: int) -> pa.Table:
    """Documents as rows, and the members of groups: keys of two nodes or more, those with the same members as one."""
    out = []
    for docs, rows, sizes, nodes, sketches in zip(*(t[c].to_pylist() for c in ("docs", "rows", "sizes", "nodes", "sketches")), strict=True):
        if docs is not None:
            docs, rows, sizes = (np.frombuffer(x, np.int64) for x in (docs, rows, sizes))
            nodes_of = [nodes[k * 16 : k * 16 + 16] for k in range(len(docs))]
            out.append(pa.Table.from_arrays([pa.array(docs), pa.array(rows), pa.array(sizes), pa.array(nodes_of, pa.binary()), pa.array(sketches, pa.binary()), pa.array(_tags(nodes, bits).view(np.int64)), pa.nulls(len(docs), pa.int64())], schema=_MET))
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(k, np.uint64) for k in t["keys"].to_pylist() if k)])
    tags = np.concatenate([np.zeros(0, np.uint64), *(C.from_planes(k + bytes(len(k) // -(-bits // 8) * (8 - -(-bits // 8))), "u8") for k in t["tags"].to_pylist() if k)])
    order = np.lexsort((tags, keys))
    keys, tags = keys[order], tags[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (tags[1:] != tags[:-1])))[: len(keys)]
    keys, tags = keys[new], tags[new]
    if len(keys):
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.concatenate((first, [len(keys)])))
        group = np.add.reduceat(C.mixed(tags + np.uint64(1)), first) ^ C.mixed(size.astype(np.uint64))
        one = np.zeros(len(first), bool)
        one[np.unique(group, return_index=True)[1]] = True
        use = np.repeat(one & (size > 1), size)
        k = int(use.sum())
        out.append(pa.Table.from_arrays([*(pa.nulls(k, f.type) for f in list(_MET)[:5]), pa.array(tags[use].view(np.int64)), pa.array(np.repeat(group, size)[use].view(np.int64))], schema=_MET))
    return pa.concat_tables(out) if out else _MET.empty_table()


def _balls(percent: int):
    """Edges (a, b) that hold the members of each ball together, and balls that share members: fewer than members seen."""

    def run(t: pa.Table) -> pa.Table:
        group, sketches = t["group"].to_numpy(), t["sketch"].to_pylist()
        tags, node = np.unique(t["id"].to_numpy(), return_inverse=True)
        n, joined = t["n"].to_numpy(), list(range(len(tags)))
        order = np.argsort(group, kind="stable")

        def root(x: int) -> int:
            while joined[x] != x:
                joined[x] = x = joined[joined[x]]
            return x

        for members in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            bits = S.width(int(n[members].min()))
            held = np.stack([S.folded(np.frombuffer(sketches[k], np.uint64), bits) for k in members])
            most = S.most_apart(n[members], percent)
            rest = np.arange(len(members))
            while len(rest) > 1:
                far = S.apart(held[rest[0]], held[rest])
                reach = far[far <= most[rest]].max() + most[rest].max()
                ball = node[members[rest[far <= reach]]].tolist()
                first = root(ball[0])
                for x in ball[1:]:
                    joined[root(x)] = first
                rest = rest[far > most[rest]]
        # to the least member, which other tasks that see the same family mostly find too, so that their edges are equal
        roots = np.array([root(x) for x in range(len(tags))], np.int64)
        least = np.full(len(tags), len(tags))
        np.minimum.at(least, roots, np.arange(len(tags)))
        least = least[roots]
        use = least != np.arange(len(tags))
        return pa.table({"a": pa.array(tags[least[use]], pa.int64()), "b": pa.array(tags[use], pa.int64())})

    return run


def _sets(shingle: int):
    """(id, cells, elements) of the nodes that rows of texts are wanted for, each once in a task; a row's hash may be another text's too."""

    def run(batches):
        known, seen = S.WordHashes(), set()
        for batch in batches:
            content = batch.column(0)
            for a, z in _slices(pc.binary_length(content).to_pylist(), BATCH_BYTES):
                found = {}
                for k, text in enumerate(content.slice(a, z - a).to_pylist(), a):
                    s = S.shingle_set(text, known, shingle)
                    node = batch.column(2)[k].as_py()
                    if node not in seen and _digest(s) == node:
                        seen.add(node)
                        found[k] = s
                at = pa.array(list(found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(3).take(at), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["id", "cells", "elements"])

    return run


def region_classes(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[np.ndarray]:
    """Places of the sets of each class of two or more, by Voronoi regions around pivots, cut again until they are small.

    side: sets of the same side are not compared, as another region does it.
    """
    n = np.array([len(s) for s in sets], np.int64)
    bits = S.width(int(n.max()))
    sketches = np.stack([S.sketch(s, bits) for s in sets])
    most, label = S.most_apart(n, percent), np.arange(len(sets))

    def compare(places: np.ndarray, home: np.ndarray) -> None:
        """Each set at home with those behind it: others at home first, then those in the window."""
        ordered = np.concatenate((places[home], places[~home]))
        for k in range(min(int(home.sum()), len(ordered) - 1)):
            x, others = ordered[k], ordered[k + 1 :]
            others = others[label[others] != label[x]]
            if side is not None:
                others = others[side[others] != side[x]]
            far = S.apart(sketches[x], sketches[others])
            near = far * (100 + percent) <= (n[x] + n[others]) * (100 - percent)
            others = others[near][np.argsort(far[near], kind="stable")]
            while len(others):
                if S.linked(sets[x], sets[others[0]], percent):
                    label[label == label[others[0]]] = label[x]
                    others = others[label[others] != label[x]]
                else:
                    others = others[1:]

    def part(places: np.ndarray, home: np.ndarray) -> None:
        if len(places) > LEAF:
            pivots = places[np.linspace(0, len(places) - 1, PIVOTS).astype(np.int64)]
            far = np.stack([S.apart(sketches[p], sketches[places]) for p in pivots])
            nearest, inside = far.argmin(0), far <= far.min(0) + 2 * most[places]
            if inside.sum() < len(places) * PIVOTS / 2:  # else the windows are wider than the regions
                for k in range(PIVOTS):
                    if (own := home & (nearest == k)).any():
                        part(places[inside[k]], own[inside[k]])
                return
        compare(places, home)

    part(np.arange(len(sets)), np.ones(len(sets), bool))
    order = np.argsort(label, kind="stable")
    return [c for c in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(c) > 1]


def _join(percent: int):
    """Links (a, b) within each region (cell), as trees; side tells the two blocks of a pair apart."""

    def run(t: pa.Table) -> pa.Table:
        cells, tags, side, elements = t["cell"].to_numpy(), t["id"].to_numpy(), t["side"].to_numpy(), t["elements"].to_pylist()
        order = np.lexsort((tags, cells))
        cells, tags = cells[order], tags[order]
        cuts = np.flatnonzero(np.diff(cells)) + 1
        links = []
        for places in np.split(np.arange(len(cells)), cuts):
            places = places[np.concatenate(([True], tags[places][1:] != tags[places][:-1]))]
            sides = side[order[places]]
            found = region_classes([np.frombuffer(elements[k], np.uint64) for k in order[places]], percent, sides if sides.any() else None)
            for members in found:
                links += S.tree(tags[places[members]])
        return pa.table({"a": pa.array([e[0] for e in links], pa.int64()), "b": pa.array([e[1] for e in links], pa.int64())})

    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, least): nodes with the least value that links (a, b) reach, by rounds of least neighbours and jumps."""
    links = stored(links.unionByName(links.select(F.col("a").alias("b"), F.col("b").alias("a"))).distinct())
    state = stored(nodes.select("node", "least"))
    while True:
        near = links.join(state, links.b == state.node).groupBy("a").agg(F.min("least").alias("near"))
        moved = stored(state.join(near, state.node == near.a, "left").select("node", F.least("least", "near").alias("least"), (F.col("near") < F.col("least")).alias("moved")))
        if not moved.where("moved").head(1):
            return state
        old = state.select(F.col("node").alias("via"), F.col("least").alias("from"))
        jump = moved.select(F.col("node").alias("via"), F.col("least").alias("to")).join(old, "via").groupBy("from").agg(F.min("to").alias("to"))
        state = stored(moved.join(jump, moved.least == jump["from"], "left").select("node", F.least("least", "to").alias("least")))


def _families(members: DataFrame, nodes: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(id, family) of the nodes that may have a partner. Members come by tag; nodes that share one are a group besides."""
    twins = nodes.groupBy("tag").agg(F.count("*").alias("c")).where("c > 1")
    members = members.distinct().unionByName(twins.select(F.xxhash64(F.lit("twins"), "tag").alias("group"), "tag"))
    size = members.groupBy("group").agg(F.count("*").alias("size"))
    large = stored(size.where(F.col("size") > GROUP))
    block = members.join(small(large), "group", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / GROUP), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("tag"), F.col("blocks"))
    cut = block.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn(
        "group", F.when(F.col("blocks") == 1, F.col("group")).otherwise(F.xxhash64("group", F.least(own, "other"), F.greatest(own, "other")))
    )
    described = cut.select("group", "tag").join(nodes.select("tag", "id", "n", "sketch"), "tag").drop("tag")
    edges = stored(described.groupBy(F.pmod("group", F.lit(4 * buckets)).alias("bucket")).applyInArrow(lambda t: _balls(percent)(t), "a long, b long").distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("least", F.col("node"))
    return components(ends, edges).select(F.col("node").alias("id"), F.col("least").alias("family"))


def _cells(families: DataFrame) -> DataFrame:
    """families (row, id, node, family, n) with cell and side, a row for each task that sees the node."""
    sizes = families.groupBy("family").agg(F.sum("n").alias("elements"))
    large = small(stored(sizes.where(F.col("elements") * 8 > LEAF_BYTES)))
    block = families.join(large, "family", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("elements") * 16 / LEAF_BYTES), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    other = block.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cell = F.when(F.col("blocks") == 1, F.col("family")).otherwise(F.xxhash64("family", F.least(own, "other"), F.greatest(own, "other")))
    # the pair of a block with itself compares all within, other pairs only what is of different blocks
    side = F.when(own == F.col("other"), 0).when(own < F.col("other"), 1).otherwise(2)
    return other.select("row", "id", "node", cell.alias("cell"), side.alias("side"))


def _linked(docs: DataFrame, text: str, shingle: int, percent: int, label) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (doc, row, n, node), and (node, least) of the nodes with links or several rows; label: of a row's node at."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID)).alias("doc"), F.xxhash64("doc_id", text).alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))
    buckets, bits = max(parts(docs.sparkSession), -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BUCKET_BYTES)), TAG_BITS
    met = stored(rows.mapInArrow(_describe(buckets, shingle, percent, bits), _SENT_DDL).groupBy("bucket").applyInArrow(lambda t: _meet(t, bits), _MET_DDL))
    described = met.where("group is null").select("doc", "row", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"), "tag", "sketch")
    one = described.where("n > 0").groupBy("node").agg(F.min(F.struct("doc", "row")).alias("at"), F.count("*").alias("rows"), F.first("tag").alias("tag"), F.first("n").alias("n"), F.max("sketch").alias("sketch"))
    nodes = stored(one.select(F.monotonically_increasing_id().alias("id"), "node", "tag", "n", "sketch", "rows", label.alias("least"), "at.row"))
    families = _families(met.where("group is not null").select("group", "tag"), nodes, percent, buckets)
    placed = stored(families.join(nodes.select("id", "node", "n", "row"), "id"))
    wanted = stored(_cells(placed).groupBy("row", "id", "node").agg(F.collect_set(F.struct("cell", "side")).alias("cells")))
    sets = rows.join(small(wanted), "row").select("content", "id", "node", "cells").mapInArrow(_sets(shingle), "id long, cells array<struct<cell:bigint,side:int>>, elements binary")
    held = sets.select("id", F.explode("cells").alias("c"), "elements").select("id", "c.*", "elements").groupBy(F.pmod(F.xxhash64("cell"), F.lit(4 * buckets)).alias("bucket"))
    links = stored(held.applyInArrow(lambda t: _join(percent)(t), "a long, b long"))
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "least"), "id")
    state = components(ends.select(F.col("id").alias("node"), "least"), links).select(F.col("node").alias("id"), F.col("least").alias("reached"))
    joined = nodes.select("node", "id", "least", "rows").join(state, "id", "left").where("rows > 1 or reached is not null")
    return described.select("doc", "row", "n", "node"), stored(joined.select("node", F.coalesce("reached", "least").alias("least")))


def classes(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach."""
    described, least = _linked(docs, text, shingle, percent, F.col("at.doc"))
    found = described.join(small(least), "node", "left").select("doc", "n", F.coalesce("least", "doc").alias("least"))
    # where a doc_id comes with several sets, they are one document
    several = described.where("node is not null").groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    if several.head(1):
        found = stored(found)
        ends = found.select(F.col("doc").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        ids = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("least", F.col("node"))
        whole = components(ids, ends).select(F.col("node").alias("doc"), F.col("least").alias("whole"))
        found = found.join(small(whole), "doc", "left").select("doc", "n", F.coalesce("whole", "least").alias("least"))
    return found.select(F.when(F.col("doc") != C.NO_ID, F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("least") != C.NO_ID, F.col("least")).alias("component_id"))


def first_rows(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each class of texts, the first by (doc_id, row), and all without a set; equal ids join nothing."""
    described, least = _linked(docs, text, shingle, percent, F.struct("at.doc", "at.row"))
    key = ["_doc", "_row"]
    named = lambda df: df.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"))
    later = described.join(small(least), "node").where("doc <> least.doc or row <> least.row")
    keyed = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID)), "_row": F.xxhash64("doc_id", text)})
    kept = keyed.join(small(stored(named(later).distinct())), key, "left_anti")
    repeated = stored(named(described.where("n > 0").groupBy("doc", "row").agg(F.count("*").alias("c")).where("c > 1")))
    if repeated.head(1):
        one = kept.join(small(repeated), key, "left_semi").groupBy(*key).agg(F.min(F.struct(*docs.columns)).alias("_one"))
        return kept.join(small(repeated), key, "left_anti").select(*docs.columns).unionByName(one.select("_one.*"))
    return kept.select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
