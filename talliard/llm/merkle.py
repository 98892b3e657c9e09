"""Merkle manifest of a dataset: a hash tree over the rows of each group, one over the groups, and a proof for each row.

A row's leaf is the hash of its fields, each told apart by its length. A group's leaves stand in ascending order of the key;
while several nodes remain, every FANOUT consecutive ones become the hash of their hexadecimal digests. What remains is
the group's subroot, and subroots in the order of their groups make the root in the same way.

1. Leaves are hashed where the rows lie; from here on texts are no longer carried.
2. Leaves are sorted by ranges of (group, key). Each partition numbers its rows within their groups; the counts of the
   partitions before give what to add for the one group that goes on from an earlier partition, so each row has its place.
3. Each task builds the aligned subtrees of BLOCK leaves that lie in it as a whole. Ragged ends are shuffled by their
   coordinate (group, block) and put together, so a group of any size is dealt over all tasks and no more than BLOCK leaves meet.
4. Roots of blocks are grouped by coordinate, BLOCK at a time, until each group has one node: logarithmically many rounds,
   each on BLOCK times fewer rows. On the way back each node gets its path to the root, and blocks hand proofs to their rows.

Null keys stand before all others. Rows with equal keys are ordered by their leaves; equal rows are leaves of their own, with
equal leaf and different proofs. Null groups are a group before all others. Null fields are told apart from empty ones. An empty table
has no root and gives no rows. A text is only hashed, so its length matters for nothing else. Only the named columns are
read; others may have any name.
"""

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from talliard.llm.common import stored
from talliard.llm.ranks import placed
from talliard.tables import table

FANOUT = 16
#: Levels and leaves of a block.
HEIGHT = 2
BLOCK = FANOUT**HEIGHT
#: Blocks whose trees a task has in memory.
AT_ONCE = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of the key's crc32, so that the query tampers with one row in TAMPERED.
TAMPERED = 5


class Manifest(NamedTuple):
    """blocks: (grp, block, keys, leaves, others); paths: (grp, block, path, subroot); root: lowercase hex, None for an empty table."""

    blocks: DataFrame
    paths: DataFrame
    root: str | None


def leaf(values: list[Column]) -> Column:
    """The hash of a row's fields: "-" for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(block: int, size: int) -> int:
    """Levels above a block's leaves: all of them unless the block is the only one of its group."""
    if block or size == BLOCK:
        return HEIGHT
    return next(k for k in range(HEIGHT + 1) if FANOUT**k >= size)


def _tree(leaves: list[str], levels: int) -> list[list[str]]:
    """All levels of nodes, from the leaves up."""
    found = [leaves]
    for _ in range(levels):
        below = found[-1]
        found.append([_hash(below[k : k + FANOUT]) for k in range(0, len(below), FANOUT)])
    return found


def _path(tree: list[list[str]], place: int) -> list[str]:
    """A leaf's siblings to the left and to the right, level by level, joined."""
    path = []
    for nodes in tree[:-1]:
        first = place - place % FANOUT
        path += ["".join(nodes[first:place]), "".join(nodes[place + 1 : first + FANOUT])]
        place //= FANOUT
    return path


def folded(node: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for k in range(0, len(path), 2):
        node = _hash([path[k], node, path[k + 1]])
    return node


def _pieces(schema: pa.Schema):
    """Runs of consecutive leaves of a block, as one row each; a run that ends with its batch waits for the next one."""

    def run(batches):
        import numpy as np

        held = None
        out = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("at", pa.int64()), *((f.name, pa.list_(f.type)) for f in schema)])

        def made(t: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            at = pa.array(cuts[:-1])
            pos = t["pos"].take(at).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), _flat(t[f.name]).cast(f.type)) for f in schema]
            return pa.RecordBatch.from_arrays([_flat(t["grp"].take(at)), pa.array(pos.to_numpy() // BLOCK, pa.int64()), _flat(pos), *lists], schema=out)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            held = None
            if not t.num_rows:
                continue
            pos, grp = t["pos"].to_numpy(), _flat(t["grp"].combine_chunks()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(pos) != 1) | (np.diff(grp) != 0) | (pos[1:] % BLOCK == 0)) + 1
            cuts = np.concatenate(([0], cuts))
            held = t.slice(int(cuts[-1]))
            if len(cuts) > 1:
                yield made(t.slice(0, int(cuts[-1])), cuts)
        if held is not None and held.num_rows:
            yield made(held, np.array([0, held.num_rows]))

    return run


def _flat(a) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _blocks(placed: DataFrame) -> DataFrame:
    """(grp, block, keys, leaves, others): a row for each block of BLOCK leaves or the last ones of a group."""
    fields = placed.select("key", "leaf", "other").schema
    schema = to_arrow_schema(fields)
    ddl = "grp string, block long, at long, " + ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in fields)
    pieces = stored(placed.select("grp", "pos", "key", "leaf", "other").mapInArrow(_pieces(schema), ddl))
    whole = pieces.where(F.size("leaf") == BLOCK)
    ragged = pieces.where(F.size("leaf") < BLOCK).groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("at", "key", "leaf", "other"))).alias("m"))
    joined = ragged.select("grp", "block", *(F.flatten(F.col(f"m.{c}")).alias(c) for c in ("key", "leaf", "other")))
    return stored(whole.select("grp", "block", "key", "leaf", "other").unionByName(joined))


def _slices(batches):
    """A few blocks at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(k, AT_ONCE)


def _grown(block: int, leaves: list[bytes]) -> list[list[str]]:
    return _tree([x.hex() for x in leaves], _levels(block, len(leaves)))


def _roots(batches):
    for batch in _slices(batches):
        nodes = [_grown(block, leaves)[-1][0] for block, leaves in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.string())], ["grp", "pos", "node"])


def _climbed(batches):
    """For each block of nodes its root, and the nodes' paths to it."""
    for batch in _slices(batches):
        roots, paths = [], []
        for block, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            tree = _tree(nodes, _levels(block, len(nodes)))
            roots.append(tree[-1][0])
            paths.append([_path(tree, k) for k in range(len(nodes))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.string()), pa.array(paths, pa.list_(pa.list_(pa.string())))], ["grp", "pos", "node", "paths"])


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes (grp, pos, node): (grp, node), the root of each group; and (grp, pos, path), each node's siblings on the way."""
    rounds = []
    while nodes.where("pos > 0").head(1):
        met = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("m"))
        made = stored(met.select("grp", "block", "m.node").mapInArrow(_climbed, "grp string, pos long, node string, paths array<array<string>>"))
        rounds.append(made.select("grp", F.col("pos").alias("parent"), "paths"))
        nodes = made.select("grp", "pos", "node")
    none = F.array().cast("array<string>")
    paths = nodes.select("grp", "pos", none.alias("path"))
    for made in reversed(rounds):
        below = made.join(paths.withColumnRenamed("pos", "parent"), ["grp", "parent"])
        below = below.select("grp", "parent", "path", F.posexplode("paths").alias("k", "own"))
        paths = stored(below.select("grp", (F.col("parent") * BLOCK + F.col("k")).alias("pos"), F.concat("own", "path").alias("path")))
    return nodes.select("grp", "node"), paths


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> Manifest:
    """The tree over docs. changed: other values of some fields, whose leaves are kept as others for a check; null where they are the same."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    first = leaf([q(f) for f in fields])
    other = leaf([(changed or {}).get(f, q(f)) for f in fields]) if changed else F.lit(None).cast("string")
    # groups in the order of their bytes, null first
    grp = F.coalesce(F.concat(F.lit("="), q(group).cast("string")), F.lit(""))
    leaves = stored(docs.select(grp.alias("grp"), q(key).alias("key"), F.unhex(first).alias("leaf"), F.unhex(other).alias("other")))
    blocks = _blocks(placed(leaves, F.asc_nulls_first("key"), F.asc("leaf")))
    roots = stored(blocks.select("grp", "block", "leaf").mapInArrow(_roots, "grp string, pos long, node string"))
    subroots, within = _climb(roots)
    named = stored(placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), F.asc("name")))
    tops, above = _climb(named.select("grp", "pos", "node"))
    root = tops.head(1)
    sources = named.select("name", "pos", F.col("node").alias("subroot")).join(above.select("pos", F.col("path").alias("above")), "pos").drop("pos")
    paths = within.join(sources, within.grp == sources.name).select("grp", F.col("pos").alias("block"), F.concat("path", "above").alias("path"), "subroot")
    return Manifest(blocks, paths, root[0].node if root else None)


def _proofs(root: str | None, digest: bool):
    """Rows of blocks, with the siblings on the way to the root or a digest of them and the root that the other leaf leads to."""

    def run(batches):
        for batch in _slices(batches):
            block, keys, leaves, others, above, subroot = (batch.column(k) for k in range(6))
            first, of, out = [], [], []
            for n, (b, own, other, path) in enumerate(zip(block.to_pylist(), leaves.to_pylist(), others.to_pylist(), above.to_pylist(), strict=True)):
                tree = _grown(b, own)
                first += tree[0]
                of += [n] * len(own)
                for k, node in enumerate(tree[0]):
                    proof = _path(tree, k) + path
                    out.append((_hash(proof), folded(other[k].hex() if other[k] else node, proof)) if digest else proof)
            columns = [keys.flatten(), pa.array(first, pa.string()), subroot.take(pa.array(of, pa.int64())), pa.array([root] * len(of), pa.string())]
            if digest:
                proof, led = zip(*out, strict=True) if out else ((), ())
                columns += [pa.array(proof, pa.string()), pa.array(led, pa.string()), pa.array([x == root for x in led], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.string()))], ["key", "leaf", "subroot", "root", "proof"])

    return run


def proofs(m: Manifest, digest: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof): proof is the joined siblings left and right of each node on the way up.

    digest: instead of the siblings their hash, and what the other leaf (else the row's own) leads to with them.
    """
    kind = m.blocks.schema["key"].dataType.elementType.simpleString()
    more = "proof_sha256 string, folded_root string, verified boolean" if digest else "proof array<string>"
    whole = m.blocks.join(m.paths, ["grp", "block"]).select("block", "key", "leaf", "other", "path", "subroot")
    return whole.mapInArrow(_proofs(m.root, digest), f"key {kind}, leaf string, subroot string, root string, {more}")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = manifest(docs, changed={"text": F.when(tampered, lower).otherwise(F.col("text"))})
    return proofs(made, digest=True).withColumnRenamed("key", "doc_id")
