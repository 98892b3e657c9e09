"""Whole texts in bounded chunks, and the exchange of packed arrays between chunks and buckets.

Both repeat finders work alike: texts are dealt once by a hash into chunks of a few megabytes. Chunks send keys to
buckets, which send back to each chunk only those of its keys that others have too; from what lies at such keys,
chunks send the full evidence to buckets, which answer with places. Keys are sent once a chunk, however many of its
documents hold them, so a passage that very many documents share costs one entry a chunk. The texts' shuffle is read
again in each step, not written again. Numbers travel as packed arrays, a row for each chunk and bucket.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliard.llm.common import parts

#: Bytes of text that a chunk has on average.
CHUNK_BYTES = 4 << 20
#: Stands for a null doc_id, before all others.
NO_ID = -(1 << 63)


def in_chunks(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """(doc, content, row, chunk) and the number of chunks, from one sum over the texts; row is the same for equal rows."""
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(2 * parts(docs.sparkSession), -(-n_bytes // CHUNK_BYTES))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"),
        F.xxhash64("doc_id", text).alias("row"),
    ).withColumn("chunk", F.pmod("row", F.lit(n)).cast("int"))
    return rows.repartition(parts(docs.sparkSession), "chunk"), n


class Chunk:
    """A chunk's documents in the order of their rows, and their bytes in one array."""

    def __init__(self, table: pa.Table):
        order = np.lexsort((table["doc"].to_numpy(), table["row"].to_numpy()))
        self.docs = table["doc"].to_numpy()[order]
        content = table["content"].to_pylist()
        self.texts = [content[k] for k in order]
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)

    def document_of(self, places: np.ndarray) -> np.ndarray:
        """The document's number in the chunk for places in the bytes."""
        return np.searchsorted(self.ends, places, side="right")


def mixed(h: np.ndarray) -> np.ndarray:
    """Numbers with their bits mixed, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed numbers that look random."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))


def planes(a: np.ndarray) -> bytes:
    """An array's bytes by significance, so that the empty high ones compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def short(keys: np.ndarray) -> np.ndarray:
    """The first 48 bits of keys. Where two keys share these by chance, more is sent and compared, nothing is lost."""
    return keys >> np.uint64(16)


def packed(keys: np.ndarray) -> bytes:
    """Short keys in six bytes each."""
    return planes(keys)[: 6 * len(keys)]


def unpacked(data: bytes) -> np.ndarray:
    return from_planes(data + bytes(len(data) // 3), "u8")


def by_target(target: np.ndarray, arrays: list[np.ndarray]):
    """(target, its part of each array), in order; within a target the order stays."""
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    if len(target):
        for part in np.split(order, cuts):
            yield int(target[part[0]]), [a[part] for a in arrays]


def row_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


KEYS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("flags", pa.binary())])
KEYS_DDL = "bucket int, chunk int, keys binary, flags binary"
LIVE = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("flags", pa.binary())])
LIVE_DDL = "chunk int, keys binary, flags binary"


def keys_to_buckets(chunk: int, n: int, keys: np.ndarray, docs: np.ndarray, flags: np.ndarray) -> pa.Table:
    """The chunk's distinct keys, each once; flags of equal keys together, and bit 1 where two documents hold the key."""
    keys = short(keys)
    order = np.lexsort((docs, keys))
    keys, docs, flags = keys[order], docs[order], flags[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    last = np.concatenate((first[1:], [len(keys)])) - 1 if len(keys) else first
    together = np.bitwise_or.reduceat(flags, first) if len(keys) else flags
    together = together | np.where(docs[first] != docs[last], 2, 0).astype(np.uint8)
    target = (keys[first] % np.uint64(n)).astype(np.int64)
    return row_table([(b, chunk, packed(k), f.tobytes()) for b, (k, f) in by_target(target, [keys[first], together])], KEYS)


def live_keys(table: pa.Table, many: int, needs: int = 0) -> pa.Table:
    """For each chunk, its keys in a bucket that two documents hold and some chunk flags with needs; flag 4 marks keys of many chunks."""
    chunks = table["chunk"].to_numpy()
    keys = [unpacked(k) for k in table["keys"].to_pylist()]
    flags = np.concatenate([np.frombuffer(f, np.uint8) for f in table["flags"].to_pylist()])
    of = np.repeat(chunks, [len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
    counts = np.diff(np.concatenate((first, [len(keys)])))
    together = np.bitwise_or.reduceat(flags[order], first)
    live = ((counts > 1) | (together & 2 > 0)) & (together & needs == needs)
    out = np.zeros(len(keys), np.uint8)
    out[order] = np.repeat(np.where(live, 1 | np.where(counts >= many, 4, 0), 0), counts)
    at = np.flatnonzero(out)
    return row_table([(c, packed(k), f.tobytes()) for c, (k, f) in by_target(of[at], [keys[at], out[at]])], LIVE)


def sorted_live(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's live keys in order, with their flags."""
    keys = np.concatenate([np.zeros(0, np.uint64), *map(unpacked, table["keys"].to_pylist())])
    flags = np.frombuffer(b"".join(table["flags"].to_pylist()), np.uint8)
    order = np.argsort(keys)
    return keys[order], flags[order]


def looked_up(keys: np.ndarray, live: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Flags of keys, 0 where they are not live."""
    if not len(live):
        return np.zeros(len(keys), np.uint8)
    keys = short(keys)
    at = np.minimum(np.searchsorted(live, keys), len(live) - 1)
    return np.where(live[at] == keys, flags[at], 0).astype(np.uint8)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at places in any of the spans."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def digest(data: bytes) -> np.ndarray:
    """Two numbers that stand for a whole text."""
    import hashlib

    return np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.uint64)


SPANS = pa.schema([("chunk", pa.int32()), ("starts", pa.binary()), ("ends", pa.binary())])
SPANS_DDL = "chunk int, starts binary, ends binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
RESULT_DDL = "doc_id long, n long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary"


def results(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, removed: np.ndarray, kept) -> pa.Table:
    """A row for each document: its size, what is removed, the maximal runs, and kept(document, mask of what stays)."""
    edge = np.concatenate(([0], removed.astype(np.int8), [0]))
    edge = np.diff(edge)
    left, right = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    rows = []
    for k, (doc, a, b) in enumerate(zip(docs.tolist(), starts.tolist(), ends.tolist(), strict=True)):
        i, j = np.searchsorted(right, a, side="right"), np.searchsorted(left, b, side="left")
        spans = [{"start": max(int(x), a) - a, "end": min(int(y), b) - a} for x, y in zip(left[i:j], right[i:j], strict=True)] if a < b else []
        rows.append((None if doc == NO_ID else doc, b - a, sum(s["end"] - s["start"] for s in spans), spans, kept(k, ~removed[a:b]) if spans else kept(k, None)))
    return row_table(rows, RESULT)
