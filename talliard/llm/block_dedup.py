"""Substring dedup over words by fixed-block anchors, extended to maximal exact repeats.

A word goes if LENGTH consecutive words cover it that also start in a document with a smaller doc_id. Every document
is a reference: it is cut into non-overlapping blocks of BLOCK words, which are indexed by hash. Any window of LENGTH
words of a reference holds SPAN whole blocks in a row, wherever it starts; of these the one with the least hash is its
anchor, so only blocks that are such an anchor need an entry. Every rolling window of every document probes: for each
of the BLOCK ways in which a reference's blocks may lie in it, it takes the least hash of the SPAN blocks, which is the
anchor that an equal window of a reference has. Blocks and probes meet in an exchange of hashes; each chunk gets back
those of its hashes that are indexed and held by another document too.

Around such hits all windows are compared exactly (by 128-bit hashes of all their words) with those of all other
documents, the least doc_id of each window is found, and windows of later documents go; windows side by side make up
the maximal repeats. A window that a smaller document of the same chunk has too goes without being sent, so a passage
that very many documents share costs one entry a chunk.

Null and empty texts have no words. Documents with the same doc_id do not remove each other's text; nulls come
first. Overlaps count; what goes is judged on the input. Empty tables give no rows. Only doc_id and text are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.llm import chunks as C
from talliard.tables import table

LENGTH = 50
BLOCK = 5
#: Whole blocks in a row that any window has.
SPAN = (LENGTH - BLOCK + 1) // BLOCK
#: Flag of keys that are some document's own blocks.
OWN = 1

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = [C.numbers(5, 256), C.numbers(6, 256)]
_FACTOR = [int(C.numbers(7, 1)[0]) & ~7 | 5, int(C.numbers(8, 1)[0]) & ~7 | 5]


class Words:
    """The words of a chunk: their places in the bytes, documents' first and last, and hashes of runs of words."""

    def __init__(self, chunk: C.Chunk):
        self.chunk, b = chunk, chunk.bytes
        word = ~_WHITE[b]
        new = word & np.concatenate(([True], ~word[:-1])) if len(b) else word
        if len(b):
            edges = chunk.starts[(chunk.starts < len(b)) & (chunk.ends > chunk.starts)]
            new[edges] = word[edges]
        self.begin = np.flatnonzero(new)
        of = chunk.document_of(self.begin)
        counts = np.bincount(of, minlength=len(chunk.docs))
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.document = of
        after = np.concatenate((self.begin[1:], [len(b)])) if len(self.begin) else self.begin
        at = np.arange(len(b)) - np.repeat(self.begin, np.diff(np.concatenate((self.begin, [len(b)])))) if len(self.begin) and self.begin[0] == 0 else None
        if at is None and len(self.begin):
            at = np.concatenate((np.zeros(self.begin[0], np.int64), np.arange(self.begin[0], len(b)) - np.repeat(self.begin, after - self.begin)))
        self.sums = []
        self.size = np.add.reduceat(word, self.begin, dtype=np.int64) if len(self.begin) else self.begin
        for seed in (0, 1):
            if not len(self.begin):
                self.sums.append(np.zeros(1, np.uint64))
                continue
            factor = C.numbers(9 + seed, int(at.max()) + 1)[at]
            value = np.where(word, _BYTES[seed][b] * factor, np.uint64(0))
            hashes = C.mixed(np.add.reduceat(value, self.begin) + self.size.astype(np.uint64))
            up = np.full(len(hashes), _FACTOR[seed], np.uint64)
            up[0] = 1
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(up), dtype=np.uint64))))

    def runs(self, seed: int, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of length words from each start."""
        down = np.full(len(self.sums[seed]), pow(_FACTOR[seed], -1, 1 << 64), np.uint64)
        down[0] = 1
        s = self.sums[seed]
        return C.mixed((s[starts + length] - s[starts]) * np.cumprod(down)[starts])

    def inside(self, length: int) -> np.ndarray:
        """Starts of all runs of length words within a document of LENGTH words or more."""
        steps = np.zeros(len(self.begin) + 1, np.int64)
        long = self.ends - self.starts >= LENGTH
        np.add.at(steps, self.starts[long], 1)
        np.add.at(steps, self.ends[long] - length + 1, -1)
        return np.flatnonzero(np.cumsum(steps[:-1]))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash): for each place where SPAN blocks lie within a document, the least hash of these blocks."""
        starts = self.inside(SPAN * BLOCK)
        n = len(self.begin) - BLOCK + 1
        if not len(starts) or n <= 0:
            return starts[:0], np.zeros(0, np.uint64)
        h = self.runs(0, np.arange(n), BLOCK)
        least, done = h, 1
        while done < SPAN:
            by = min(done, SPAN - done)
            least, done = np.minimum(least[: len(least) - by * BLOCK], least[by * BLOCK :]), done + by
        return starts, least[starts]


def _send_keys(n: int):
    def run(table: pa.Table) -> pa.Table:
        chunk, number = C.Chunk(table), table["chunk"][0].as_py()
        words = Words(chunk)
        at, keys = words.anchors()
        of = words.document[at]
        new = np.concatenate(([True], (keys[BLOCK:] != keys[:-BLOCK]) | (of[BLOCK:] != of[:-BLOCK]))) if len(keys) > BLOCK else np.ones(len(keys), bool)
        new = np.concatenate((np.ones(len(keys) - len(new), bool), new))
        own = ((at - words.starts[of]) % BLOCK == 0).astype(np.uint8) * OWN
        keep = new | (own > 0)
        return C.keys_to_buckets(number, n, keys[keep], chunk.docs[of[keep]], own[keep])

    return run


WINDOWS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("gone", pa.binary())])
WINDOWS_DDL = "bucket int, chunk int, keys binary, more binary, docs binary, places binary, gone binary"


def _least(keys: np.ndarray, more: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window, the least document that holds an equal one."""
    order = np.lexsort((docs, more, keys))
    keys, more, least = keys[order], more[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1]))))
    out = np.empty_like(docs)
    out[order] = np.repeat(least[first], np.diff(np.concatenate((first, [len(keys)]))))
    return out


def _send_windows(n: int):
    def run(table: pa.Table, live: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.row_table([], WINDOWS)
        chunk, number = C.Chunk(table), table["chunk"][0].as_py()
        words = Words(chunk)
        at, keys = words.anchors()
        hit = np.zeros(len(words.begin) + BLOCK, bool)
        hit[at] = C.looked_up(keys, *C.sorted_live(live)) > 0
        windows = words.inside(LENGTH)
        windows = windows[np.logical_or.reduce([hit[windows + o] for o in range(BLOCK)])]
        if not len(windows):
            return C.row_table([], WINDOWS)
        keys, more = words.runs(0, windows, LENGTH), words.runs(1, windows, LENGTH)
        docs = chunk.docs[words.document[windows]]
        gone = docs > _least(keys, more, docs)
        rows = []
        if gone.any():
            rows.append((number % n, number, b"", b"", b"", b"", C.planes(windows[gone].astype(np.uint32))))
        keys, more, docs, windows = keys[~gone], more[~gone], docs[~gone], windows[~gone].astype(np.uint32)
        for bucket, (k, m, d, w) in C.by_target((keys % np.uint64(n)).astype(np.int64), [keys, more, docs, windows]):
            rows.append((bucket, number, k.tobytes(), m.tobytes(), C.planes(d), C.planes(w), b""))
        return C.row_table(rows, WINDOWS)

    return run


_GONE = pa.schema([("chunk", pa.int32()), ("places", pa.binary())])
_GONE_DDL = "chunk int, places binary"


def _judge(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    out = [(r["chunk"], r["gone"]) for r in rows if r["gone"]]
    rows = [r for r in rows if r["keys"]]
    if rows:
        keys, more = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in ("keys", "more"))
        docs = np.concatenate([C.from_planes(r["docs"], "i8") for r in rows])
        places = np.concatenate([C.from_planes(r["places"], "u4") for r in rows])
        of = np.repeat([r["chunk"] for r in rows], [len(r["keys"]) // 8 for r in rows])
        gone = docs > _least(keys, more, docs)
        out += [(c, C.planes(np.sort(p))) for c, (p,) in C.by_target(of[gone], [places[gone]])]
    return C.row_table(out, _GONE)


def _apply(table: pa.Table, gone: pa.Table) -> pa.Table:
    if not table.num_rows:
        return C.row_table([], C.RESULT)
    chunk = C.Chunk(table)
    words = Words(chunk)
    places = np.concatenate([np.zeros(0, np.uint32), *(C.from_planes(x, "u4") for x in gone["places"].to_pylist())]).astype(np.int64)
    removed = C.covered(len(words.begin), places, places + LENGTH)

    def kept(k, mask):
        found = np.array(chunk.texts[k].split(), object)  # splits at the same bytes as the words' pattern
        return b" ".join(found if mask is None else found[mask])

    return C.results(chunk.docs, words.starts, words.ends, removed, kept)


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n, n_removed, spans, kept): words, words removed, maximal removed runs, the kept words joined by spaces (UTF-8)."""
    rows, n = C.in_chunks(docs, text)
    by_chunk = rows.groupBy("chunk")
    live = by_chunk.applyInArrow(_send_keys(n), C.KEYS_DDL).groupBy("bucket").applyInArrow(lambda t: C.live_keys(t, 1 << 30, OWN), C.LIVE_DDL)
    sent = by_chunk.cogroup(live.groupBy("chunk")).applyInArrow(_send_windows(n), WINDOWS_DDL)
    gone = sent.groupBy("bucket").applyInArrow(_judge, _GONE_DDL)
    return by_chunk.cogroup(gone.groupBy("chunk")).applyInArrow(_apply, C.RESULT_DDL)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
