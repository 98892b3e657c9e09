"""Suffix-array dedup over bytes: longest-previous-factor arrays remove later copies and keep the first.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller doc_id. A suffix
array over a whole corpus is one task's work, so suffixes are dealt to buckets by content: each window of LENGTH
bytes belongs to the least KMER-byte string in it (by a hash), and windows that follow each other with the same one
are sent as one piece. All equal windows so meet in one bucket. There the suffixes of all pieces are sorted by their
first LENGTH bytes; common prefixes of neighbours, and the previous and next smaller documents in that order, give
for each suffix the longest prefix that an earlier document has (its longest previous factor). Where that is LENGTH,
the window goes.

Pieces are sent only where their least string occurs in two documents, found first by an exchange of hashes; a hash
that two strings share by chance only sends more, as pieces are compared byte by byte. Later copies of whole
documents, and pieces that a smaller document in the same chunk has too, go without being sent. A string in very many
chunks is split: its windows are sent one by one and dealt by their own hash, so no bucket holds all of them.

Null and empty texts have no bytes. Documents with the same doc_id do not remove each other's text; nulls come
first. Overlaps count; what goes is judged on the input. Empty tables give no rows. Only doc_id and text are read.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.llm import chunks as C
from talliard.tables import table

LENGTH = 50
KMER = 20
#: Strings in so many chunks are dealt by their windows.
MANY_CHUNKS = 200
#: Windows that are sorted at once, but for those of one string.
SORTED = 200_000
#: Windows of a piece beyond which equal ones stand for each other.
LONG = 1 << 14
#: Flags of keys that stand for whole texts.
WHOLE = 8

_BYTES = C.numbers(3, 256)
_STEPS = [int(x) | 1 for x in C.numbers(4, 6)]


def kmer_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the KMER bytes from each place, by doubling; KMER is 20."""

    def joined(x, y, level):
        x = x * np.uint64(_STEPS[level]) + y
        return x ^ (x >> np.uint64(29))

    h1 = _BYTES[b]
    h2 = joined(h1[:-1], h1[1:], 0)
    h4 = joined(h2[:-2], h2[2:], 1)
    h8 = joined(h4[:-4], h4[4:], 2)
    h16 = joined(h8[:-8], h8[8:], 3)
    return joined(h16[:-4], h4[16:], 4) * np.uint64(_STEPS[5])


def pieces(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash of the least string) of runs of windows, over all documents of the chunk.

    A run goes on while the least string is the same, wherever it stands, so a text that repeats itself every few bytes is one run.
    """
    wide, n, step = LENGTH - KMER + 1, len(chunk.bytes) - LENGTH + 1, 1 << 15
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = np.empty(n, np.uint64)
    for at in range(0, n, step):
        h = kmer_hashes(chunk.bytes[at : min(at + step, n) + LENGTH - 1])
        m = (h & ~np.uint64(0xFFFF)) | np.arange(len(h), dtype=np.uint64)
        for by in (1, 2, 4, 8, wide - 16):
            m = np.minimum(m[:-by], m[by:])
        least[at : at + len(m)] = h[(m & np.uint64(0xFFFF)).astype(np.int64)]
    ok = np.zeros(n + 1, np.int64)
    long = chunk.ends - chunk.starts >= LENGTH
    np.add.at(ok, chunk.starts[long], 1)
    np.add.at(ok, chunk.ends[long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(ok[:n]))
    if not len(windows):
        return windows, windows, np.zeros(0, np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (least[windows[1:]] != least[windows[:-1]]) | (np.diff(windows) != 1))))
    return windows[new], windows[np.concatenate((new[1:], [len(windows)])) - 1], least[windows[new]]


def _whole(chunk: C.Chunk) -> np.ndarray:
    return np.array([C.digest(t) for t in chunk.texts], np.uint64).reshape(-1, 2)


def longest_previous(lcp: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """For suffixes in order, the longest prefix shared with one of a smaller document; prefixes below least count as 0.

    lcp: of each suffix with the one before. Links to the previous smaller value jump along links found so far, with
    the least prefix on the way; next smaller ones are those of the reversed order.
    """

    def previous(lcp, docs):
        to, shared = np.arange(len(docs)) - 1, np.where(lcp >= least, lcp, 0)
        while True:
            go = np.flatnonzero((shared > 0) & (docs[to] >= docs))
            if not len(go):
                return shared
            via = to[go]
            shared[go] = np.minimum(shared[go], shared[via])
            to[go] = to[via]

    if not len(docs):
        return np.zeros(0, np.int64)
    lcp[0] = 0
    return np.maximum(previous(lcp, docs), previous(np.concatenate(([0], lcp[:0:-1])), docs[::-1])[::-1])


def _windows(piece: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """A piece's windows; of a long one, which repeats itself, the different ones and which of them stands at each place."""
    every = np.lib.stride_tricks.sliding_window_view(np.frombuffer(piece, np.uint8), LENGTH)
    if len(every) <= LONG:
        return every, None
    known: dict[bytes, int] = {}
    back = np.empty(len(every), np.int32)
    for at in range(0, len(every), LONG):
        some, inverse = np.unique(np.ascontiguousarray(every[at : at + LONG]).view(np.dtype((np.void, LENGTH))).ravel(), return_inverse=True)
        back[at : at + LONG] = np.array([known.setdefault(x.tobytes(), len(known)) for x in some], np.int32)[inverse]
    return np.frombuffer(b"".join(known), np.uint8).reshape(-1, LENGTH), back


def _earlier(found: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each piece, whether each of its windows is a prefix of a suffix from a smaller document."""
    windows = [_windows(p) for p in found]
    n_windows = np.array([len(w) for w, _ in windows])
    prefix = np.zeros((int(n_windows.sum()), -(-LENGTH // 8) * 8), np.uint8)
    np.concatenate([w for w, _ in windows], out=prefix[:, :LENGTH])
    order = np.lexsort(prefix.view(">u8").astype(np.uint64).T[::-1])
    prefix = prefix[order]
    differ = prefix[1:, :LENGTH] != prefix[:-1, :LENGTH]
    lcp = np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), LENGTH)))
    out = np.empty(len(prefix), bool)
    out[order] = longest_previous(lcp, np.repeat(docs, n_windows)[order], LENGTH) >= LENGTH
    return [o if back is None else o[back] for o, (_, back) in zip(np.split(out, np.cumsum(n_windows)[:-1]), windows, strict=True)]


def _by_string(chunk: C.Chunk, a: int, b: int):
    """(start, end, digest) of what equal windows among a to b cover, in one span as long as they meet."""
    open_: dict[bytes, list[int]] = {}
    for w in range(a, b + 1):
        s = chunk.bytes[w : w + LENGTH].tobytes()
        span = open_.get(s)
        if span and w <= span[1]:
            span[1] = w + LENGTH
            continue
        if span:
            yield span[0], span[1], C.digest(s)
        open_[s] = [w, w + LENGTH]
    for s, (start, end) in open_.items():
        yield start, end, C.digest(s)


PIECES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
PIECES_DDL = "bucket int, chunk int, keys binary, docs binary, places binary, sizes binary, text binary, starts binary, ends binary"


def _send_keys(n: int):
    def run(table: pa.Table) -> pa.Table:
        chunk, number = C.Chunk(table), table["chunk"][0].as_py()
        first, _, keys = pieces(chunk)
        docs = chunk.docs[chunk.document_of(first)]
        return C.keys_to_buckets(number, n, np.concatenate((keys, _whole(chunk)[:, 0])), np.concatenate((docs, chunk.docs)), np.zeros(len(keys) + len(chunk.docs), np.uint8))

    return run


def _send_pieces(n: int):
    def run(table: pa.Table, live: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.row_table([], PIECES)
        chunk, number = C.Chunk(table), table["chunk"][0].as_py()
        keys, flags = C.sorted_live(live)
        first, last, least = pieces(chunk)
        flag = C.looked_up(least, keys, flags)
        whole = _whole(chunk)
        copies = C.looked_up(whole[:, 0], keys, flags) > 0
        # whole texts that others have: sent as digests of 16 bytes, by the same way as pieces
        known: dict[bytes, int] = {}
        held, done = [], []
        for k in np.flatnonzero(copies & (chunk.ends - chunk.starts >= LENGTH)).tolist():
            held.append((int(whole[k, 0]), int(chunk.docs[k]), int(chunk.starts[k]), int(chunk.ends[k]), whole[k].tobytes(), True))
        at = np.flatnonzero(flag)
        documents = chunk.document_of(first[at])
        for a, b, key, f, doc in zip(first[at].tolist(), last[at].tolist(), least[at].tolist(), flag[at].tolist(), chunk.docs[documents].tolist(), strict=True):
            if f & 4:
                # a string of very many chunks: only equal ones need to meet, by their digests as whole texts do
                held += [(int(d[0]), doc, start, end, d.tobytes(), True) for start, end, d in _by_string(chunk, a, b)]
            else:
                held.append((key, doc, a, b + LENGTH, chunk.bytes[a : b + LENGTH].tobytes(), False))
        for _, doc, _, _, s, _ in held:
            if known.get(s, doc) >= doc:
                known[s] = doc
        sent = []
        for key, doc, a, b, s, w in held:
            if known[s] < doc:
                done.append((a, b))
            else:
                sent.append((key, doc, a, b - a if not w else -(b - a), s))
        rows = []
        key_array, pack = C.short(np.array([x[0] for x in sent], np.uint64)), zstandard.ZstdCompressor(level=1).compress
        arrays = [key_array, np.array([x[1] for x in sent], np.int64), np.array([x[2] for x in sent], np.uint32), np.array([x[3] for x in sent], np.int32), np.arange(len(sent))]
        for bucket, (k, d, p, z, i) in C.by_target((key_array % np.uint64(n)).astype(np.int64), arrays):
            rows.append((bucket, number, C.packed(k), C.planes(d), C.planes(p), C.planes(z), pack(b"".join(sent[x][4] for x in i.tolist())), b"", b""))
        if done:
            a, b = np.array(done, np.uint32).T
            rows.append((number % n, number, b"", b"", b"", b"", b"", C.planes(np.ascontiguousarray(a)), C.planes(np.ascontiguousarray(b))))
        return C.row_table(rows, PIECES)

    return run


def _judge(table: pa.Table) -> pa.Table:
    """Spans that go, for each chunk; documents and pieces in one bucket."""
    of, keys, docs, places, sizes, text, spans, unpack = [], [], [], [], [], [], [], zstandard.ZstdDecompressor().decompress
    for r in table.to_pylist():
        if r["starts"]:
            spans.append((r["chunk"], C.from_planes(r["starts"], "u4"), C.from_planes(r["ends"], "u4")))
        if r["keys"]:
            z, at = C.from_planes(r["sizes"], "i4"), 0
            keys.append(C.unpacked(r["keys"]))
            held = unpack(r["text"])
            docs.append(C.from_planes(r["docs"], "i8"))
            places.append(C.from_planes(r["places"], "u4"))
            sizes.append(z)
            of.append(np.full(len(z), r["chunk"]))
            for size in z.tolist():
                text.append(held[at : at + (size if size > 0 else 16)])
                at += size if size > 0 else 16
    if text:
        of, keys, docs, places, sizes = map(np.concatenate, (of, keys, docs, places, sizes))
        number: dict[tuple[bytes, bool], int] = {}
        same = np.array([number.setdefault((t, z < 0), len(number)) for t, z in zip(text, sizes.tolist(), strict=True)])
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, same, docs)
        later = docs > least[same]
        size = np.abs(sizes).astype(np.int64)
        starts, ends, chunk = [places[later].astype(np.int64)], [places[later] + size[later]], [of[later]]
        one = np.zeros(len(number), np.int64)
        one[same[::-1]] = np.arange(len(same))[::-1]  # where each different piece stands first
        one = one[sizes[one] > 0]
        one = one[np.argsort(keys[one], kind="stable")]
        group = np.flatnonzero(np.concatenate(([True], keys[one][1:] != keys[one][:-1]))) if len(one) else one
        several = np.repeat(np.diff(np.concatenate((group, [len(one)]))), np.diff(np.concatenate((group, [len(one)])))) > 1 if len(one) else one
        groups = np.cumsum(np.isin(np.arange(len(one)), group))
        verdict: dict[int, np.ndarray] = {}
        todo = one[several] if len(one) else one
        todo_group = groups[several] if len(one) else one
        at = 0
        while at < len(todo):
            end = max(int(np.searchsorted(np.cumsum(size[todo[at:]] - LENGTH + 1), SORTED)) + at, at + 1)
            end = int(np.searchsorted(todo_group, todo_group[min(end, len(todo)) - 1], side="right"))
            part = todo[at:end]
            for k, gone in zip(part.tolist(), _earlier([text[k] for k in part.tolist()], least[same[part]]), strict=True):
                if gone.any():
                    verdict[int(same[k])] = gone
            at = end
        more = []
        for k in np.flatnonzero(~later & np.isin(same, list(verdict))).tolist() if verdict else []:
            edge = np.diff(np.concatenate(([0], verdict[int(same[k])].astype(np.int8), [0])))
            more += [(of[k], places[k] + a, places[k] + b - 1 + LENGTH) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
        if more:
            c, a, b = np.array(more, np.int64).T
            starts, ends, chunk = [*starts, a], [*ends, b], [*chunk, c]
        starts, ends, chunk = map(np.concatenate, (starts, ends, chunk))
        spans += [(c, a.astype(np.uint32), b.astype(np.uint32)) for c, (a, b) in C.by_target(chunk, [starts, ends])]
    return C.row_table([(c, C.planes(np.ascontiguousarray(a)), C.planes(np.ascontiguousarray(b))) for c, a, b in spans], C.SPANS)


def _apply(table: pa.Table, spans: pa.Table) -> pa.Table:
    if not table.num_rows:
        return C.row_table([], C.RESULT)
    chunk = C.Chunk(table)
    starts = np.concatenate([np.zeros(0, np.uint32), *(C.from_planes(x, "u4") for x in spans["starts"].to_pylist())]).astype(np.int64)
    ends = np.concatenate([np.zeros(0, np.uint32), *(C.from_planes(x, "u4") for x in spans["ends"].to_pylist())]).astype(np.int64)
    removed = C.covered(len(chunk.bytes), starts, ends)
    return C.results(chunk.docs, chunk.starts, chunk.ends, removed, lambda k, mask: chunk.texts[k] if mask is None else chunk.bytes[chunk.starts[k] : chunk.ends[k]][mask].tobytes())


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n, n_removed, spans, kept): bytes, bytes removed, maximal removed runs and the remaining bytes."""
    rows, n = C.in_chunks(docs, text)
    by_chunk = rows.groupBy("chunk")
    many = MANY_CHUNKS
    live = by_chunk.applyInArrow(_send_keys(n), C.KEYS_DDL).groupBy("bucket").applyInArrow(lambda t: C.live_keys(t, many), C.LIVE_DDL)
    sent = by_chunk.cogroup(live.groupBy("chunk")).applyInArrow(_send_pieces(n), PIECES_DDL)
    spans = sent.groupBy("bucket").applyInArrow(_judge, C.SPANS_DDL)
    return by_chunk.cogroup(spans.groupBy("chunk")).applyInArrow(_apply, C.RESULT_DDL)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
