"""Benchmark decontamination by a prefix-filtered set join of shingles, verified exactly.

An item is cut into windows of WINDOW consecutive words (an item with fewer words is one window); a window is a set
of shingles of SHINGLE words (fewer where the window is shorter). A document contains a window only if it contains
all its shingles, so of the shingles ordered by rarity a prefix of one is enough to find candidates: the window's
rarest shingle, by the number of documents that hold it, counted over all documents. A document's shingles that are
some window's prefix give candidates; the prefix's place in the window gives the only place where the window can
start, which bounds length and position; there all words are compared. So every occurrence is found exactly.

Benchmarks are read in blocks of at most BLOCK_ITEMS items and BLOCK_WORDS words, so what is sent to all tasks is
bounded; documents pass once for the counts and once for the join for each block, and hits of all blocks add up in
the document's row. Nothing of the documents is shuffled, except counts of item shingles.

Words are of lower-cased letters and digits and all characters beyond ASCII. Null and empty texts and items have no
words and no windows. Repeated items count each by its id; items with a null id are ignored. Repeated documents are
judged each by itself. Ties in rarity go to the earlier shingle. Empty tables give no rows or no hits. Extra columns
pass through; those that clash with a result's name are replaced.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.llm.common import texts, wider
from talliard.tables import table

WINDOW = 10
SHINGLE = 5
BLOCK_ITEMS = 50_000
BLOCK_WORDS = 5_000_000

#: Bytes that are no part of a word become blanks, capitals small letters; bytes of characters beyond ASCII stay.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Index:
    """A block's windows as arrays of word numbers, found by their shingles."""

    def __init__(self, items: list[tuple[str, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        windows: dict[tuple[int, ...], list[int]] = {}
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for s in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                if (owners := windows.setdefault(tuple(ids[s : s + WINDOW]), [])) == [] or owners[-1] != k:
                    owners.append(k)
        self.windows, self.owners = list(windows), list(windows.values())
        self.shingles: dict[tuple[int, ...], int] = {}
        self.of_window = []
        for w in self.windows:
            n = min(SHINGLE, len(w))
            self.of_window.append([self.shingles.setdefault(w[o : o + n], len(self.shingles)) for o in range(len(w) - n + 1)])
        self.lengths = sorted({len(s) for s in self.shingles})

    def prefixes(self, counts: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """Shingle to (window, place): each window once, under its rarest shingle."""
        found: dict[int, list[tuple[int, int]]] = {}
        for w, shingles in enumerate(self.of_window):
            place = min(range(len(shingles)), key=lambda o: (counts.get(shingles[o], 0), shingles[o], o))
            found.setdefault(shingles[place], []).append((w, place))
        return found

    def places(self, text: str | None):
        """The text's word numbers (-1: in no item), and (place, shingle) of all item shingles in it."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(-1)), np.int64, len(words))
        found = []
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for n in self.lengths:
            at = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else ()
            found += [(int(p), s) for p in at if (s := self.shingles.get(tuple(ids[p : p + n].tolist()))) is not None]
        return ids, found


def item_blocks(benchmark: DataFrame):
    """Lists of (item_id, text) of bounded size, in the order of ids; the driver holds one block at a time."""
    block, words = [], 0
    for item_id, text in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text").toLocalIterator():
        block.append((item_id, text))
        words += len(text) // 2 + 1
        if len(block) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def shingle_counts(docs: DataFrame, index, text: str = "text") -> dict[int, int]:
    """Documents that hold each shingle of the block; as many counts at most as the block has shingles."""

    def count(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for t in texts(batch, "text"):
                for s in {s for _, s in index.value.places(t)[1]}:
                    total[s] = total.get(s, 0) + 1
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(total.keys(), pa.int64()), "n": pa.array(total.values(), pa.int64())})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r.shingle: r.n for r in rows.toLocalIterator()}


def mark(docs: DataFrame, index, prefixes, text: str = "text") -> DataFrame:
    """docs with n_words, and the block's hits added to hit_runs and hit_items."""

    def join(batches):
        ix, starts_of = index.value, prefixes.value
        lengths = [len(w) for w in ix.windows]
        for batch in batches:
            n_words, runs, items = [], [], []
            for t, old_runs, old_items in zip(texts(batch, text), batch.column("hit_runs").to_pylist(), batch.column("hit_items").to_pylist(), strict=True):
                ids, found = ix.places(t)
                hits, owners = [tuple(r.values()) for r in old_runs], set(old_items)
                for place, shingle in found:
                    for w, offset in starts_of.get(shingle, ()):
                        start = place - offset
                        end = start + lengths[w]
                        if start >= 0 and end <= len(ids) and tuple(ids[start:end].tolist()) == ix.windows[w]:
                            hits.append((start, end))
                            owners.update(ix.items[k] for k in ix.owners[w])
                merged: list[list[int]] = []
                for start, end in sorted(hits):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                n_words.append(len(ids))
                runs.append([{"start": a, "end": b} for a, b in merged])
                items.append(sorted(owners))
            kept = [n for n in batch.schema.names if n not in ("n_words", "hit_runs", "hit_items")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(n_words, pa.int64()), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.string()))], [*kept, "n_words", "hit_runs", "hit_items"]
            )

    kept = docs.drop("n_words", "hit_runs", "hit_items")
    return docs.mapInArrow(join, wider(kept, "n_words bigint, hit_runs array<struct<start:bigint,end:bigint>>, hit_items array<string>"))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, hit_runs (maximal runs of hit words) and hit_items (ids, sorted as strings)."""
    spark = docs.sparkSession
    plain = docs.drop(*({"n_words", "hit_runs", "hit_items"} & set(docs.columns)))
    found = plain.withColumns({"n_words": F.lit(0).cast("long"), "hit_runs": F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), "hit_items": F.expr("cast(array() as array<string>)")})
    blocks = item_blocks(benchmark)
    for block in itertools.chain([next(blocks, [])], blocks):  # without items, words are counted all the same
        index = spark.sparkContext.broadcast(Index(block))
        prefixes = spark.sparkContext.broadcast(index.value.prefixes(shingle_counts(plain, index, text) if block else {}))
        found = mark(found, index, prefixes, text)
    return found


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(hit_runs, 0L, (a, r) -> a + r.end - r.start)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
