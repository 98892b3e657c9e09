"""Importance resampling towards a target distribution, by hashed word runs and Gumbel keys.

A document's weight is the mean log ratio of its features' shares in the target and in the corpus. Drawing the highest
sums of weight and Gumbel noise draws without replacement with odds in proportion to the ratios.

1. Each task counts the features of its texts by bucket (np.bincount) into one vector; a tree of tasks adds the vectors.
   So what reaches the driver is one vector of BUCKETS numbers, however many documents there are.
2. Gains by bucket are broadcast. Each task gathers the gains of its texts' features and adds them up by document
   (np.bincount with weights).
3. Scores are whole numbers in a bounded range, so counts by score, coarse ones first, tell from which score on
   documents are drawn; only those are sorted, by ranges, and numbered (see ranks).

Null and empty texts have no features and weight 0, and as too short ones they are never drawn. A null key has the noise of an
empty one and comes before all others where scores tie; repeated keys are documents of their own with the same noise, each drawn by
itself. Texts of any length are cut into words SEGMENT bytes at a time. An empty corpus gives no rows; with an empty
target all features are as rare there. Only the key and the text are read; other columns may have any name.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.llm.common import stored
from talliard.llm.ranks import placed
from talliard.tables import table

BUCKETS = 10_000
#: Words of the longest feature.
RUN = 1
#: Share of the long enough documents that is drawn, in percent, and words that make one long enough.
PERCENT, LEAST_WORDS = 10, 20
SEED = 2024
#: Bytes of text that are words at once, but for a single word.
SEGMENT = 4 << 20
#: Scores in a coarse count.
COARSE = 256

_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def _segments(text: bytes) -> Iterator[bytes]:
    text, at = text.translate(_FOLD), 0
    while len(text) - at > SEGMENT:
        end = text.find(b" ", at + SEGMENT)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def features(text: bytes, run: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features) of one part of the text after another."""
    kept: list[bytes] = []
    for segment in _segments(text):
        new = segment.split()
        found = [np.fromiter(map(zlib.crc32, new), np.int64, len(new))]
        if run > 1:
            words = kept + new
            for n in range(2, run + 1):
                first = max(0, len(kept) - n + 1)
                runs = [b" ".join(words[k : k + n]) for k in range(first, len(words) - n + 1)]
                found.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)))
            kept = words[-(run - 1) :]
        yield len(new), np.concatenate(found) % buckets


def _by_texts(batch: pa.RecordBatch, column: int, run: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each part, its words, its number of features, all their buckets) for about SEGMENT bytes at a time."""
    rows, words, sizes, held, n = [], [], [], [], 0
    for k in range(batch.num_rows):
        text = batch.column(column)[k].as_py()
        for w, found in features(text, run, buckets) if text else ():
            rows.append(k)
            words.append(w)
            sizes.append(len(found))
            held.append(found)
            n += len(found)
        if n * 8 > SEGMENT:
            yield np.array(rows), np.array(words), np.array(sizes), np.concatenate(held)
            rows, words, sizes, held, n = [], [], [], [], 0
    if rows:
        yield np.array(rows), np.array(words), np.array(sizes), np.concatenate(held)


def counts(df: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in _by_texts(batch, 0, run, buckets):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    vectors = df.select(F.col(text).cast("binary")).mapInArrow(counted, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of its shares in target and corpus, each count one more, in floored thousandths."""
    n = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean gain of a document's features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    buckets = len(gain)

    def weigh(batches):
        gain = shared.value.astype(np.float64)
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, w, sizes, found in _by_texts(batch, 1, run, buckets):
                of = np.repeat(rows, sizes)
                words += np.bincount(rows, w, minlength=len(n)).astype(np.int64)
                n += np.bincount(rows, sizes, minlength=len(n)).astype(np.int64)
                total += np.bincount(of, gain[found], minlength=len(n)).astype(np.int64)  # whole numbers: exact
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["key", "n_words", "n_features", "weight"])

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("content")).mapInArrow(weigh, f"key {kind}, n_words long, n_features long, weight long")


def _cut(scored: DataFrame, n: int) -> int:
    """The score of the n-th highest. Counts of at most some hundred ranges, then of COARSE scores, come to the driver."""
    at = F.floor(F.col("score") / COARSE)
    for c, size in sorted(scored.groupBy(at.alias("c")).count().collect(), reverse=True):
        if n <= size:
            break
        n -= size
    for score, size in sorted(scored.where(at == c).groupBy("score").count().collect(), reverse=True):
        if n <= size:
            return score
        n -= size
    raise AssertionError("fewer rows than counted")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of all docs; rank is null where a document isn't drawn."""
    gain = gains(counts(docs, text, run, buckets), counts(target, text, run, buckets))
    drawn_by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn_by, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = stored(weighed(docs, gain, key, text, run).withColumn("score", F.col("weight") + noise))
    long_enough = scored.where(F.col("n_words") >= least_words)
    n = percent * long_enough.count() // 100
    if not n:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = (F.col("n_words") >= least_words) & (F.col("score") >= _cut(long_enough, n))
    ranked = placed(scored.where(high).withColumn("grp", F.lit("")), F.desc("score"), F.asc_nulls_first("key"))
    ranked = ranked.withColumn("rank", F.when(F.col("pos") < n, F.col("pos") + 1)).drop("grp", "pos")
    return scored.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")
