"""Importance resampling against loops: nulls, ties, repeated rows, long texts in segments, longer runs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from talliard.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, weight string, rank long, score double"


def buckets_of(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10000 for n in range(1, run + 1) for k in range(len(words) - n + 1)]


def brute(docs, target, run=1):
    found = [(i, *buckets_of(t, run)) for i, t, *_ in docs]
    s, t = Counter(x for *_, w in found for x in w), Counter(x for text in target for x in buckets_of(text, run)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1.0) * (n_s + 10000.0) / ((s[x] + 1.0) * (n_t + 10000.0))))
    out = []
    for i, words, w in found:
        weight = sum(map(gain, w)) // len(w) if w else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(enough[: 10 * len(enough) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def rows():
    out = [(k, " ".join(["Alpha", "be-ta", "ÜBER", "x9", "gamma"][(k * j) % 5] + str(j % (k % 7 + 1)) for j in range(15 + k % 40)), "clash", 5, 0.5) for k in range(150)]
    out += [(None, "null id " * 30, None, None, None)] * 40 + [(7, out[9][1], "", 0, 0.0)] * 3
    return out + [(900, None, "", 0, 0.0), (901, "", "", 0, 0.0), (902, " .,-\n", "", 0, 0.0), (903, "one", "", 0, 0.0)]


TARGET = ["alpha beta gamma x90", None, "", "Some other target text über9"]


@pytest.mark.parametrize("run", [1, 3])
@pytest.mark.parametrize("segment", [7, 4 << 20])
def test_draw(spark, run, segment, monkeypatch):
    monkeypatch.setattr(resample, "SEGMENT", segment)
    docs, target = spark.createDataFrame(rows(), SCHEMA).repartition(4), spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = [tuple(r) for r in resample.resampled(docs, target, run=run).select("key", "n_words", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=str) == brute(rows(), TARGET, run)


@pytest.mark.parametrize("run", [1, 2, 4])
def test_segments_lose_no_feature(run, monkeypatch):
    text = "  Word1 and UND über-all " * 50 + "z" * 300 + " end"
    whole = np.concatenate([f for _, f in resample.features(text.encode(), run, 10000)])
    monkeypatch.setattr(resample, "SEGMENT", 11)
    parts = list(resample.features(text.encode(), run, 10000))
    assert len(parts) > 20 and sorted(np.concatenate([f for _, f in parts])) == sorted(whole) == sorted(buckets_of(text, run)[1])


def test_very_long_text(spark):
    long = spark.createDataFrame([(1,), (2,)], "doc_id long").selectExpr("doc_id", "repeat('Some words of a long line ', 800000) as text")
    got = resample.weighed(long, np.arange(10000)).collect()
    assert {(r.n_words, r.n_features) for r in got} == {(4_800_000, 4_800_000)}


def test_empty(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resample.resampled(none, target).count() == 0
    assert resample.resampled(spark.createDataFrame(rows(), SCHEMA), target).where("rank is not null").count() > 0
