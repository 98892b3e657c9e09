"""The pipeline's stages one after the other on a small corpus, each against brute force on what the stage before kept."""

import re
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from test_operators import SCHEMA, WORD, brute_classes, brute_hits, made_texts

import corpus_pipeline
from talliard.llm import mixing, quality, token_files

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def passes(line):
    chars, words = SPACE.sub("", line), WORD.findall(line)
    bars, low = line.count("|"), line.lower()
    return not chars or not (
        sum(c in "#*$%&|<>" for c in line) >= quality.SYMBOL_SHARE * len(chars)
        or 2 * line.count("!!") >= len(words)
        or (bars >= 3 and bars >= quality.BAR_SHARE * len(words))
        or (len(words) <= quality.BOILERPLATE_WORDS and any(p in low for p in quality.PHRASES))
        or (len(words) < quality.STUB_WORDS and not re.search(r'[.!?…:;"»”)]\s*$', line))
    )


def cleaned(text):
    """The text without failing lines; None for a rejected document."""
    words, seen = WORD.findall(text or ""), defaultdict(list)
    for k in range(len(words) - 2):
        seen[tuple(words[k : k + 3])].append(k)
    hit = {k + o for at in seen.values() if len(at) > 1 for k in at for o in range(3)}
    if len(words) < quality.MIN_WORDS or 100 * len(hit) > 50 * len(words):
        return None
    kept = "\n".join(x for x in text.split("\n") if passes(x))
    return kept if len(SPACE.sub("", kept)) >= quality.KEPT_SHARE * len(SPACE.sub("", text)) else None


def test_stages(spark, tmp_path):
    rows = made_texts()
    bar = "Home | About | Contact | News\n"
    rows += [(1000, bar + rows[10][1] + " and more", "en", "a", 0), (1001, None, None, None, None), (1002, bar * 9 + "few words", "en", None, 9)]
    words = rows[10][1].split(" ")
    items = [(1, " ".join(words[100:130])), (2, None), (3, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        out.append([tuple(r) for r in docs.collect()])
        assert k == 4 or docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]

    first = {d: c for d, t, *_ in rows if (c := cleaned(t)) is not None}
    assert {r[0]: r[1] for r in out[0]} == first and all(r[4] == len(r[1]) for r in out[0]) and 1002 not in first
    classes = brute_classes(out[0], 5, 80)
    assert sorted(r[0] for r in out[1]) == sorted(d for d, (_, c) in classes.items() if c == d)
    clean = [r for r in out[1] if not brute_hits(r[1], items)[1]]
    assert sorted(out[2]) == sorted(clean) and len(clean) < len(out[1])
    targets, size = {r.source: r.target for r in mixing.mix(spark.read.parquet(str(tmp_path / "out2"))).collect()}, defaultdict(int)
    for r in out[3]:
        size[r[3]] += len(WORD.findall(r[1]))
    assert all(abs(size[s] - t) <= max(16, 0.02 * t) for s, t in targets.items())
    encode, want, start = Tokenizer.from_file(token_files.default_tokenizer()), [], 0
    for doc_id, text in sorted((r[0], r[1]) for r in out[3]):
        ids = [*encode.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(out[4]) == sorted(want)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(out[4])


def test_near_duplicates_of_repeated_ids(spark):
    text = lambda x: " ".join(f"{x}{k}" for k in range(60))
    a, b, c, d = map(text, "abcd")
    rows = [(5, a), (5, b), (2, a), (9, b), (7, c), (7, c), (8, c + " more"), (None, d), (None, d), (None, text("e")), (4, d), (6, None), (6, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(2, a), (5, b), (7, c), (None, d), (None, text("e")), (6, None), (6, None), (None, "")], key=str)
