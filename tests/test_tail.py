"""The source of growing files, and prompts that wait for their model, against the same work in one batch."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from talliard.sources import logs, tail
from talliard.streaming import pending


@pytest.fixture
def rocks(spark):
    with pending.rocksdb(spark):
        yield


def append(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        f.write(text)


def run(df, tmp_path, mode="append"):
    done = df.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).outputMode(mode).trigger(availableNow=True).start()
    done.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out"))


def test_files_that_grow_shrink_and_are_replaced(spark, tmp_path):
    """Each line once; a file that starts over comes again from its start; a torn line waits."""
    folder, rng = tmp_path / "in", random.Random(4)
    stream = lambda pv=1: tail.growing_lines(spark, str(folder), splitBytes=700, parserVersion=pv)
    line = lambda k: json.dumps({"k": k, "pad": "ü" * rng.randrange(120)}) + "\n"
    want: list[str] = []
    a, b, c = folder / "a.jsonl", folder / "deep/b.jsonl", folder / "c.jsonl"
    got = lambda pv=1: sorted(r.value for r in run(stream(pv), tmp_path).collect())
    for part in range(3):
        for path, n in ((a, 40), (b, 3)):
            lines = [line(f"{path.stem}{part}{k}") for k in range(n)]
            append(path, "".join(lines))
            want += lines
        append(folder / "other.txt", "not a log\n")
        assert got() == sorted(x.rstrip("\n") for x in want)
    append(c, '{"torn": ')
    assert got() == sorted(x.rstrip("\n") for x in want)
    append(c, '1}\n\n  \n{"k": 2}\n{"again": ')
    want += ['{"torn": 1}', '{"k": 2}']
    assert got() == sorted(x.rstrip("\n") for x in want)
    b.write_text("short\n")  # shrank
    want.append("short")
    assert got() == sorted(x.rstrip("\n") for x in want)
    lines = [line(f"new{k}") for k in range(60)]
    assert sum(map(len, lines)) > 0
    a.write_text("".join(lines) + "x" * max(0, a.stat().st_size - sum(len(x.encode()) for x in lines)) + "\n")  # as long or longer, with another head
    want += [x for x in a.read_text().split("\n") if x]
    assert got() == sorted(x.rstrip("\n") for x in want)
    os.remove(b)
    assert got() == sorted(x.rstrip("\n") for x in want)
    assert got(2) == sorted(x.rstrip("\n") for x in want + a.read_text().split("\n")[:-1] + ['{"torn": 1}', '{"k": 2}'] if x)
    batch = tail.growing_lines(spark, str(folder), stream=False, splitBytes=333)
    assert sorted(r.value for r in batch.collect()) == sorted([x for x in a.read_text().split("\n") if x] + ['{"torn": 1}', '{"k": 2}'])


@pytest.mark.parametrize("split", [1, 7, 50, 1 << 20])
def test_splits_share_no_line(tmp_path, split, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 13)
    path = tmp_path / "x.jsonl"
    lines = ["", "a", "bb" * 9, "", "ccc", "d" * 40, "é" * 5, "e"]
    path.write_bytes("\n".join(lines).encode() + b"\ntorn")
    end = tail._Files({"path": str(tmp_path)}).cursors()
    rows = [r for part in tail.ranges({}, end, split) for b in tail.read_part(tail.Part(*part)) for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert [v for _, v in rows] == [x for x in lines if x]
    assert all(path.read_bytes()[at:].decode().startswith(v) for at, v in rows)


def test_no_files(spark, tmp_path):
    assert tail.growing_lines(spark, str(tmp_path / "none"), stream=False).count() == 0


def said(k, ts, text, uuid=None):
    return json.dumps({"type": "user", "timestamp": ts, "sessionId": f"s{k % 3}", "uuid": uuid or f"u{k}", "cwd": "/w", "message": {"content": text}}) + "\n"


def answer(k, ts, model="m1"):
    return json.dumps({"type": "assistant", "timestamp": ts, "sessionId": "s", "uuid": f"a{k}", "message": {"id": f"i{k}", "model": model, "usage": {"input_tokens": 1}}}) + "\n"


def test_prompts_wait_for_their_model(spark, tmp_path, rocks):
    """In several runs as in one batch, whatever falls between prompt and answer; late ones go without a model."""
    folder, rng, k, second = tmp_path / "in", random.Random(7), 0, 0
    stamp = lambda: f"2026-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"
    stream = lambda: pending.with_models(pending.transcript_lines(tail.growing_lines(spark, str(folder))), by_events=True)
    for _ in range(5):
        for _ in range(12):
            k, second = k + 1, second + rng.randrange(8)
            path = folder / f"f{rng.randrange(3)}.jsonl"
            append(path, rng.choice([said(k, stamp(), f"text {k}"), said(k, stamp(), "<system>"), answer(k, stamp(), rng.choice(["m1", "m2", "<synthetic>"])), "no json\n"]))
        run(stream(), tmp_path)
    for n in range(3):  # answers for all that still wait, then a prompt that nobody answers
        k, second = k + 1, second + 1
        append(folder / f"f{n}.jsonl", answer(k, stamp(), "last"))
    run(stream(), tmp_path)
    append(folder / "f0.jsonl", said(900, stamp(), "alone"))
    run(stream(), tmp_path)
    _, batch = logs.claude(spark, str(folder))
    want = {(r.native_key, r.text, r.model) for r in batch.collect()}
    seen = lambda: [(r.native_key, r.text, r.model) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(want) > 8 and set(seen()) == want - {("u900", "alone", "")} and len(seen()) == len(want) - 1
    second += 1800
    append(folder / "f1.jsonl", answer(901, stamp()))
    run(stream(), tmp_path)
    append(folder / "f1.jsonl", answer(902, stamp()))
    run(stream(), tmp_path)
    assert set(seen()) == want and len(seen()) == len(want)
    state = spark.read.format("statestore").option("stateVarName", "prompts").load(str(tmp_path / "cp"))
    assert state.count() == 0


def test_waiting_by_the_clock(spark, tmp_path, rocks):
    folder = tmp_path / "in"
    append(folder / "a.jsonl", said(1, "2020-01-01T00:00:00Z", "old") + said(2, "2020-01-01T00:01:00Z", "answered") + answer(3, "2020-01-01T00:02:00Z"))
    append(folder / "b.jsonl", said(4, "2020-01-01T00:00:00Z", "never answered") + said(5, "2099-01-01T00:00:00Z", "still waits"))
    rows = run(pending.with_models(pending.transcript_lines(tail.growing_lines(spark, str(folder)))), tmp_path)
    assert {(r.text, r.model) for r in rows.select("text", "model").collect()} == {("old", "m1"), ("answered", "m1"), ("never answered", "")}
    b = folder / "b.jsonl"
    b.write_text(said(6, "2099-01-01T00:00:00Z", "x" * 50) + answer(7, "2099-01-01T00:00:01Z", "m9"))  # starts over
    assert run(pending.with_models(pending.transcript_lines(tail.growing_lines(spark, str(folder)))), tmp_path).where(F.col("text").startswith("xxx") & (F.col("model") == "m9")).count() == 1
