"""Packs of many small logs: they say what the files by themselves say, and there are few of them."""

import json
import os
from pathlib import Path

import pytest

from talliard.plans import readers
from talliard.sources import logs

DIR = "/root/testdata/sf0.001"


def stamped(minute, kind, **more):
    return json.dumps({"type": kind, "uuid": f"{kind}{minute}", "sessionId": "s", "timestamp": f"2026-09-20T10:{minute:02d}:00Z", "cwd": "/w", **more})


def answer(minute, key, model):
    return stamped(minute, "assistant", message={"id": key, "model": model, "usage": {"input_tokens": 3, "output_tokens": minute}})


ORG = stamped(0, "attachment", attachment={"type": "credential_org", "organizationUuid": "org"})
FILES = {
    "a": [stamped(1, "user", message={"content": "a\tb"}), ORG, answer(2, "m1", "opus"), answer(3, "m1", "opus")],
    "b": [stamped(4, "user", message={"content": "no answer"})], "c": ["no json", answer(5, "m2", "sonnet"), answer(6, "m1", "sonnet")],
}


def test_packed_transcripts_are_read_as_their_files(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for name, rows in FILES.items():
        (tmp_path / "files" / f"{name}.jsonl").write_text("\n".join(rows))
    logs.pack(spark.createDataFrame([(n, k, v) for n, rows in FILES.items() for k, v in enumerate(rows)], "name string, order int, value string").repartition(3), str(tmp_path / "packs"))
    whole, packed = logs.claude(spark, str(tmp_path / "files")), logs.claude(spark, str(tmp_path / "packs"), "part-*", packed=True)
    for one, other in zip(whole, packed):
        assert sorted(map(str, one.drop("file").collect())) == sorted(map(str, other.drop("file").collect()))
    assert whole[0].count() == 3 and {(r.text, r.model) for r in packed[1].collect()} == {("a\tb", "opus"), ("no answer", "")}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("lay_out", [readers.transcripts, readers.rollouts, readers.sessions])
def test_logs_of_many_sessions_lie_in_few_files(spark, lay_out):
    few = list(Path(lay_out(spark, DIR).removeprefix("file://")).rglob("part-*"))
    assert 0 < len(few) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
