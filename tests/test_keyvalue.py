"""Editor databases written here, against loops over what was written."""

import json
import random
import sqlite3

import pytest

from talliard.sources import keyvalue as kv


def filled(path, table, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    db.execute(f"create table if not exists {table} (key text unique on conflict replace, value blob)")
    db.executemany(f"insert into {table} values (?, ?)", rows)
    db.commit()
    db.close()


def chats(seed):
    rng, rows, usage, prompts = random.Random(seed), [], set(), set()
    for c in range(12):
        cid, begun, own = f"c{c}", rng.choice([None, 1_767_000_000_000 + c, 1_767_000_000]), rng.choice(["", "own"])
        known = rng.random() < 0.8
        bubbles = [(f"b{k}", rng.choice([1, 2]), rng.choice(["", "m1", "m2"])) for k in range(rng.randrange(9))]
        heads = [{"bubbleId": b, "type": kind} for b, kind, _ in bubbles if rng.random() < 0.9]
        rng.shuffle(heads)
        if known:
            rows.append((f"composerData:{cid}", json.dumps({"createdAt": begun, "modelConfig": {"modelName": own}, "fullConversationHeadersOnly": heads, "big": "x" * 500})))
        named, any_tokens, mine = {b: m for b, kind, m in bubbles if kind == 2}, False, []
        at = (begun if begun and begun > 1e11 else (begun or 0) * 1000) if known else 0
        for b, kind, model in bubbles:
            ts = rng.choice([None, "2026-02-03T04:05:06.000Z", 1_768_000_000_000])
            text, image, tokens, uuid, folder = rng.choice(["", "  ", f"say {b}"]), rng.random() < 0.3, rng.choice([None, (0, 0), (3, 0), (2, 5)]), rng.choice(["", f"u{c}{b}"]), rng.choice(["", "/own"])
            value = {"type": kind, "createdAt": ts, "usageUuid": uuid, "modelInfo": {"modelName": model}, "workspaceProjectDir": folder, "text": text, "images": [{}] if image else []}
            if tokens:
                value["tokenCount"] = {"inputTokens": tokens[0], "outputTokens": tokens[1]}
            rows.append((f"bubbleId:{cid}:{b}", json.dumps(value).encode() if rng.random() < 0.5 else json.dumps(value)))
            when = 1_770_091_506_000 if isinstance(ts, str) else ts or at
            place = folder or ("/project" if c % 2 else "")
            if kind == 2 and tokens and any(tokens):
                any_tokens = True
                if when:
                    usage.add((uuid or f"{cid}:{b}", when, "event" if ts else "session-start", cid, model or (own if known else ""), place, *tokens))
            if kind == 1 and when and (text.strip() or image):
                order = [h["bubbleId"] for h in heads]
                model = own if known else ""
                if known and b in order:
                    after = [h["bubbleId"] for h in heads[order.index(b) + 1 :] if h["type"] == 2]
                    model = (named.get(after[0]) if after else "") or own
                mine.append((f"{cid}:{b}", when, cid, model, place, text if text.strip() else "[image]"))
        prompts |= {(*p, any_tokens) for p in mine}
    return rows, usage, prompts


@pytest.mark.parametrize("n", [3, 50_000])
def test_editor(spark, tmp_path, n):
    rows, usage, prompts = chats(n)
    bad = [("bubbleId:c0:", "{}"), ("bubbleId::b", "{}"), ("bubbleId:c0:torn", '{"type": 1,'), ("bubbleId:c0:none", None), ("other:1", "{}"), ("composerData:z", "null"), ("bubbleIe", '{"type": 1}'), ("bubbleId:c0:list", "[1]")]
    filled(tmp_path / "global/state.vscdb", kv.ENTRIES, rows + bad)
    filled(tmp_path / "other/state.vscdb", "something", [("bubbleId:c0:b0", "{}")])
    (tmp_path / "no/").mkdir()
    (tmp_path / "no/state.vscdb").write_text("no database")
    for k in range(3):
        folder = tmp_path / f"ws/w{k}"
        filled(folder / "state.vscdb", kv.ITEMS, [("composer.composerData", json.dumps({"allComposers": [{"composerId": f"c{c}"} for c in range(12) if c % 2 and c % 3 == k]})), ("composer.x", "{}")])
        (folder / "workspace.json").write_text(json.dumps({"folder": "file:///project"} if k else {"workspace": "file:///project"}))
    places = kv.folders(spark, str(tmp_path / "ws"))
    used, said = kv.editor(spark, str(tmp_path), places=places, rows=n)
    got = {(r.native_key, round(r.ts.timestamp() * 1000), r.ts_q, r.session, r.model, r.cwd, r.tok_in, r.tok_out) for r in used.collect()}
    assert got == usage and len(usage) > 5
    assert {(r.native_key, round(r.ts.timestamp() * 1000), r.session, r.model, r.cwd, r.text, r.has_usage) for r in said.collect()} == prompts and len(prompts) > 5


def test_ranges_of_keys_reach_the_database(spark, tmp_path):
    filled(tmp_path / "a.db", "t", [(f"k{n:03d}", f'{{"n": {n}, "m": [1]}}') for n in range(100)] + [("l", "x"), ("k", "{}")])
    rows = kv.prefixed(kv.key_values(spark, str(tmp_path), "t", "*.db", rows=7), "k0")
    assert sorted(r.key for r in rows.collect()) == [f"k{n:03d}" for n in range(100)]
    assert rows.rdd.getNumPartitions() == 13
    reader = kv._Reader({"path": str(tmp_path), "table": "t", "rows": "7"})
    left = list(reader.pushFilters([kv.GreaterThanOrEqual(("key",), "k01"), kv.LessThan(("key",), "k02"), kv.LessThan(("value",), "k02")]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(key" in plan and "k0" not in plan  # Spark leaves the range to the database
    short = kv.key_values(spark, str(tmp_path), "t", paths=["$.n", "$.m"]).where("key in ('k005', 'l')")
    assert {(r.key, r.value) for r in short.collect()} == {("k005", "[5,[1]]"), ("l", "x")}


@pytest.mark.parametrize(("uri", "want"), [("file:///a%20b", "/a b"), ("file:///c:/Users/x", "c:/Users/x"), ("vscode-remote://ssh/x", "vscode-remote://ssh/x"), ("file:///a+b", "/a+b")])
def test_folders(spark, tmp_path, uri, want):
    filled(tmp_path / "w/state.vscdb", kv.ITEMS, [("composer.composerData", '{"allComposers": [{"composerId": "c"}, {"composerId": ""}]}')])
    (tmp_path / "w/workspace.json").write_text(json.dumps({"folder": uri}))
    assert [tuple(r) for r in kv.folders(spark, str(tmp_path)).collect()] == [("c", want)]


def test_nothing(spark, tmp_path):
    used, said = kv.editor(spark, str(tmp_path / "none"))
    assert used.count() == 0 and said.count() == 0
