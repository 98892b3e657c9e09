"""Histories, turn summaries, plan windows and published files against loops and worked examples."""

import hashlib
import json
import os
import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from talliard.sources import history, logs, published, quota

NOW = "2026-01-01 12:00:00"
MS = int(datetime.fromisoformat(NOW + "+00:00").timestamp() * 1000)


def written(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
    return path


def test_claude_history(spark, tmp_path):
    entry = lambda display, minutes, session="gone", **more: {"display": display, "timestamp": MS - minutes * 60_000, "project": "/w", "sessionId": session, **more}
    written(tmp_path / "projects/x/logged.jsonl", [{"type": "user"}])
    written(tmp_path / "history.jsonl", [
        entry("told by its log", 90, "logged"), entry("kept", 80), entry("/clear now", 79), entry("/etc/hosts is a path", 78), entry(" <tool>", 77), "no json", entry("", 76), entry("no session", 75, ""), {"display": "no time"},
        entry("young but logged", 1, "logged"), entry("just old enough", 10), entry("young", 9), entry("old, behind a young one", 70),
    ])
    sessions = history.named_sessions(spark, str(tmp_path / "projects"))
    rows = history.claude_history(spark, str(tmp_path), sessions, NOW).collect()
    assert {(r.text, r.session, r.has_usage) for r in rows} == {("kept", "gone", False), ("/etc/hosts is a path", "gone", False), ("no session", "", False), ("just old enough", "gone", False)}
    assert {r.native_key for r in rows} >= {f"hist:gone:{MS - 80 * 60_000}"} and {(r.provider, r.source) for r in rows} == {("anthropic", "claude-code")}


def test_pastes_against_a_substitution(spark):
    rng, rows, want = random.Random(3), [], {}
    cache = {"h1": "kept elsewhere [Pasted text #1]", "h2": ""}
    for k in range(150):
        pasted = {str(n): {"type": rng.choice(["text", "text", "image"]), "content": rng.choice(["", f"<{n}>", "[Pasted text #2]"]), "contentHash": rng.choice([None, "", "h1", "h2", "../h1", "lost"])} for n in rng.sample(range(1, 5), rng.randrange(4))}
        shown = "".join(rng.choice(["[Pasted text #1]", "[Pasted text #2 +4 lines]", "[Pasted text #3]", "[Pasted text #x]", " a ", "$1 \\", "[", ""]) for _ in range(rng.randrange(7)))

        def put(m, pasted=pasted):
            p = pasted.get(m[1])
            if not p or p["type"] != "text":
                return m[0]
            h = p["contentHash"]
            return p["content"] or (cache[h] if h in cache else m[0])

        rows.append((k, shown, pasted or None))
        want[k] = re.sub(history.PASTE, put, shown)
    df = spark.createDataFrame(rows, "key int, shown string, pasted map<string,struct<type:string,content:string,contentHash:string>>")
    got = {r.key: r.text for r in history.expanded(df, spark.createDataFrame(list(cache.items()), "hash string, content string")).collect()}
    assert got == want and any(want[k] != rows[k][1] for k in want)


def test_codex_history_and_audit(spark, tmp_path):
    old, young = MS // 1000 - 3600, MS // 1000 - 60
    a = [{"session_id": "has", "ts": old, "text": "logged"}, {"session_id": "gone", "ts": old, "text": "hi"}, {"session_id": "gone", "ts": old + 1, "text": "<x>"}, {"session_id": "gone2", "ts": young, "text": "young"}, {"session_id": "", "ts": old, "text": "behind a young one"}]
    b = [{"session_id": "gone", "ts": old, "text": "hi"}, {"session_id": "", "ts": old, "text": "no session"}, {"session_id": "gone", "ts": old + 2, "text": "# AGENTS.md"}]
    written(tmp_path / "1/history.jsonl", a)
    written(tmp_path / "2/history.jsonl", b)
    written(tmp_path / "1/sessions/rollout-2026-has.jsonl", ["{}"])
    sessions = history.named_sessions(spark, str(tmp_path), "rollout-*.jsonl", r"rollout-2026-(.*)\.jsonl$")
    assert sorted(r.text for r in history.codex_history(spark, str(tmp_path), sessions, NOW).collect()) == ["hi", "hi", "no session"]
    assert tuple(history.missing_logs(spark, str(tmp_path), sessions, NOW).first()) == (1, 1, 2)


def test_grok_turns(spark, tmp_path):
    turn = lambda n: {"turnNumber": n, "endedAt": f"2026-01-01T0{n}:00:00Z", "inputTokens": 10, "cachedReadTokens": 4, "cacheCreationTokens": 1, "outputTokens": 2, "modelCalls": 3}
    usage = {"sessionId": "", "turns": [turn(1), turn(2) | {"primaryModelId": "own"}, {"turnNumber": 3, "endedAt": "never"}]}
    done = {"params": {"update": {"sessionUpdate": "turn_completed", "usage": {"inputTokens": 1}}}}
    empty = {"params": {"update": {"sessionUpdate": "turn_completed", "usage": None}}}
    for name, updates in (("alone", None), ("told", [done]), ("untold", [empty, "no json"]), ("busy", None)):
        path = written(tmp_path / name / "usage.json", [usage])
        written(tmp_path / name / "summary.json", [{"info": {"id": f"s-{name}", "cwd": "/w"}, "current_model_id": "m"}])
        files = [path] + ([written(tmp_path / name / "updates.jsonl", updates)] if updates else [])
        for f in files:
            os.utime(f, (MS / 1000 - (60 if name == "busy" else 7200),) * 2)
    rows = history.grok_turns(spark, str(tmp_path), NOW).collect()
    assert {(r.session, r.native_key, r.model, r.tok_in, r.cache_r, r.calls) for r in rows} == {(f"s-{s}", f"s-{s}:{n}:2026-01-01T0{n}:00:00Z", m, 5, 4, 3) for s in ("alone", "untold") for n, m in ((1, "m"), (2, "own"))}


def test_absent_fields_are_not_present(spark):
    rows = spark.sql("""select parse_json(v) v from values ('{"a": {"b": 1}}'), ('{"a": null}'), ('{"a": {}}'), ('{}') as t(v)""")
    assert [tuple(r) for r in rows.select(logs.present("$.a"), logs.present("$.a.b")).collect()] == [(True, True), (False, False), (True, False), (False, False)]


def variants(spark, rows):
    return spark.createDataFrame([(f, k, json.dumps(v)) for k, (f, v) in enumerate(rows)], "file string, at long, j string").select("file", "at", F.parse_json("j").alias("v"))


def test_rollout_windows(spark):
    limits = lambda ts, **more: {"timestamp": ts, "payload": {"rate_limits": more}}
    week, hours = {"used_percent": 50, "window_minutes": 10080, "resets_at": 1767225600000}, {"used_percent": 7.5, "window_minutes": 300, "resets_in_seconds": 60}
    rows = [
        ("a", limits("2026-01-01T10:00:00Z", primary=week)), ("a", limits("2026-01-01T11:00:00Z", primary=hours, secondary=hours, limit_name=" x ", plan_type="PRO")), ("a", limits("bad", primary=week)),
        ("b", limits("2026-01-05T11:00:00Z", primary=week)), ("q", {"type": "session_meta", "payload": {"creator_account_id": "owner"}}), ("q", limits("2026-01-05T11:00:00Z", primary=week, secondary={"window_minutes": 0}, plan_type="odd")),
    ]
    probes = spark.createDataFrame([("openai", "", datetime(2026, 1, 1), datetime(2026, 1, 2), "a1")], "provider string, home string, from_ts timestamp, to_ts timestamp, acct string")
    got = {(r.file, r.acct, r.acct_q, r.plan, r.window, r.scope, r.used_percent, str(r.resets_at), r.quota_source) for r in quota.codex_windows(variants(spark, rows), probes, quota_file="q").collect()}
    assert got == {
        ("a", "a1", "timeline", "Pro", "session", "x", 7.5, "2026-01-01 11:01:00", "login-timeline"), ("a", "a1", "timeline", "Pro", "session", "x secondary", 7.5, "2026-01-01 11:01:00", "login-timeline"),
        ("q", "owner", "recorded", "odd", "week", "", 50.0, "2026-01-01 00:00:00", "account-api"),
    }


def test_billing_follows_processes(spark):
    rng, rows, want, held = random.Random(5), [], {}, {}
    for k in range(400):
        ts, pid = f"2026-01-01T{k // 60:02d}:{k % 60:02d}:00Z", str(rng.randrange(4))
        kind = rng.choice(["init", "check", "nobody", "cached", "browser", "bill", "bill", "month", "none", "plain"])
        ctx, msg = {}, "billing: fetched credits config"
        config = {"creditUsagePercent": k % 120, "isUnifiedBillingUser": k % 2 == 0, "currentPeriod": {"type": quota.WEEKLY, "start": "2025-12-30T00:00:00Z", "end": "2026-01-06T00:00:00Z"}}
        if kind in ("init", "nobody"):
            msg = "agent initialized" if kind == "init" else "auth init user_info check"
            held.pop(pid, None)
        elif kind == "check":
            msg, ctx, held[pid] = "auth init user_info check", {"user_id": f"u{k % 3}"}, f"u{k % 3}"
        elif kind in ("cached", "browser"):
            msg, ctx = "auth started", {"method": "cached_token" if kind == "cached" else "browser"}
            if kind == "browser":
                held.pop(pid, None)
        else:
            ctx = {"config": config if kind != "none" else None, "subscriptionTier": " Super "}
            if kind == "month":
                config["currentPeriod"]["type"] = "MONTHLY"
            if kind == "plain":
                del config["creditUsagePercent"]
            used = config.get("creditUsagePercent", 0 if config["isUnifiedBillingUser"] else None)
            if pid in held and kind in ("bill", "plain") and used is not None and used <= 100:
                want[held[pid]] = (float(used), ts.replace("T", " ")[:-1], quota.SHARED if config["isUnifiedBillingUser"] else "")
        rows.append(("f", {"ts": ts, "pid": int(pid) if k % 2 else pid, "msg": msg, "ctx": ctx}))
    got = {r.acct: (r.used_percent, str(r.observed_at), r.detail) for r in quota.grok_billing(variants(spark, rows)).collect()}
    assert got == want and len(want) == 3


def test_meters_of_silent_organisations(spark):
    schema = "org string, resets_at timestamp, used double"
    kept = spark.createDataFrame([("a", datetime(2026, 1, 1), 1.0), ("b", datetime(2025, 12, 25), 2.0), ("c", datetime(2025, 12, 1), 3.0), ("d", None, 4.0)], schema)
    current = spark.createDataFrame([("a", datetime(2026, 1, 8), 9.0)], schema)
    assert {(r.org, r.used) for r in quota.kept_meters(kept, current, NOW).collect()} == {("a", 9.0), ("b", 2.0)}


CELL = "machine string, date string, provider string, source string, model string, acct string, q string, tok_in long, cache_w long, cache_w1h long, cache_r long, tok_out long, reasoning long, events long, prompts long, prompts_no_usage long, model_prompts long"


def cells(spark, n=200):
    rng = random.Random(2)
    key = lambda k: (rng.choice("ab"), f"2026-0{1 + k % 2}-{1 + k % 28:02d}", rng.choice(published.PROVIDERS), "s", rng.choice(["", 'm "quoted" ]', "ü\n"]), rng.choice(["", "acct"]), rng.choice(["exact", "estimated"]))
    return spark.createDataFrame([(*x, *(rng.randrange(5) for _ in range(10))) for x in {key(k): None for k in range(n)}], CELL)


def test_published_files_round_trip(spark):
    df = cells(spark)
    got = published.usage_rows(published.monthly(df))
    assert sorted(map(tuple, got.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_files_do_not_depend_on_partitions(spark, tmp_path):
    digests = set()
    for n, folder in ((1, "x"), (7, "y")):
        published.write_monthly(published.monthly(cells(spark).orderBy(F.rand(n)).repartition(n)), str(tmp_path / folder))
        files = sorted((str(p.relative_to(tmp_path / folder).parent), hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / folder).rglob("part-*"))
        digests.add(str(files))
    assert len(digests) == 1 and len(files) == 4


def test_odd_published_files(spark):
    file = lambda **f: json.dumps(f)
    good = ["2026-01-01", "openai", "s"]
    rows = [
        ("no json", "{"), ("unnamed", file(rows=[[*["2026-01-01", "xai", "s", "m", "a", "e"], 1, 2, 3, 4, 5, 6, 7, 8]])), ("not a list", file(cols=["date"], rows={"a": 1})),
        ("bad rows", file(cols=["date", "provider", "source", "in"], rows=[[*good, 5.9], [*good, -1], [*good, "7"], "x", None, ["yesterday", "openai", "s", 1], ["2026-01-01", "nobody", "s", 1], [*good]])),
        ("bad names", file(cols=["date", 1], rows=[["2026-01-01", "openai", "s", "", "", "", 3]])), ("twice", file(cols=["date", "in", "provider", "in"], rows=[["2026-01-02", 1, "google", 2]])),
        ("known", file(cols=["date", "provider", "modelPrompts"], rows=[["2026-01-03", "cursor", 4]])),
    ]
    got = published.usage_rows(spark.createDataFrame(rows, "machine string, value string"))
    assert sorted((r.machine, r.tok_in) for r in got.collect()) == [("bad names", 3), ("bad rows", 0), ("bad rows", 0), ("bad rows", 0), ("bad rows", 5), ("known", 0), ("twice", 2), ("unnamed", 1)]
    assert {(r.machine, r.q, r.prompts, r.model_prompts) for r in got.where("machine in ('unnamed', 'known')").collect()} == {("unnamed", "estimated", 8, None), ("known", "exact", 0, 4)}
    days = {(r.date, r.provider): r.models_known for r in published.fleet_days(got).collect()}
    assert days[("2026-01-03", "cursor")] and not days[("2026-01-01", "xai")]


def test_account_totals(spark):
    ledger = spark.createDataFrame([("m", "2026-01-02", "openai", "codex", "a", 5), ("m", "2026-01-01", "openai", "codex", "", 7), ("m", "2026-01-03", "openai", "codex", "a", 0)], "machine string, date string, provider string, source string, acct string, tokens long")
    files = published.totals_file(ledger)
    assert sorted(map(tuple, published.ledger_rows(files).collect())) == sorted(map(tuple, ledger.where("tokens > 0").collect()))
    assert published.ledger_rows(spark.createDataFrame([("m", '{"ledger": [["2026-01-01", "openai", "codex", "", 7]]}')], "machine string, value string")).count() == 0


def test_nothing_published(spark):
    assert published.usage_rows(published.monthly(cells(spark).limit(0))).count() == 0
