"""Log readers on small files written here."""

import json

import pytest

from talliard.operators import merge
from talliard.sources import logs


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return path


def at(minute):
    return f"2026-09-20T10:{minute:02d}:00Z"


def answer(minute, message, model, out, **more):
    return {"type": "assistant", "uuid": f"u{minute}", "sessionId": "s", "timestamp": at(minute), "cwd": "/w", "message": {"id": message, "model": model, "usage": {"input_tokens": 3, "output_tokens": out, "cache_creation": {"ephemeral_1h_input_tokens": 2}}}, **more}


def said(minute, content, **more):
    return {"type": "user", "uuid": f"p{minute}", "sessionId": "s", "timestamp": at(minute), "cwd": "/w", "message": {"content": content}, **more}


def test_claude(spark, tmp_path):
    put(tmp_path / "projects/a/t.jsonl", [
        said(0, "first"), {"type": "attachment", "timestamp": at(0), "attachment": {"type": "credential_org", "organizationUuid": "org"}},
        answer(1, "m1", "opus", 5), answer(2, "m1", "opus", 9), answer(3, "m2", "<synthetic>", 1), "no json", '{"type": "assistant", "trunc',
        said(4, [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]), said(5, [{"type": "tool_result"}]), said(6, [{"type": "image"}]),
        said(7, "<tag> system"), said(8, "<b> typed", promptSource="typed"), said(9, "hidden", isMeta=True), said(10, "[Request interrupted by user]"), said(11, "task", origin={"kind": "task"}),
        {"type": "attachment", "uuid": "q", "sessionId": "s", "timestamp": at(12), "attachment": {"type": "queued_command", "prompt": "queued", "commandMode": "prompt", "origin": {"kind": "human"}}},
        answer(13, "", "sonnet", 1, requestId="r1"), said(14, "last"),
    ])
    usage, prompts = logs.claude(spark, str(tmp_path))
    got = {r.native_key: (r.model, r.tok_in, r.tok_out, r.cache_w1h, r.hint, r.ts.minute) for r in usage.collect()}
    assert got == {"m1": ("opus", 3, 9, 2, "org", 1), "r1": ("sonnet", 3, 1, 2, "org", 13)}
    got = [(r.native_key, r.text, r.model) for r in prompts.orderBy("ts").collect()]
    assert got == [("p0", "first", "opus"), ("p4", "a\nb", "sonnet"), ("p6", "[image]", "sonnet"), ("p8", "<b> typed", "sonnet"), ("q", "queued", "sonnet"), ("p14", "last", "")]


def line(minute, kind, **payload):
    return {"timestamp": at(minute), "type": kind, "payload": payload}


def count(minute, total, last=True):
    return line(minute, "event_msg", type="token_count", info={"total_token_usage": {"total_tokens": total}, "last_token_usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 1} if last else None})


def user(minute, text, **more):
    return line(minute, "response_item", type="message", role="user", content=[{"type": "input_text", "text": text}]) | more


NAME = "rollout-2026-09-20T10-00-00-01234567-89ab-cdef-0123-456789abcdef.jsonl"


def test_codex_counter(spark, tmp_path):
    put(tmp_path / "sessions" / NAME, [
        line(0, "session_meta", id="r", cwd="/w", creator_account_id="acc"), line(0, "session_meta", id="parent", cwd="/x"), line(1, "turn_context", model="gpt", turn_id="t1"),
        count(2, 100), count(3, 100), count(4, 150, last=False), count(5, 150), count(6, 40), line(7, "token_usage_record", response_id="x", usage={"input_tokens": 7}), count(8, 60),
    ])
    usage, _ = logs.codex(spark, str(tmp_path))
    got = {r.native_key: (r.session, r.model, r.tok_in, r.cache_r, r.cwd, r.hint) for r in usage.collect()}
    assert got == {"r:0:100": ("r", "gpt", 6, 4, "/w", "acc"), "r:1:40": ("r", "gpt", 6, 4, "/w", "acc"), "x": ("r", "gpt", 7, 0, "/w", "acc")}


def started(minute, turn):
    return line(minute, "event_msg", type="task_started", turn_id=turn)


def turn(minute, name, model):
    return line(minute, "turn_context", turn_id=name, model=model)


@pytest.mark.parametrize(("rows", "want"), [
    ([user(0, "early"), started(1, "t1"), turn(2, "t1", "m1")], {"early": "m1"}),
    ([started(0, "t1"), turn(1, "t1", "m1"), user(2, "own"), started(3, "t2"), user(4, "before"), turn(5, "t2", "m2")], {"own": "m1", "before": "m2"}),
    ([started(0, "t1"), turn(1, "t1", "m1"), started(2, "t2"), user(3, "lost"), started(4, "t3"), turn(5, "t3", "m3")], {"lost": "m1"}),
    ([user(0, "<environment>"), user(1, "# AGENTS"), user(2, "copied", metadata={"inherited_user_message": True}), user(3, "alone")], {"alone": ""}),
    ([user(0, "early"), started(1, "t1"), started(2, "t2"), turn(3, "t2", "m2")], {"early": ""}),
])
def test_codex_prompt_models(spark, tmp_path, rows, want):
    put(tmp_path / NAME, rows)
    assert {r.text: r.model for r in logs.codex(spark, str(tmp_path))[1].collect()} == want


def test_gemini(spark, tmp_path):
    ask = lambda k, text: {"id": f"u{k}", "timestamp": at(k), "type": "user", "content": text}
    reply = lambda k, model, n: {"id": f"g{k}", "timestamp": at(k), "type": "gemini", "model": model, "tokens": {"input": n, "cached": 4, "output": 2, "thoughts": 3, "tool": 1}}
    put(tmp_path / "chats/session-1.json", [{"sessionId": "g", "messages": [ask(0, "hi"), reply(1, "", 10), ask(2, [{"text": "a"}, {"text": "b"}]), reply(3, "flash", 2), ask(4, "  ")]}])
    usage, prompts = logs.gemini(spark, str(tmp_path))
    assert {r.native_key: (r.tok_in, r.cache_r, r.tok_out, r.reasoning) for r in usage.collect()} == {"g:g1": (7, 4, 5, 3), "g:g3": (1, 4, 5, 3)}
    assert {r.native_key: (r.text, r.model, r.has_usage) for r in prompts.collect()} == {"g:u0": ("hi", "", True), "g:u2": ("a\nb", "flash", True)}


def update(minute, event, kind, **more):
    return {"timestamp": 1_758_362_400 + 60 * minute, "params": {"update": {"sessionUpdate": kind, **more}, "_meta": {"eventId": event}}}


def test_grok(spark, tmp_path):
    chunk = lambda k, event, text=None, **meta: update(k, event, "user_message_chunk", content={"type": "text" if text else "image", "text": text or ""}, _meta=meta)
    counts = {"inputTokens": 9, "cachedReadTokens": 4, "outputTokens": 2, "modelCalls": 3}
    put(tmp_path / "s1/summary.json", [{"info": {"id": "s1", "cwd": "/w"}, "current_model_id": "fast"}])
    put(tmp_path / "s2/summary.json", [{"info": {"id": "s2", "cwd": "/w"}, "parent_session_id": "s1"}])
    put(tmp_path / "s1/updates.jsonl", [
        update(0, "e0", "turn_completed", usage=counts), chunk(1, "e1", "one", modelId="code"), chunk(2, "e2"), chunk(3, "e3", "two"), update(4, "e4", "other"), chunk(5, "e5", "<system-reminder> x"),
        update(6, "e6", "turn_completed", usage={**counts, "modelUsage": {"a": counts, "b": counts}}), chunk(7, "e7", "quiet", hideFromScrollback=True), update(8, "e8", "other"), chunk(9, "e9"),
    ])
    put(tmp_path / "s2/updates.jsonl", [chunk(1, "d1", "delegated")])
    usage, prompts = logs.grok(spark, str(tmp_path))
    assert {r.native_key: (r.model, r.session, r.tok_in, r.calls) for r in usage.collect()} == {"e0:fast": ("fast", "s1", 5, 3), "e6:a": ("a", "s1", 5, 3), "e6:b": ("b", "s1", 5, 3)}
    assert {r.native_key: (r.text, r.model) for r in prompts.collect()} == {"e1": ("one", "code"), "e3": ("two", ""), "e9": ("[image]", "")}


def test_events_merge_with_themselves(spark, tmp_path):
    put(tmp_path / "a.jsonl", [answer(1, "m1", "opus", 5)])
    put(tmp_path / "copy/a.jsonl", [answer(1, "m1", "opus", 7)])
    rows = logs.events(logs.claude(spark, str(tmp_path))[0], b"key", "m_1")
    merged = merge.merge_usage(rows).collect()
    assert len(merged) == 1 and merged[0].tok_out == 7 and merged[0].ws.startswith("w_")
