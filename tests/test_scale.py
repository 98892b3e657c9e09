"""What holds at size, seen on small tables: plans without a second shuffle, files in pieces, batches that end anywhere."""

import os
from datetime import datetime

import duckdb
import pytest

from talliard.operators.merge import merge_usage
from talliard.plans import registry
from talliard.plans.catalog import merged
from talliard.sources import adapter, logs, published

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@tables
def test_merging_shuffles_lines_once(spark, shuffled_joins):
    """Lines meet their order, and what an order's lines become is merged where it is."""
    found = plan(merged(spark, DIR))
    assert "hashpartitioning(l_orderkey#" in found and "hashpartitioning(id#" not in found and found.count("hashpartitioning(o_custkey#") == 1


@tables
@pytest.mark.parametrize("name", ["cx_17_unledgered", "cx_17_salvage"])
def test_two_rollups_of_one_pass(spark, shuffled_joins, name):
    """Events are merged once for both rollups, and shuffled once behind that, by what a cell and its namesakes share."""
    found = plan(registry.QUERIES[name](spark, DIR))
    assert found.count("hashpartitioning(l_orderkey#") == 1
    assert [x.split("#")[0] for x in found.split("hashpartitioning(")[1:]].count("date") == (2 if name == "cx_17_unledgered" else 1)


@tables
def test_merging_within_what_an_id_determines(spark, shuffled_joins):
    assert sorted(merged(spark, DIR).collect()) == sorted(merge_usage(adapter.usage_events(spark, DIR)).collect())


def carried(df) -> list[list[str]]:
    """What each explode of a plan carries along for every row that it makes."""
    found = []
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Generate":
            found.append([node.requiredChildOutput().apply(k).name() for k in range(node.requiredChildOutput().size())])
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_rows_of_a_file_leave_the_file_behind(spark, tmp_path):
    files = spark.createDataFrame([("m", '{"cols": ["date", "provider"], "rows": [["2026-01-01", "openai"]]}')], "machine string, value string").repartition(1)
    for rows in (published.usage_rows(files), published.ledger_rows(files)):
        assert carried(rows) and all(set(c) <= {"machine", "places"} for c in carried(rows))
    (tmp_path / "session-1.json").write_text('{"sessionId": "a", "messages": [{"id": "1", "type": "user", "timestamp": "2026-01-01T00:00:00Z", "content": "hi"}]}')
    for rows in logs.gemini(spark, str(tmp_path)):
        assert carried(rows) and all(set(c) <= {"file", "session"} for c in carried(rows))


def against_sql(spark, name: str, folder: str, *names: str) -> tuple[list, list]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in names:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, folder)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in df.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(want, key=str)


def test_billing_of_an_old_kind_above_the_whole(spark, tmp_path):
    """An account's newest event is of the old kind and above 100, or has no value: neither is a reading."""
    rows = [(1, 5, 1.0), (10, 5, 50.0), (16, 5, 200.0), (17, 5, None), (21, 8, 1.0), (52, 8, 70.0), (56, 8, 40.0)]
    events = spark.createDataFrame([(n, u, "click", datetime(2024, 1, 1, 0, n), v) for n, u, v in rows], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got, want = against_sql(spark, "pr_24_billing", str(tmp_path), "events")
    assert [(r[0], r[1]) for r in want] == [("u5", 50.0), ("u8", 0.0)] and got == want


def test_prompts_that_wait_at_the_end_of_many_conversations(spark, tmp_path):
    """With very many conversations, too, the transcripts are of the past, so that what waits at their end goes out."""
    rows = [(k, turn, role, f"{role} {k}") for k in (3, 600_003, 600_004) for turn, role in ((0, "user"), (1, "assistant"), (2, "user"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = against_sql(spark, "ss_07_waiting_prompts", str(tmp_path), "conversations")
    assert len(want) == 6 and got == want
