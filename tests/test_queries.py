"""Every query with SQL against DuckDB on the same tables."""

import datetime
import math
import os

import duckdb
import pytest

from talliard.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else value


def in_order(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = duck.execute(registry.ORACLE_SQL[name])
    assert sorted(d[0] for d in found.description) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"select {quoted} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert in_order(df.select(*columns).collect()) == in_order(want)


def test_lookups_over_whole_tables(spark, duck):
    (events,) = duck.execute("select count(*) from events").fetchone()
    for name in ("jn_11_nearest_sample", "jn_12_last_before"):
        assert registry.QUERIES[name](spark, DIR).count() == events


def test_history_over_whole_tables(spark):
    rows = registry.QUERIES["ag_01_day_rollup"](spark, DIR)
    totals = registry.QUERIES["mg_16_newest_total"](spark, DIR)
    months = {r[0] for r in rows.selectExpr("substr(date, 1, 7)").distinct().collect()}
    assert len(months - {r[0] for r in totals.selectExpr("substr(date, 1, 7)").distinct().collect()}) <= 1
    assert registry.QUERIES["cx_01_reconcile"](spark, DIR).agg({"date": "max"}).first()[0] > "1998-11"
    radii = registry.QUERIES["cx_04_shares_by_radius"](spark, DIR).selectExpr("radius", "substr(date, 9, 2) as day").distinct().collect()
    assert len({r.day for r in radii}) > 25 and {r.radius for r in radii} == set(range(8))


def test_account_hash_is_a_keyed_digest(spark):
    import hashlib
    import hmac

    rows = registry.QUERIES["fn_03_account_hash"](spark, DIR).limit(5).collect()
    for r in rows:
        assert r.hash == "a_" + hmac.new(registry.KEY, f"{r.provider}|{r.acct}".encode(), hashlib.sha256).hexdigest()[:16]
