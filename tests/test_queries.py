"""Every core query against its SQL, over the small tables."""

import datetime
import decimal
import glob
import math
import os

import pytest

from overstrata.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v) if isinstance(v, (decimal.Decimal, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in Q.oracle_sql():
        assert got
        return
    res = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["runtime_id", "chain_length", "winner_package", "event_id"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_repaired_order(spark):
    place = {r.package: r.position for r in Q.load_order_repair(spark, SF).collect()}
    assert all(place[n] > place[n + 1] for n in place if n % 4 != 3 and n + 1 in place)


def test_every_user_has_a_record(spark, tmp_path):
    """Users that agree modulo 2,000 stay apart, in the compact package too; ids beyond 24 bits are an error."""
    users = [*range(0, 9000, 7), 1, 2001, 4001, 6001, 16_000_000]
    rows = [(i, "abcde"[i % 5], users[(i // 5) % len(users)], datetime.datetime(2024, 1, 1), 1.0) for i in range(10 * len(users))]
    schema = "event_id long, event_type string, user_id long, ts timestamp, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    latest, chains = {}, {}
    for i, kind, u, *_ in rows:
        latest[kind, u] = i
    for kind, u in sorted(latest):
        owner = min(u % 3, "abcde".index(kind))
        chains.setdefault((u, 0 if owner == 1 and u + 2048 > 4095 else owner), []).append(latest[kind, u])
    got = Q.override_chain_winner(spark, str(tmp_path)).collect()
    assert sorted((r.chain_length, r.event_id) for r in got) == sorted((len(c), c[-1]) for c in chains.values())
    assert len(got) == len({r.runtime_id for r in got}) == len(chains)
    members = Q.override_chain_members(spark, str(tmp_path))
    assert sorted(r.event_id for r in members.collect()) == sorted(latest.values())
    spark.createDataFrame([(1, "a", 1 << 24, datetime.datetime(2024, 1, 1), 1.0)], schema).write.parquet(f"{tmp_path}/far/events.parquet")
    with pytest.raises(Exception, match="LocalIdentifierOutOfRange"):
        Q.override_chain_winner(spark, f"{tmp_path}/far").collect()


def test_displays_of_odd_customers(spark, duck, tmp_path):
    """Minus zeros, floats that round to one, keys beyond 32 bits, below zero or missing, as the SQL has them over the same rows."""
    values = [0.0, -0.0, -1e-50, -1e-46, -1e-45, 1e-45, -0.01, 0.01, float("inf"), float("-inf"), float("nan"), None]
    keys = [None, -5, -2, -1, 0, (1 << 32) - 2, (1 << 32) - 1, 1 << 32, 60_000_000_001]
    rows = [*enumerate(values), *((k, 1.0) for k in keys)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = [tuple(r) for r in Q.queries()["value_displays"](spark, str(tmp_path)).select("c_custkey", "tail", "shown", "compact", "sign").collect()]
    con = duck.cursor()
    con.execute(f"create temp view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(got, key=repr) == sorted(con.execute(Q.oracle_sql()["value_displays"]).fetchall(), key=repr)
    assert [x[-1] for x in got[: len(values)]] == ["-" if v in (-1e-45, -0.01, float("-inf")) else "+" for v in values]
