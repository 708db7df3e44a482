"""Every registered query of the core against its SQL on an independent engine."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from loomwell.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


#: Queries without SQL, each with a test below that holds it against Python.
BRUTE = {"tx2_replay_transfers", "tx7_boat_cut", "tx6_components_whole", "tx8_revert_closure_whole"}


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, duck, data, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    text = catalog.oracle_sql().get(name)
    if text is None:
        assert got and name in BRUTE, f"{name} needs SQL or a test of its own below"
        return
    cur = duck.execute(text)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_boat_cut_in_python(spark, data):
    got = {r["pos"] for r in catalog.queries()["tx7_boat_cut"](spark, data).filter("aboard").collect()}
    items = catalog.table(spark, data, "events").selectExpr("user_id % 16 AS worker", "event_id", "cast(round(value * 100) AS bigint) AS bytes").orderBy("event_id").collect()
    want, used = set(), {}
    for r in items:
        if r["worker"] not in used or used[r["worker"]] + r["bytes"] <= 100_000:
            used[r["worker"]] = used.get(r["worker"], 0) + r["bytes"]
            want.add(r["event_id"])
    assert got == want


def test_replay_in_python(spark, data):
    got = {r["txn"]: r["accepted"] for r in catalog.queries()["tx2_replay_transfers"](spark, data).collect()}
    balance, want = {}, {}
    for r in catalog.tx_transfers(spark, data).orderBy("seq").collect():
        ok = balance.get(r["src"], 100) >= r["amt"]
        if ok:
            balance[r["src"]] = balance.get(r["src"], 100) - r["amt"]
            balance[r["dst"]] = balance.get(r["dst"], 100) + r["amt"]
        want[r["txn"]] = ok
    assert got == want and not all(want.values())


def test_trace_hash_of_whole_logs(spark, data):
    got = {r["user_id"]: r["hash"] for r in catalog.queries()["df23_trace_hash_whole"](spark, data).collect()}
    want = {}
    for r in catalog.table(spark, data, "events").orderBy("event_id").collect():
        h = want.get(r["user_id"], 0xCBF29CE484222325)
        for b in r["event_type"].encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        want[r["user_id"]] = h
    assert got == {u: str(h) for u, h in want.items()}
    # the log's first 400 events give other hashes
    part = {r["user_id"]: r["hash"] for r in catalog.queries()["df23_trace_hash"](spark, data).collect()}
    assert part != got


def test_nocase_order_of_all_customers(spark, data):
    got = [tuple(r) for r in catalog.queries()["so3_nocase_whole"](spark, data).collect()]
    want = sorted(((r["c_name"].lower(), r["c_custkey"]) for r in catalog.table(spark, data, "customer").collect()))
    assert got == [(k, low) for low, k in want] and len(got) > 20


def orders_of(spark, data):
    """Components of orders that share a part, over the whole table: (order -> least order, order -> parts)."""
    root, first, parts = {}, {}, {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for o, p in catalog.table(spark, data, "lineitem").select("l_orderkey", "l_partkey").distinct().collect():
        root.setdefault(o, o)
        parts.setdefault(o, set()).add(p)
        a, b = find(o), find(first.setdefault(p, o))
        root[max(a, b)] = min(a, b)
    return {o: find(o) for o in root}, parts


def test_components_of_the_whole_table(spark, data):
    want, parts = orders_of(spark, data)
    assert dict(catalog.queries()["tx6_components_whole"](spark, data).collect()) == want
    hit = {want[o] for o in want if any(p % 10 == 3 for p in parts[o])}
    got = {r["txn"] for r in catalog.queries()["tx8_revert_closure_whole"](spark, data).collect()}
    assert got == {o for o in want if want[o] in hit}


def test_only_whole_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert not set(catalog.PARTS) & set(names) and {n + "_whole" for n in catalog.PARTS} <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_without_the_operators_subpackage(tmp_path):
    """A copy of the repository without the subpackage and its tests imports and answers."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(here):
        if name.endswith(".py"):
            shutil.copy(f"{here}/{name}", tmp_path / name)
    shutil.copytree(f"{here}/loomwell", tmp_path / "loomwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'lg3_fold_committed' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(s) <= set(q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.strip().endswith("fine"), out.stderr
