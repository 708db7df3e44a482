import random

from pyspark.sql import functions as F

from loomwell.functions import scalar
from loomwell.operators import grants, log, placement, polls, txn
from loomwell.operators.components import connected_components
from loomwell.sources.blobs import Files, Memory, blobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_frozen_hashes(spark):
    got = rows(spark.createDataFrame([("alice",), ("bob",)], "o string").select("o", scalar.default_worker(F.col("o"), 4096)))
    assert got == [("alice", 2311), ("bob", 2644)]
    assert scalar.poll_hash('[{"rows":[]}]') == "4bf9765328d07878"
    assert scalar.poll_hash('[{"rows":[{"n":1}]}]') == "94228ea8dcfd592b"


def test_components(spark):
    parts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c")], "txn int, object string")
    assert rows(txn.transaction_components(parts)) == [(0, 0), (1, 0), (2, 0), (3, 3)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 900), (None, 5)], "a int, b int")
    got = dict(connected_components(chain).collect())
    assert set(got.values()) == {0, 900} and len(got) == 202
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_fold_stops_at_the_first_gap(spark):
    e = spark.createDataFrame([("x", s, f"t{s}", 0, "snapshot" if s in (2, 5) else "delta", f"p{s}") for s in (1, 2, 3, 5)] + [("y", 4, "u4", 0, "delta", "q")], "object string, seq long, txn string, born long, kind string, payload string")
    o = spark.createDataFrame([(f"t{s}", True) for s in (1, 2, 3, 5)] + [("u4", True)], "txn string, committed boolean")
    b = spark.createDataFrame([("y", 3), ("z", 9)], "object string, base_seq long")
    assert rows(log.fold_committed(e, o, b)) == [("x", 0, 3, "p2", 1), ("y", 3, 4, None, 1), ("z", 9, 9, None, 0)]


def test_fold_across_buckets(spark):
    n = log.BUCKET * 2 + 10
    e = spark.range(1, n + 1).select(F.lit("x").alias("object"), F.col("id").alias("seq"), F.col("id").cast("string").alias("txn"), F.lit("delta").alias("kind"), F.lit("").alias("payload"))
    o = e.select("txn", (F.col("seq") != log.BUCKET + 7).alias("committed"))
    assert rows(log.committed_seq(e, o)) == [("x", 0, log.BUCKET + 6)]


def test_validate(spark):
    t = spark.createDataFrame([("1", ["b", "a", "a"], [("a",)]), ("2", [], []), ("3", ["_x"], []), ("4", ["a"], [("b",)])], "txn string, objects array<string>, ops array<struct<object:string>>")
    assert {r["txn"]: r["error"] for r in txn.validate(t).collect()} == {"1": None, "2": "no objects", "3": "invalid object id", "4": "undeclared object"}


def test_blocks_tile(spark):
    got = rows(spark.range(7).select(*placement.block_range(F.col("id"), 7, 100)))
    assert got[0][0] == 0 and got[-1][1] == 100 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_tokens():
    token = grants.mint(b"k", [{"objects": ["log*"], "verbs": ["insert"]}], 100)
    assert grants.verify(b"k", token, 99)["grants"][0]["verbs"] == ["insert"]
    assert grants.verify(b"k", token, 100) is None and grants.verify(b"other", token, 0) is None and grants.verify(b"k", "x", 0) is None


def test_stores(spark, tmp_path):
    m = Memory()
    assert m.create("a/b", b"1") and not m.create("a/b", b"2") and m.version("a/b") == 1
    assert m.put_cas("a/b", 1, b"22") and not m.put_cas("a/b", 1, b"3") and m.get_range("a/b", 1, 9) == b"2"
    f = Files(spark, f"file://{tmp_path}/s")
    assert f.list() == [] and f.create("a/b", b"12345") and not f.create("a/b", b"2")
    assert f.get("a/b") == b"12345" and f.get_range("a/b", 3, 9) == b"45" and f.get("none") is None
    f.put("a/c", b"x")
    assert f.list("a/") == ["a/b", "a/c"]
    assert rows(blobs(spark, f"file://{tmp_path}/s").select("key", "length")) == [("b", 5), ("c", 1)]
    f.delete("a/b")
    assert f.list() == ["a/c"]


def test_scalar_dialect(spark):
    df = spark.createDataFrame([("12abc", "NATION_1")], "s string, n string")
    got = df.select(scalar.to_integer(F.col("s")), scalar.glob(F.col("n"), "NA*_[0-4]"), scalar.glob(F.col("n"), "na*"), scalar.quote(F.col("s"), "string"), scalar.int_div(F.lit(-7), F.lit(2)), scalar.int_mod(F.lit(5), F.lit(0)), scalar.add_months_overflowing(F.lit("2024-01-31").cast("date"), 1).cast("string")).first()
    assert tuple(got) == (12, True, False, "'12abc'", -3, None, "2024-03-02")


def test_scratch_goes_with_its_space(spark):
    from loomwell.sources.shared import scratch_space, stored

    kept = stored(spark.range(3), "kept")
    with scratch_space(spark):
        a = stored(spark.range(5), "a")
        with scratch_space(spark):
            b = stored(spark.range(7), "b")
            there = [f.split("/")[-2] for f in (*a.inputFiles(), *b.inputFiles())]
        assert a.count() == 5
    left = {p.split("/")[-2] for p in kept.inputFiles()}
    fs = Files(spark, spark.conf.get("spark.checkpoint.dir"))
    folders = {k.split("/")[0] for k in fs.list()}
    assert left <= folders and not set(there) & folders and kept.count() == 3


def reasons(waiting, stops):
    """What ends each of (poll, conn, object, since), by looking at every event (at, kind, conn, object)."""
    says = {"fire": "answer", "schema": "error", "cancel": "dropped", "gone": "dropped", "migrate": "re-poll", "revert": "re-poll", "shutdown": "re-poll"}

    def concerns(p, e):
        if e[1] in ("cancel", "gone"):
            return e[2] is not None and e[2] == p[1]
        return e[1] == "shutdown" or (e[1] in says and e[3] is not None and e[3] == p[2])

    hits = [(p[0], e[0], e[1]) for p in waiting for e in stops if concerns(p, e) and None not in (p[3], e[0]) and e[0] > p[3]]
    first = {}
    for poll, at, kind in hits:
        first[poll] = min(first.get(poll, (at, kind)), (at, kind))
    return [(p[0], says[first[p[0]][1]] if p[0] in first and p[0] is not None else None) for p in waiting]


def test_ends_of_polls_in_python(spark):
    """Nulls, ties, repeated ids and places, two restarts, gaps of many buckets."""
    r = random.Random(6)
    some = lambda *of: None if r.random() < 0.05 else r.choice(of)
    place = lambda: some(r.randrange(-5, 5), r.randrange(4090, 4100), r.randrange(8191, 8194), r.randrange(10**6), 10**12)
    kinds = ("fire", "schema", "migrate", "revert", "cancel", "gone", "nothing")
    waiting = [(some(i, i - 1), some(*range(9)), some(*"abcdefgh", "alone"), place()) for i in range(500)]
    for n, down in ((150, [9, 8192]), (12, [])):
        stops = [(place(), r.choice(kinds), some(*range(8)), some(*"abcdefgh")) for _ in range(n)] + [(t, "shutdown", None, None) for t in down]
        got = polls.ended(spark.createDataFrame(waiting, "poll long, conn int, object string, since long"), spark.createDataFrame(stops, "at long, kind string, conn int, object string"))
        want = reasons(waiting, stops)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len({x[1] for x in want}) > 3
    assert polls.ended(spark.createDataFrame([], "poll long, conn int, object string, since long"), spark.createDataFrame(stops, "at long, kind string, conn int, object string")).count() == 0


def most_rows(plan):
    """Rows that the largest step of a plan that ran has made."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    own, count = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())], plan.metrics().get("numOutputRows")
    return max([count.get().value() if count.isDefined() else 0, *map(most_rows, own)])


def test_polls_and_events_of_a_connection_do_not_multiply(spark):
    n = 2000
    waiting = spark.range(n).selectExpr("id AS poll", "1 AS conn", "2 AS object", "id % 7 AS since")
    stops = spark.range(n).selectExpr("id + 5 AS at", "CASE WHEN id < 1900 THEN 'nothing' WHEN id % 3 = 0 THEN 'cancel' WHEN id % 3 = 1 THEN 'shutdown' ELSE 'migrate' END AS kind", "1 AS conn", "2 AS object")
    ended = polls.ended(waiting, stops)
    assert [tuple(r) for r in ended.groupBy("reason").count().collect()] == [("re-poll", n)]
    assert len(ended.collect()) == n and most_rows(ended._jdf.queryExecution().executedPlan()) <= 2 * n
