"""Estimates against labels and brute force, planted cases, clashing names, empty tables and hot keys."""

import zlib
from itertools import product
from random import Random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.llm import factorisation, index, mixing, packing, pii, quality_rules, queries, simhash, token_files, urls
from loomwell.llm.common import scratch, stored, table

CLASH = "doc_id long, text string, lang string, source string, n_chars long, mix string, mix_in int, mix_copy int, mix_position int, `full` string, __shard int, `order` string, sequence_id int, spans string, sid int"


def clashing(spark, n=40):
    rng = Random(1)
    rows = [(i, " ".join(f"word{rng.randrange(900)}" for _ in range(60 + i)), "en", f"s{i % 3}", 1, "m", 2, 3, 4, "f", 5, "o", 6, "p", 7) for i in range(n)]
    return spark.createDataFrame(rows + [(None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)], CLASH)


# ---- quality rules


def slow_em(patterns, aspects, rounds=200):
    """The same estimate with loops over documents."""
    kinds = list(dict.fromkeys(aspects))
    share = [quality_rules.START_GOOD] + [(1 - quality_rules.START_GOOD) / len(kinds)] * len(kinds)
    start = [[quality_rules.GOOD if c == 0 else quality_rules.OWN if aspects[r] == kinds[c - 1] else quality_rules.OTHER for r in range(len(aspects))] for c in range(1 + len(kinds))]
    chance = [[list(v) for v in c] for c in start]
    for _ in range(rounds):
        total = [0.0] * len(share)
        cast = [[[0.0] * 3 for _ in aspects] for _ in share]
        for votes, n in patterns:
            p = [share[c] for c in range(len(share))]
            for c, r in product(range(len(share)), range(len(aspects))):
                p[c] *= chance[c][r][votes[r] + 1]
            for c in range(len(share)):
                w = n * p[c] / sum(p)
                total[c] += w
                for r in range(len(aspects)):
                    cast[c][r][votes[r] + 1] += w
        chance = [[[(cast[c][r][v] + quality_rules.WORTH * start[c][r][v]) / (total[c] + quality_rules.WORTH) for v in range(3)] for r in range(len(aspects))] for c in range(len(share))]
        share = [(t + 1) / (sum(total) + len(share)) for t in total]
    return np.array(share), np.array(chance)


def test_estimate_against_loops():
    rng = Random(2)
    aspects = ["a", "a", "b", "b", "b"]
    patterns = [(tuple(rng.choice((-1, 0, 1, 1, 1)) for _ in aspects), rng.randrange(1, 50)) for _ in range(40)]
    got, want = quality_rules.reliabilities(patterns, aspects, 200), slow_em(patterns, aspects, 200)
    assert np.allclose(got[0], want[0], atol=1e-6) and np.allclose(got[1], want[1], atol=1e-6)


@pytest.fixture(scope="module")
def judged(spark, data):
    sf = data.replace("sf0.001", "sf0.1")
    counts = stored(quality_rules.measured(table(spark, sf, "documents")), "t-counts").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return counts.withColumns({f"made_{k}": v for k, v in quality_rules.verdicts(counts).items()}).cache()


def test_verdicts_are_not_all_must_pass(judged):
    bad = sum((r.vote() == -1).cast("int") for r in quality_rules.rules())
    kept = judged.filter("made_kept").withColumn("bad", bad).filter("bad > 0")
    assert kept.count() >= 20 and kept.filter("quality = 0").count() == 0 and kept.filter("quality = 1").count() > 5
    assert judged.filter("not made_base_failed and quality is not null").agg(F.avg((F.col("made_kept") == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.99


def test_estimated_accuracies_are_those_on_labels(judged):
    rules = quality_rules.rules()
    useless = quality_rules.Rule("useless", F.pmod(F.xxhash64("doc_id"), F.lit(100)).cast("double"), 50.0, 70.0, "layout")
    shares, chance = quality_rules.estimate(judged, [*rules, useless])
    got = quality_rules.accuracies(shares, chance)
    for r, (on_bad, on_good) in zip([*rules, useless], got, strict=True):
        votes = judged.filter("quality is not null").select("quality", r.vote().alias("v"))
        bad, good = votes.agg(F.avg(F.when(F.col("quality") == 0, (F.col("v") == -1).cast("int"))), F.avg(F.when(F.col("quality") == 1, (F.col("v") == 1).cast("int")))).first()
        assert abs(on_bad - bad) < 0.15 and abs(on_good - good) < 0.06, (r.name, on_bad, bad, on_good, good)
    assert abs(got[-1][0] - 0.29) < 0.06 and abs(chance[0, -1, 0] - 0.29) < 0.03  # as often bad on good documents as on bad ones


# ---- secrets


PLANTED = [
    "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8", "sk-proj-" + "Ab12Cd34Ef56Gh78Ij90Kl12Mn34", "xoxb-123456789012-123456789012-AbCdEfGhIjKlMnOpQrStUvWx", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P",
    "AKIA" + "IOSFODNN7EXAMPLE", "glpat-" + "x9Yz8Wv7Ut6Sr5Qp4On3", "0f" * 64, "npm_" + "Q1w2E3r4T5y6U7i8O9p0A1s2D3f4G5h6J7k8",
]
PLAIN = ["internationalisation-and-localisation", "https://www.example.org/articles/the-quick-brown-fox", "documentation/getting_started/installation.html", "Donaudampfschifffahrtsgesellschaft", "2024-01-02/2024-02-03/2025", "some.module.name.with.parts"]


def test_planted_secrets(spark, data):
    docs = table(spark, data.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "text")
    weights = pii.train(docs)
    rows = [(k, f"we wrote token = \"{s}\" there") for k, s in enumerate(PLANTED)] + [(100 + k, f"then {s} ends") for k, s in enumerate(PLANTED)] + [(200 + k, f"see {s} for more") for k, s in enumerate(PLAIN)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(df, weights).collect()}
    assert [got[k] for k in range(len(PLANTED))] == ['we wrote token = "<SECRET>" there'] * len(PLANTED)
    assert [got[100 + k] for k in range(len(PLANTED))] == ["then <SECRET> ends"] * len(PLANTED)
    assert all("<SECRET>" not in got[200 + k] for k in range(len(PLAIN)))
    prefix = weights[1 + pii.FEATURES.index("prefix")]
    assert prefix > 0.5


def test_reliabilities_tell_labelers_apart():
    rng = Random(3)
    right = (0.95, 0.9, 0.8, 0.75, 0.5)  # the last one votes at random
    table_ = {}
    for _ in range(20000):
        y = rng.random() < 0.3
        v = tuple((1 if y else -1) if rng.random() < p else (-1 if y else 1) for p in right)
        table_[v] = table_.get(v, 0) + 1
    _, prior, chance = pii.reliabilities(sorted(table_.items()))
    apart = chance[1, :, 2] - chance[0, :, 2]
    assert abs(prior - 0.3) < 0.05 and np.allclose(apart, [2 * p - 1 for p in right], atol=0.1)


def test_many_spans_in_one_text(spark):
    n = 3000
    text = " ".join(f"a{i}@b.co é" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(df, pii.NEVER).collect()}
    assert got[1] == " ".join("<EMAIL> é" for _ in range(n)) and got[2] is None


# ---- classifier


def test_one_hot_id_is_one_row_and_inputs_are_bounded(spark):
    docs = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([(k, f"other text {k}") for k in (1, 3, 9)], "doc_id long, text string"))
    labels = spark.createDataFrame([(5, 1), (1, 0), (3, 0), (9, 1)], "doc_id long, quality int").filter(~factorisation.held_out(F.col("doc_id")))
    seen = []
    fit = factorisation.Machine.fit

    def spy(self, rows, y, **kw):
        seen.append((len(rows), sum(len(a) for a, _ in rows)))
        return fit(self, rows, y, **kw)

    factorisation.Machine.fit = spy
    try:
        factorisation.train(docs, labels)
        factorisation.train(docs, labels, budget=seen[0][1] - 1)
    finally:
        factorisation.Machine.fit = fit
    assert seen[0][0] == labels.count() and seen[1][0] < seen[0][0] and seen[1][1] < seen[0][1]


def test_scores_against_the_formula(spark):
    m = factorisation.Machine.new()
    rng = np.random.default_rng(4)
    m.bias, m.weight = 0.1, rng.normal(size=factorisation.SIZE).astype(np.float32)
    texts = ["", "one two two", "A b c! d\ne f"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in factorisation.score(df, m).collect()}
    for i, t in enumerate(texts):
        ends, at, x = factorisation.inputs([t.encode()], {})
        z = m.bias + float(m.weight[at] @ x) + sum(float(m.factor[at[a]] @ m.factor[at[b]]) * x[a] * x[b] for a in range(len(at)) for b in range(a))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-4
        if t:
            w = {zlib.crc32(w.lower()) % factorisation.SLOTS for w in t.encode().split()}
            assert w == {int(a) for a in at if a < factorisation.SLOTS}
    assert abs(got[None] - got[0]) < 1e-9


# ---- fingerprints, vectors, files


def test_split_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 8)
    rng = Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(300)})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = simhash.components(df).collect()
    root = {x: x for x in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    want = {}
    for x in fps:
        want.setdefault(root[x], set()).add(x)
    found = {}
    for r in got:
        found.setdefault(r["root"], set()).add(int(np.int64(r["fp"]).astype(np.uint64)))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_vectors_of_different_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0, 5.0]), (2, [3.0]), (20, [0.0, 0.0, 1.0])]
    got = [tuple(r) for r in index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 2, 3.0), (0, 3, 20, 0.0), (20, 1, 1, 5.0), (20, 2, 0, 0.0), (20, 3, 2, 0.0)]


def test_files_in_order_past_five_digits(spark):
    names = [f"part-{n:05d}-x.c000.zstd.orc" for n in (0, 7, 99_999, 100_000, 800_000)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in reversed(names)], "f string").orderBy(token_files.file_number(F.col("f"))).collect()]
    assert got == names and sorted(names) != names


def test_rows_alike_fill_many_files(spark):
    path = scratch(spark, "alike")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _write_alike(spark, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = token_files.read(spark, path).groupBy(F.col("_metadata.file_name")).count().collect()
    got = sorted(r["start"] for r in token_files.digests(spark, path).collect())
    assert len(per) > 1 and got == list(range(0, 4000 * (got[1] - got[0]), got[1] - got[0]))


def _write_alike(spark, path):
    token_files.write(spark.range(0, 4000, 1, 8).select(F.lit(3).cast("long").alias("doc_id"), F.lit("the same text").alias("text")), path)


# ---- URLs


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://User:p@Host.COM:8080/A/./b/../%63asino?Q=%41#f", "host.com/a/casino?q=a"), ("http://x.org", "x.org/"), ("http://x.org?q", "x.org/?q"), ("http://x.org/..", "x.org/"), ("http://x.org/a/..", "x.org/"), ("http://x.org/a/b/.", "x.org/a/b/"),
        ("http://x.org./%zz%2F%e9%", "x.org/%zz%2f%e9%"), ("http://x.org/a..b/...", "x.org/a..b/..."), ("no scheme", ""), (None, ""),
    ],
)
def test_canonical_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(urls.canonical(F.col("u"))).first()[0] == want


def test_disguised_urls_are_blocked(spark):
    rows = ["http://a.net/WP-LOGIN.php", "http://a.net/%63asino", "http://essex-xxxl.net/", "http://u@CASINO.net:80/", "http://a.net/x/../cgi-bin/y"]
    got = [r["verdict"] for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id int, url string")).orderBy("page_id").collect()]
    assert got == ["block", "block", "allow", "block", "block"]
    t = spark.createDataFrame([("block", "a.net", "/"), ("block", "a.net", "/"), (None, "b", "/")], "verdict string, host string, path string")
    assert urls.of_table(t) == [("block", "a.net", "/")]


# ---- packing, mixing, pipeline


def test_repeated_rows_fill_many_shards(spark):
    items = spark.range(5000).select(F.lit(7).alias("id"), F.lit(30).alias("length"), F.lit("x").alias("__shard"), F.lit("y").alias("full"))
    got = packing.pack(items, 100, shard=500).toPandas()
    assert list(got.columns) == ["id", "length", "__shard", "full", "sequence_id", "offset"] and len(got) == 5000
    assert (got.sequence_id // (1 << 34)).nunique() > 5 and got.groupby("sequence_id").length.sum().max() <= 100 and got.sequence_id.nunique() <= 5000 / 3 + 12


def test_order_is_kept_through_packing(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("word"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).cast("int"))).alias("text"))
    path = scratch(spark, "ordered")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    df = packing.in_order(spark.read.parquet(path), "at")
    assert [r["doc_id"] for r in df.orderBy("at").collect()] == list(range(4000))
    got = packing.pack(packing.pieces(df, order="at"), 200, shard=300, order="order").toPandas()
    assert len(got) == 4000 and got.groupby("sequence_id").length.sum().max() <= 200
    first = got.groupby("sequence_id").doc_id.min().sort_index()
    assert np.corrcoef(np.arange(len(first)), first.to_numpy())[0, 1] > 0.95  # sequences follow the order
    spread = got.groupby("sequence_id").doc_id.agg(lambda x: x.max() - x.min())
    assert spread.max() <= 1200 and got.sequence_id.nunique() <= 1.1 * got.length.sum() / 200 + 16
    memory = packing.in_order(docs, "at")  # no files: the partitions' order
    assert memory.select("at").distinct().count() == 4000


def test_mixing_keeps_any_names(spark):
    df = clashing(spark)
    got = mixing.mix(df)
    assert {"mix", "mix_in", "mix_in_in"} <= set(got.columns) and got.count() == df.count()
    out = mixing.taken(df)
    assert out.columns == df.columns and out.filter("mix = 'm' and mix_copy = 3").count() == out.filter("doc_id is not null").count() > 0
    again = mixing.ordered(got)
    assert again.filter("mix_copy_in = 3").count() > 0


def test_copies_come_a_pass_later(spark):
    df = spark.createDataFrame([(i, "a b c d", "s") for i in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(df, share=2.0, schedules=(((0.0, 1.0), (1.0, 1.0)),)).select("mix.*").collect()
    assert all(len(r["positions"]) == r["copies"] == 2 for r in got) and all(abs(r["positions"][1] - r["positions"][0] - 0.5) < 1e-9 for r in got)


def test_a_hot_id_is_dealt_over_the_buckets(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    got = mixing.mix(df).select("mix.*")
    size, taken = got.agg(F.sum("size"), F.sum("taken")).first()
    assert size == 4000 and taken == 6000 and got.select("position").distinct().count() > 1900


def test_stages_on_empty_and_clashing_tables(spark, data):
    for docs in (clashing(spark), clashing(spark).limit(0)):
        df = docs
        for name, stage in corpus_pipeline.STAGES:
            df = stored(stage(spark, df, data), f"edge-{name}")
            assert name == "packing" or df.columns == docs.columns
        assert df.count() >= (0 if docs.isEmpty() else 10)


def test_numbers_of_spans(spark, data):
    """op1's counts are those of its spans."""
    for r in queries.op1_pii(spark, data).collect():
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [kinds.count(k) for k in pii.KINDS[:4]]
