"""Near copies against all pairs of whole shingle sets."""

from random import Random

import corpus_pipeline
import pytest
from loomwell.llm import near_copies, simhash
from loomwell.llm.common import table


def grams(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def roots(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return {rows[r][0] for r in root}


def edited():
    """Texts of 200 words, each with a copy of another degree and some chains of copies."""
    rng, rows = Random(5), []
    for k in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((len(rows), " ".join(w)))
        for at in rng.sample(range(10, 190, 9), 1 + k % 8):
            w[at] = f"x{rng.randrange(10**6)}"
            if k % 3 == 0:
                rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(w)))
    return rows


def test_pairs_between(spark):
    rows = edited()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [similarity(grams(a), grams(b)) for (_, a), (_, b) in zip(rows, rows[1:], strict=False)]
    assert sum(0.8 <= s < 0.95 for s in found) >= 10 and sum(0.6 < s < 0.8 for s in found) >= 5
    assert {r["doc_id"] for r in near_copies.kept(df).collect()} == roots(rows)
    assert {r["doc_id"] for r in simhash.kept(df).collect()} != roots(rows)


def test_copies_and_empty_texts(spark):
    rows = [(None, "a b"), (1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "a b c d e f g"), (5, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.kept(df).collect()) == [1, 3, 5]
    assert near_copies.kept(df.limit(0)).count() == 0


def test_pipeline_has_no_near_copies(spark, data):
    packed = corpus_pipeline.run(spark, data)
    ids = {r["doc_id"] for r in packed.collect()}
    text = {r["doc_id"]: grams(r["text"].lower()) for r in table(spark, data, "documents").collect() if r["doc_id"] in ids}
    assert len(ids) > 50 and not [(a, b) for a in ids for b in ids if a < b and similarity(text[a], text[b]) >= 0.8]


@pytest.mark.parametrize("block", [4, 2048])
def test_blocks_of_a_large_shard_lose_no_link(spark, monkeypatch, block):
    """Chains of copies, each a few words from the last, and unlike texts that share a long passage."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng, rows = Random(6), []
    shared = [f"s{k}" for k in range(150)]
    for k in range(4):
        w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(12):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    for _ in range(25):
        rows.append((len(rows), " ".join(shared + [f"y{rng.randrange(10**6)}" for _ in range(rng.choice((10, 30, 60)))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = roots(rows)
    assert {r["doc_id"] for r in near_copies.kept(df).collect()} == want
    got = simhash.dedup(df).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == want and all(r["component_id"] <= r["doc_id"] for r in got)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 2, "y"), (2, "a b c", "z", 3, "w")], "doc_id long, text string, sid string, root int, `near.k` string")
    assert [tuple(r) for r in near_copies.kept(df).collect()] == [(1, "a b c", "x", 2, "y")]
