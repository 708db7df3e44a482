"""SimHash near-dedup at 0.8: word shingles of five, links checked on whole sets.

Two texts link when their sets of 5-word shingles have a Jaccard similarity of
0.8 or more. The fingerprints of such a pair differ in about 10 of 64 bits, too
many for shards of agreeing bits, so the shards of the BK-trees are 20 bands of
4 min-hashes here: a pair at exactly 0.8 shares no band with probability 3e-5, a
nearer one with less. A shard's fingerprints form a BK-tree, its edges within
RADIUS bits give the candidates (a pair at 0.8 lies beyond it with probability
1e-6), and a candidate is a link if its whole sets say so: similarities are
computed, not estimated. Only a spanning forest of the links leaves a shard.

Equal sets are one node, so copies never meet in a shard, and shards of the same
members are searched once. A shard of more than BLOCK sets is dealt in blocks,
each searched by itself. That alone could miss a link between blocks, so after
it the components found are compared: where all of a large shard's members are
connected there is nothing left to find, and where not, the members outside its
largest component are searched against every block.

Only members of shared shards have their sets computed again; they are found by
a bitmap of fixed size, whose false hits cost time but no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomwell.llm.common import bitmap, in_bitmap, stored, utf8_slices
from loomwell.llm.simhash import SEED, BKForest, forest, majority, only, order_key
from loomwell.operators.components import connected_components

#: Words of a shingle, least similarity of a link in fifths, bands, min-hashes of a band, bits of a candidate, sets of a block.
WORDS, FIFTHS, BANDS, ROWS, RADIUS, BLOCK = 5, 4, 20, 4, 24, 2048

_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64)
_ODD = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; a shorter text is one shingle, one without words has none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    begins = [0, *ends[: len(parts) - words].tolist()]
    return np.unique(np.array([xxh64_intdigest(whole[a:b], SEED) for a, b in zip(begins, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def bands(h: np.ndarray) -> list[int]:
    """The shards of a set, one for each band; none for the empty set."""
    if not len(h):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):  # whole sets, a bounded matrix
        x = (h[k : k + 4096] ^ _XOR) * _ODD
        least = np.minimum(least, ((x ^ (x >> np.uint64(32))) * _ODD).min(axis=1))
    return [xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets' similarity reaches FIFTHS."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 5 * both >= FIFTHS * (len(a) + len(b) - both)


def linked(fps: np.ndarray, sets: list[np.ndarray], shard: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that span the components within each shard; two that ask from
    another block are not compared, as their own block does that."""
    # a tree holds equal fingerprints of different sets as nodes at distance 0
    root, out, most = np.arange(len(fps)), [], 256
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    for i, j in BKForest(fps, shard).within(RADIUS):
        # sizes alone can rule a pair out
        go = (5 * np.minimum(n[i], n[j]) >= FIFTHS * np.maximum(n[i], n[j])) & ~(asks[i] & asks[j])
        i, j = i[go], j[go]
        while len(i):
            apart = root[i] != root[j]  # what is connected by now needs no look
            i, j = i[apart], j[apart]
            hits = [(x, y) for x, y in zip(i[:most].tolist(), j[:most].tolist(), strict=True) if similar(sets[x], sets[y])]
            i, j = i[most:], j[most:]
            if hits:
                x, y = np.array(hits).T
                root = forest(root[x], root[y], len(fps))[root]
                out += hits
            most = 256 if 8 * len(hits) > most else min(2 * most, 1 << 14)
    return out


def _rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc, sid, fp, buckets: each row's key, its set, the set's fingerprint and shards."""
    keyed = docs.select(order_key().alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in utf8_slices(batch.column(1)):
                raw, e = data.tobytes(), ends.tolist()
                sets = [shingles(raw[x:y], words) for x, y in zip(e, e[1:], strict=False)]
                sid = [xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
                fp = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sid, pa.int64()), pa.array(fp), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["doc", "sid", "fp", "buckets"])

    return keyed.mapInArrow(run, f"doc {keyed.schema['doc'].dataType.simpleString()}, sid long, fp long, buckets array<long>")


def _nodes(rows: DataFrame) -> DataFrame:
    """sid, least, fp, buckets: every distinct set and its least document."""
    return rows.groupBy("sid").agg(F.min("doc").alias("least"), F.min("fp").alias("fp"), F.min("buckets").alias("buckets"))


def _sets(docs: DataFrame, nodes: DataFrame, entries: DataFrame, words: int) -> DataFrame:
    """sid, shingles: the whole sets of ``entries``, and a few others."""
    wanted = entries.select("sid").distinct().join(nodes.select("sid", F.xxhash64(F.col("least")["key"]).alias("k")), "sid").select("k")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(batch.column(0).to_numpy(), bits.value)
            if hit.any():
                for _, _, data, ends in utf8_slices(batch.column(1).filter(pa.array(hit))):
                    raw, e = data.tobytes(), ends.tolist()
                    sets = [shingles(raw[x:y], words).tobytes() for x, y in zip(e, e[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array([xxh64_intdigest(s, SEED) - (1 << 63) for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["sid", "shingles"])

    return docs.select(F.xxhash64(order_key()["key"]).alias("k"), "text").mapInArrow(run, "sid long, shingles binary").groupBy("sid").agg(F.min("shingles").alias("shingles"))


def _search(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that span the components within each ``part`` of (part, sid, fp, asks).
    Parts are rows side by side, so a worker holds a batch and one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            cut = int(np.searchsorted(part, part[-1]))  # the last part may go on
            if cut or (held and held[-1].column(0)[-1].as_py() != part[0]):
                done, held = [*held, batch.slice(0, cut)], []
                yield from solve(done)
            held.append(batch.slice(cut))
        yield from solve(held)

    def solve(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in batches):
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        sid = t["sid"].to_numpy()
        members = [np.frombuffer(s.as_buffer(), np.uint64) for s in t["shingles"].combine_chunks()]
        fps = t["fp"].to_numpy().view(np.uint64)
        shard = np.unique(t["part"].to_numpy(), return_inverse=True)[1]
        pairs = linked(fps, members, shard, t["asks"].to_numpy(zero_copy_only=False))
        if pairs:
            i, j = np.array(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(sid[i], sid[j])), pa.array(np.minimum(sid[i], sid[j]))], names=["a", "b"])

    rows = entries.join(sets, "sid").select("part", "sid", "fp", "asks", "shingles")
    return rows.repartition("part").sortWithinPartitions("part", "sid").mapInArrow(run, "a long, b long").distinct()


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("sid"), "root")


def components(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """(sid, root) of every set that links to another."""
    met = nodes.select("sid", "fp", F.explode("buckets").alias("bucket"))
    several = met.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("members")).filter("n > 1")
    # of shards with the same members the first
    groups = several.groupBy("n", "members").agg(F.min("bucket").alias("bucket"))
    block = F.pmod(F.xxhash64("sid", "bucket"), F.ceil(F.col("n") / BLOCK))
    entries = stored(met.join(groups, "bucket").select("bucket", "sid", "fp", "n", block.alias("block")), "near-entries")
    sets = stored(_sets(docs, nodes, entries, words), "near-sets")
    part = F.xxhash64("bucket", "block")
    links = stored(_search(entries.select(part.alias("part"), "sid", "fp", F.lit(False).alias("asks")), sets), "near-links")
    found = _components(links)
    large = entries.filter(F.col("n") > BLOCK)
    if large.isEmpty():
        return found
    rooted = stored(large.join(found, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "near-large")
    most = rooted.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("m")).select("bucket", F.col("m")["root"].alias("most"))
    rest = rooted.join(most, "bucket").filter("root <> most")
    of_bucket = rest.groupBy("bucket").agg(F.count("*").alias("asking"))
    if of_bucket.isEmpty():
        return found
    # every block meets every block of those that ask, both of bounded size
    blocks, askers = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("asking") / BLOCK)
    part = F.xxhash64("bucket", "block", "ask")
    asked = rooted.join(of_bucket, "bucket").withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), askers - 1)))
    asking = rest.join(of_bucket, "bucket").withColumn("ask", F.pmod(F.xxhash64("sid", "bucket"), askers)).drop("block").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    both = asked.select(part.alias("part"), "sid", "fp", F.lit(False).alias("asks")).union(asking.select(part.alias("part"), "sid", "fp", F.lit(True).alias("asks")))
    return _components(links.union(stored(_search(both.groupBy("part", "sid", "fp").agg(F.min("asks").alias("asks")), sets), "near-links")))


def _rooted(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    return nodes.select("sid", "least").join(components(docs, nodes, words), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (of the set of shingles), component_id for each row of ``docs``, as ``simhash.dedup`` says."""
    rows = stored(_rows(docs, words), "near-rows")
    rooted = _rooted(docs, stored(_nodes(rows), "near-nodes"), words)
    least_of = rooted.groupBy("root").agg(F.min("least").alias("least"))
    of_set = stored(rooted.select("sid", "root").join(least_of, "root").select("sid", F.col("least")["id"].alias("component_id")), "near-components")
    return rows.select("sid", F.col("doc")["id"].alias("doc_id"), "fp").join(of_set, "sid").select("doc_id", "fp", "component_id")


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least
    (doc_id, text hash), nulls last; of rows that repeat both any one. Texts
    without words are copies of each other; a very long text is one set like any
    other; an empty table gives no rows; columns pass through whatever their
    names."""
    rooted = _rooted(docs, stored(_nodes(_rows(docs)), "near-nodes"), WORDS)
    return only(docs, rooted.groupBy("root").agg(F.min("least").alias("least")).select("least"))
