"""SimHash near-duplicates by BK-trees.

Each text gets a 64-bit fingerprint: bit b is the majority of bit b over the
hashes of its word shingles. Fingerprints at Hamming distance 3 or less link.

Two fingerprints within 3 bits agree on one of 4 blocks of 16 bits, and of the
other 48 bits on one of 4 blocks of 12; so they meet in one of 16 shards keyed
by 28 bits, and no link is lost. A shard's distinct fingerprints form a BK-tree
(a child hangs on the edge numbered with its distance to the parent), searches
follow only the edges within the radius, and only a spanning forest of the
links found leaves the shard: copies are never expanded into pairs. The trees
go to the queries of their own shard through the shuffle, not to every
executor: a broadcast of all trees would grow with the corpus.

A shard with more than SPLIT fingerprints is split by the same argument on the
36 bits that its key leaves out, which agree on one of 4 blocks of 9, and once
more on the 27 bits then left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from loomwell.llm.common import own_prefix, stored, utf8_slices
from loomwell.operators.components import connected_components

#: Words of a shingle and differing bits of a link in fingerprints of close copies, seed of XXH64.
WORDS, RADIUS, SEED = 3, 3, 42

#: Fingerprints of a shard from which on it is split by more of their bits.
SPLIT = 1 << 15


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of one whole text, unsigned; 0 without words."""
    parts = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), SEED)
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    begins = [0, *ends[: len(parts) - words].tolist()]
    h = np.array([xxh64_intdigest(whole[a:b], SEED) for a, b in zip(begins, (ends[words - 1 :] - 1).tolist(), strict=True)], "<u8")
    return majority(h)


def majority(h: np.ndarray) -> int:
    """Bits that over half of the hashes have."""
    h = np.asarray(h, "<u8")
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):  # whole texts, a bounded bit matrix
        total += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, p: str = "", columns: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """The given columns of ``docs`` (doc_id alone if none are) and ``p`` + fp, the
    fingerprint as a signed long. Null texts are empty."""
    columns = ["doc_id"] if columns is None else columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in utf8_slices(batch.column(len(columns))):
                raw, e = data.tobytes(), ends.tolist()
                fp = np.array([fingerprint(raw[x:y], words) for x, y in zip(e, e[1:], strict=False)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns[: len(columns)]], pa.array(fp)], names=[*columns, f"{p}fp"])

    q = own_prefix(docs)
    df = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias(f"{q}text"))
    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField(f"{p}fp", T.LongType())]))


class BKForest:
    """One BK-tree for each shard, in arrays; built and searched level by level
    for all of them at once. Node i is fingerprint i."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """Fingerprints (unsigned), distinct within a shard; shards ascending."""
        self.fps = fps
        n = len(fps)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        keys, child = [], []
        item = np.setdiff1d(np.arange(n), first)
        at = self.root[item]
        while len(item):
            key = at * 65 + np.bitwise_count(fps[item] ^ fps[at]).astype(np.int64)
            # the first item on an edge becomes its node, the others go on below it
            edge, where, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            child.append(item[where])
            at = item[where][back]
            rest = at != item
            item, at = item[rest], at[rest]
        keys, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, child))
        order = np.argsort(keys)
        self.keys, self.child = keys[order], child[order]

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of a shard at most ``radius`` apart, in blocks."""
        block = 1 << 15
        for k in range(0, len(self.fps), block):
            query = np.arange(k, min(k + block, len(self.fps)))
            node = self.root[query]
            stack = [(query, node)]
            while stack:
                query, node = stack.pop()
                if len(query) > 1 << 20:  # bounded frontiers
                    half = len(query) // 2
                    stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                    continue
                d = np.bitwise_count(self.fps[query] ^ self.fps[node]).astype(np.int64)
                hit = (d <= radius) & (query < node)
                if hit.any():
                    yield query[hit], node[hit]
                # children on the edges d - radius to d + radius are neighbours in the sorted keys
                lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - lo
                if n.any():
                    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    stack.append((np.repeat(query, n), self.child[at]))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, by min-label hooking."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        go = a != b
        if not go.any():
            break
        i, j, a, b = i[go], j[go], a[go], b[go]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _agreeing(rest: Column, bits: int) -> Column:
    """Of the ``bits`` low bits ``rest`` each of 4 blocks: its number, its bits and, in order, the bits outside."""
    out, low = [], 0
    for k in range(4):
        width = (bits - low) // (4 - k)
        own = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << width) - 1))
        above = F.shiftleft(F.shiftrightunsigned(rest, low + width), low) if low + width < 64 else F.lit(0).cast("long")
        out.append(F.struct(F.lit(k).cast("long").alias("k"), own.cast("long").alias("own"), above.bitwiseOR(rest.bitwiseAND(F.lit((1 << low) - 1))).alias("rest")))
        low += width
    return F.array(*out)


def _shards(fp: Column) -> Column:
    """The 16 shards of a fingerprint: key (first block, its 16 bits, second block, its 12 bits) in a long, and the other 36 bits."""

    def second(x: Column) -> Column:
        key = lambda y: F.shiftleft(x["k"] * 4 + y["k"], 28).bitwiseOR(F.shiftleft(x["own"], 12)).bitwiseOR(y["own"])
        return F.transform(_agreeing(x["rest"], 48), lambda y: F.struct(key(y).alias("shard"), y["rest"].alias("rest")))

    return F.flatten(F.transform(_agreeing(fp, 64), second))


def _split(shards: DataFrame, bits: int) -> DataFrame:
    """(fp, shard, rest), shards of more than SPLIT fingerprints by one more block of their ``bits`` rest."""
    large = shards.groupBy("shard").count().filter(F.col("count") > SPLIT).select("shard")
    if large.isEmpty():
        return shards
    few = shards.join(large, "shard", "left_anti").select("fp", "shard", "rest")
    many = shards.join(large, "shard").select("fp", "shard", F.explode(_agreeing(F.col("rest"), bits)).alias("x"))
    return few.union(many.select("fp", F.xxhash64("shard", "x.k", "x.own").alias("shard"), "x.rest"))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest, shard by shard, of the links between the
    distinct fingerprints ``fp``."""
    if radius > 3:
        raise ValueError("16 shards find links of up to 3 bits")
    shards = distinct.select("fp", F.explode(_shards(F.col("fp"))).alias("x")).select("fp", "x.shard", "x.rest")
    if distinct.count() > SPLIT:
        shards = _split(_split(shards, 36), 27)
    shards = shards.groupBy("shard").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = lists.offsets.to_numpy()
            k = 0
            while k < len(ends) - 1:  # some shards at a time, at least one
                to = max(k + 1, int(np.searchsorted(ends, ends[k] + (1 << 18), "right")) - 1)
                fps = lists.values.to_numpy()[ends[k] : ends[to]].view(np.uint64)
                shard = np.repeat(np.arange(to - k), np.diff(ends[k : to + 1]))
                root = np.arange(len(fps))
                for i, j in BKForest(fps, shard).within(radius):
                    root = forest(root[i], root[j], len(fps))[root]
                on = np.flatnonzero(root != np.arange(len(fps)))
                yield pa.RecordBatch.from_arrays([pa.array(fps[on].view(np.int64)), pa.array(fps[root[on]].view(np.int64))], names=["a", "b"])
                k = to

    found = shards.select("fps").mapInArrow(run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): every distinct fingerprint of ``fps`` that links to another, with its component's least."""
    edges = stored(links(stored(fps.select("fp").distinct(), "simhash-distinct"), radius), "simhash-links")
    return connected_components(edges).select(F.col("node").alias("fp"), "root")


def dedup(docs: DataFrame, words: int = 5, radius: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, component_id, the least doc_id
    among all documents reachable by links. Null ids count as none: a component
    of them alone has a null id. Texts without words have fingerprint 0 and
    link like any other; repeated rows link at distance 0. Other columns are
    not read; an empty table gives no rows.

    With ``radius`` fingerprints of ``words``-word shingles link that differ in so
    many bits or fewer; without it texts link whose sets of shingles have a
    similarity of 0.8 or more (``near_copies``), which is the operator's default.
    """
    if radius is None:
        from loomwell.llm import near_copies  # which builds on this module

        return near_copies.dedup(docs, words)
    fps = stored(fingerprints(docs, words=words), "simhash-fps")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(components(fps, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least_of = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # written, so that the join below deals both sides itself and can split a hot fingerprint
    of_fp = stored(rooted.join(least_of, "root").select("fp", "component_id"), "simhash-components")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def order_key() -> Column:
    """(none, id, key) of a row: its place among copies, and the id and text hash that name it."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(":"), F.xxhash64("text").cast("string"))
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), key.alias("key"))


def only(docs: DataFrame, least: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``order_key`` is in the column ``least``; of rows that repeat one any one.

    The texts are shuffled once, as the join and the choice among repeated rows deal by the same key.
    """
    p = own_prefix(docs)
    stay = stored(least.select(F.col("least")["key"].alias(f"{p}key")), "simhash-kept")
    found = docs.withColumn(f"{p}key", order_key()["key"]).join(stay, f"{p}key", "left_semi")
    first = F.row_number().over(Window.partitionBy(f"{p}key").orderBy(f"{p}key"))
    return found.withColumn(f"{p}first", first).filter(F.col(f"{p}first") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def kept(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component of 3-word fingerprints at most
    ``radius`` bits apart (``near_copies.kept`` goes by similarity): that of the least (doc_id, text
    hash), nulls last; of rows that repeat both any one. Only ids, hashes and
    fingerprints are compared."""
    fps = stored(fingerprints(docs.select(order_key().alias("doc_id"), "text")), "simhash-fps")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(components(fps, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return only(docs, rooted.groupBy("root").agg(F.min("least").alias("least")))
