"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised by a codebook of its
own; a pair of centroids is a cell. For a query the halves' centroids are
sorted by distance, and a heap hands out pairs in order of summed distance (the
multi-sequence walk) until the cells passed hold enough distinct vectors, so that
copies don't use up the walk. Their entries are then reranked by the exact
measure.

Codebooks are fitted on a bounded sample, but every row is indexed. The cells
of one first centroid are a shelf; shelves are dealt in blocks of a bounded
number of rows, so a cell with a third of all rows is many tasks' work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.common import stored

#: Centroids of a half, rows that codebooks are fitted on, rows of a block, share of the distinct vectors that a walk passes, and their least number
#: (a floor that makes searches of small tables more exact, never less). With a share of 1 the search is exact.
CENTROIDS, SAMPLE, BLOCK, SHARE, LEAST = 128, 20_000, 4096, 0.4, 400


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v double array) of the rows that take part: not null, not zero,
    all components finite. Where lengths differ the shorter vectors end in zeros,
    which leaves every inner product as it is over the components that both have."""
    v = F.col("embedding").cast("array<double>")
    ok = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )
    least, most = ok.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least == most:
        return ok
    return ok.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v"))))


@dataclass
class Codebooks:
    """Centroids of the first and the second half: (centroids, dimensions) each."""

    first: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, k: int = CENTROIDS, rounds: int = 15, seed: int = 42) -> Codebooks:
        d = x.shape[1] // 2
        return cls(*(_k_means(h, k, rounds, seed) for h in (x[:, :d], x[:, d:])))

    def cells(self, x: np.ndarray) -> np.ndarray:
        d = self.first.shape[1]
        return _nearest(x[:, :d], self.first) * len(self.second) + _nearest(x[:, d:], self.second)

    def walk(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
        """The cells of a query in order of summed distance, up to ``enough``
        by ``sizes``. Distance of a half is minus its inner product, which adds up
        to the measure."""
        d = self.first.shape[1]
        a, b = -(self.first @ q[:d]), -(self.second @ q[d:])
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i].tolist(), b[j].tolist()
        heap, seen, out, passed = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
        while heap and passed < enough:
            _, r, s = heapq.heappop(heap)
            cell = int(i[r]) * len(j) + int(j[s])
            if sizes[cell]:
                out.append(cell)
                passed += int(sizes[cell])
            for n in ((r + 1, s), (r, s + 1)):
                if n[0] < len(a) and n[1] < len(b) and n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (a[n[0]] + b[n[1]], *n))
        return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:k]]
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def search(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, share: float = SHARE, least: int = LEAST, centroids: int = CENTROIDS) -> DataFrame:
    """The ``k`` nearest rows found for each query row: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision, largest first, ties to
    the smaller vec_id; a row isn't its own candidate, but another row of the
    same id or vector is one. Rows that ``usable`` leaves out take no part, and
    vectors of different lengths are compared as it says; an empty table gives no rows; other columns are not read. A walk passes
    ``share`` of the distinct vectors, ``least`` at least; if the cells it passed hold fewer than k
    others, the rest of the cells hold fewer as well.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    found = usable(vectors)
    n = found.count()
    if not n:
        return spark.createDataFrame([], schema)
    sample = found.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    x = sample.values.to_numpy().reshape(len(sample), -1)
    books = spark.sparkContext.broadcast(Codebooks.fit(x, centroids))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=books.value.cells(np.stack(pdf["v"].to_numpy())).astype(np.int32))

    # written once: the walk's sizes and the entries are the same rows
    indexed = stored(found.mapInPandas(assign, "vec_id long, v array<double>, cell int").withColumn("row", F.monotonically_increasing_id()), "multi-index")
    sizes = np.zeros(len(books.value.first) * len(books.value.second), np.int64)
    distinct = np.zeros_like(sizes)
    # equal vectors share a cell, so the cells' distinct vectors add up
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64("v")).alias("vectors")).collect():  # at most centroids**2 rows
        sizes[r["cell"]], distinct[r["cell"]] = r["n"], r["vectors"]
    enough = max(int(distinct.sum() * share), least, k + 1)
    width = len(books.value.second)
    blocks = np.maximum(-(-sizes.reshape(-1, width).sum(1) // BLOCK), 1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, q in zip(pdf["row"], pdf["v"], strict=True):
                shelf, place = np.divmod(np.array(books.value.walk(np.asarray(q), distinct, enough), np.int64), width)
                order = np.argsort(shelf, kind="stable")
                named, first = np.unique(shelf[order], return_index=True)
                for s, places in zip(named.tolist(), np.split(place[order], first[1:]), strict=True):
                    out += [(row, s, block, places.tolist()) for block in range(blocks[s])]
            yield pd.DataFrame(out, columns=["row", "shelf", "block", "places"])

    shelf_of = F.floor(F.col("cell") / width).cast("int")
    block_of = F.pmod(F.xxhash64("row"), F.element_at(F.lit(blocks.tolist()), shelf_of + 1)).cast("int")
    entries = indexed.select("vec_id", "v", "row", (F.col("cell") % width).alias("place"), shelf_of.alias("shelf"), block_of.alias("block"))
    queries = indexed.filter(is_query)
    routed = queries.select("row", "v").mapInPandas(walk, "row long, shelf int, block int, places array<int>")
    asked = routed.join(queries.select("row", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "row").select("row", "query_id", "q", "shelf", "block", "places")

    def rerank(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(have):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        have = have.sort_values("vec_id", kind="stable")
        v, ids, rows, place = np.stack(have["v"].to_numpy()), have["vec_id"].to_numpy(), have["row"].to_numpy(), have["place"].to_numpy()
        out = []
        for at in range(0, len(ask), 512):  # a bounded score matrix
            part = ask.iloc[at : at + 512]
            q, row = np.stack(part["q"].to_numpy()), part["row"].to_numpy()
            passed = np.zeros((len(part), width), bool)
            for i, places in enumerate(part["places"]):
                passed[i, places] = True
            # one pair at a time, not a blocked matrix product: equal vectors get equal scores, so ties are ties
            s = np.einsum("ij,kj->ik", q, v)
            s[~passed[:, place] | (row[:, None] == rows[None, :])] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            r = np.repeat(np.arange(len(part)), top.shape[1])
            top = top.ravel()
            keep = s[r, top] > -np.inf
            r, top = r[keep], top[keep]
            out.append(pd.DataFrame({"row": row[r], "query_id": part["query_id"].to_numpy()[r], "vec_id": ids[top], "score": s[r, top]}))
        return pd.concat(out)

    near = asked.groupBy("shelf", "block").cogroup(entries.groupBy("shelf", "block")).applyInPandas(rerank, "row long, query_id long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k)
    # k rows at most of each block that a query went to
    ranked = near.groupBy("row", "query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b")["vec_id"].alias("vec_id"), F.col("b")["score"].alias("score"))
