"""Connected components of a graph given as an edge table.

Large-star and small-star steps (Kiveris et al., 2014): each step links the
neighbours of a node to the least of them, so paths halve and a hub's edges are
spread over their far ends. Steps are separated by checkpoint(), which cuts the
lineage into the folder that all executors share. A graph that is, or has
shrunk to, FEW edges is finished by one task, as that takes it no longer than a
round of small shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.sources.shared import shared_dir


#: Edges that one task may finish: a few MB.
FEW = 50_000


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v) with v the least node of u's component, by min-label hooking."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    pdf = pd.concat(parts)
    code, name = pd.factorize(pd.concat([pdf["u"], pdf["v"]]), sort=True)
    i, j = code[: len(pdf)], code[len(pdf) :]
    root = np.arange(len(name))
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
    on = np.flatnonzero(root != np.arange(len(name)))
    yield pd.DataFrame({"u": name[on], "v": name[root[on]]})


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over (u, v) edges, each with u > v."""
    if small:  # v's are below u: link them, and u, to the least
        near = edges
    else:  # both directions, then link those above u to the least of all
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = near.join(least, "u")
    if small:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable
    type); root is the least node of its component. Loops and repeated edges
    are allowed, null ends ignored; no edges give no rows."""
    shared_dir(edges.sparkSession)
    both = edges.filter("a is not null and b is not null")
    loops = both.filter("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    now = both.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        if now.count() <= FEW:
            now = now.coalesce(1).mapInPandas(_finished, now.schema).checkpoint()
            break
        now = _star(_star(now, small=False), small=True).checkpoint()
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no fixed point in {most_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    alone = loops.distinct().join(found.select("node").union(roots.select("node")), "node", "left_anti")
    return found.union(roots).union(alone)
