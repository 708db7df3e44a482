"""Transactions over several objects.

txns: txn, objects (array), ops (array of struct<object, sql, ...>)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.functions.scalar import valid_id
from loomwell.operators.components import connected_components
from loomwell.operators.prefix import BUCKET, running


def validate(txns: DataFrame) -> DataFrame:
    """``txns`` with sorted distinct participants and ``error``: null if it may run."""
    ids = F.array_sort(F.array_distinct("objects"))
    stray = F.filter("ops", lambda o: ~F.array_contains(F.col("participants"), o["object"]))
    error = (
        F.when(F.coalesce(F.size("participants"), F.lit(0)) <= 0, "no objects")
        .when(~F.forall("participants", valid_id), "invalid object id")
        .when(F.size(stray) > 0, "undeclared object")
    )
    return txns.withColumn("participants", ids).withColumn("error", error)


def transaction_components(parts: DataFrame) -> DataFrame:
    """(txn, component): transactions that share objects, directly or through
    others, have the least txn of them all. ``parts`` is (txn, object)."""
    first = parts.groupBy("object").agg(F.min("txn").alias("b"))
    edges = parts.join(first, "object").select(F.col("txn").alias("a"), "b")
    return connected_components(edges).select(F.col("node").alias("txn"), F.col("root").alias("component"))


def revert_closure(parts: DataFrame, reverted: DataFrame) -> DataFrame:
    """(txn) pending transactions that must go when the objects of ``reverted``
    revert: all in components that touch one of them."""
    comp = transaction_components(parts)
    hit = parts.join(reverted.select("object").distinct(), "object", "left_semi").join(comp, "txn").select("component").distinct()
    return comp.join(hit, "component", "left_semi").select("txn")


def boat_cut(items: DataFrame, cap: int) -> DataFrame:
    """``items`` (worker, pos, bytes) with ``aboard``: in order of pos, the first
    always, then each that still fits under ``cap``; later ones are tried after
    one that doesn't fit. Each choice depends on all before, so a worker's queue
    is walked by one task, a batch at a time, in a time that grows with its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, used = object(), 0
        for batch in batches:
            aboard = []
            for w, n in zip(batch.column("worker").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                first, worker = w != worker, w
                used = 0 if first else used
                aboard.append(first or used + (n or 0) <= cap)
                used += (n or 0) if aboard[-1] else 0
            yield batch.append_column("aboard", pa.array(aboard, pa.bool_()))

    schema = T.StructType([*items.schema.fields, T.StructField("aboard", T.BooleanType())])
    return items.repartition("worker").sortWithinPartitions("worker", "pos").mapInArrow(run, schema)


def admission(parts: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(object, txn, position) in each object's queue, by arrival; ``bucket`` is
    something that rises with the arrival and cuts long queues in parts."""
    return running(parts, ["object"], F.lit(0) if bucket is None else bucket, ["arrival", "txn"], F.lit(1), "position")


def acks(txns: DataFrame, watermark: int) -> DataFrame:
    """``txns`` (worker, seq, bytes, optimistic) with ``ack``: at once while what
    is unshipped before it stays in the watermark, else with the boat; and the
    number of durability barriers up to it."""
    bucket = F.floor(F.col("seq") / BUCKET)
    both = running(txns, ["worker"], bucket, ["seq"], F.col("bytes"), "dirty")
    both = running(both, ["worker"], bucket, ["seq"], (~F.col("optimistic")).cast("long"), "barrier")
    ack = F.when(F.col("optimistic") & (F.col("dirty") <= watermark), "at once").otherwise("with the boat")
    return both.select(*txns.columns, ack.alias("ack"), "barrier")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Objects whose hash moved, came or went."""
    b, a = before.select("object", F.col("hash").alias("h0")), after.select("object", F.col("hash").alias("h1"))
    return b.join(a, "object", "full").filter(~F.col("h0").eqNullSafe(F.col("h1"))).select("object")


def content_fence(durable: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(object, k) keys that the durable fold has and the snapshot would drop."""
    return durable.select("object", "k").join(snapshot.select("object", "k"), ["object", "k"], "left_anti").distinct()


def replay_transfers(transfers: DataFrame, start: int) -> DataFrame:
    """(txn, accepted) of transfers (txn, seq, src, dst, amt) between accounts that
    open with ``start`` and may not go below zero: serial in seq order inside
    each component of accounts, components side by side. A rejected transfer
    leaves both legs untouched. Components are replayed in one task each, as
    a guard depends on all before it; commuting updates should be sums instead."""
    parts = transfers.select("txn", F.col("src").alias("object")).union(transfers.select("txn", F.col("dst").alias("object")))
    comp = transaction_components(parts)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "txn"])
        balance: dict[object, int] = {}
        ok = []
        for src, dst, amt in zip(pdf["src"], pdf["dst"], pdf["amt"], strict=True):
            have = balance.get(src, start)
            good = have >= amt
            if good:
                balance[src] = have - amt
                balance[dst] = balance.get(dst, start) + amt
            ok.append(good)
        return pd.DataFrame({"txn": pdf["txn"], "accepted": ok})

    kind = transfers.schema["txn"].dataType.simpleString()
    return transfers.join(comp, "txn").groupBy("component").applyInPandas(replay, f"txn {kind}, accepted boolean")
