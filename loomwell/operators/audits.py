"""Consistency audits: joins and aggregates that must come out empty or equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def torn_transfers(legs: DataFrame) -> DataFrame:
    """Keys of (k, amt) legs that aren't one debit and one credit of the same amount."""
    per = legs.groupBy("k").agg(F.count("*").alias("legs"), F.sum("amt").alias("net"), F.count_if(F.col("amt") < 0).alias("debits"))
    return per.filter((F.col("legs") != 2) | (F.col("net") != 0) | (F.col("debits") != 1))


def conserved(balances: DataFrame, initial: int) -> DataFrame:
    """(accounts, total, expected, ok)."""
    return balances.agg(F.count("*").alias("accounts"), F.sum("balance").alias("total")).withColumn("expected", F.col("accounts") * initial).withColumn("ok", F.col("total").eqNullSafe(F.col("expected")))


def lost(acked: DataFrame, found: DataFrame, key: str = "k") -> DataFrame:
    """Acknowledged keys that are not found."""
    return acked.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def supply(accounts: DataFrame, minted: DataFrame) -> DataFrame:
    """(held, issued, ok): balances against the ledger of mints and burns."""
    a = accounts.agg(F.coalesce(F.sum("balance"), F.lit(0)).alias("held"))
    return a.crossJoin(minted.agg(F.coalesce(F.sum("amt"), F.lit(0)).alias("issued"))).withColumn("ok", F.col("held") == F.col("issued"))  # one row each


def escrow_faults(opened: DataFrame, settlements: DataFrame, credits: DataFrame) -> DataFrame:
    """(saga, fault): settled twice, settled without being opened, or without the
    payee's (release) or funder's (refund) credit. Opened sagas are (saga, payee,
    funder, amt), settlements (saga, dir), credits (saga, party, amt)."""
    twice = settlements.groupBy("saga").count().filter("count > 1").select("saga", F.lit("settled twice").alias("fault"))
    unknown = settlements.join(opened, "saga", "left_anti").select("saga", F.lit("never opened").alias("fault")).distinct()
    due = settlements.join(opened, "saga").select("saga", F.when(F.col("dir") == "release", F.col("payee")).otherwise(F.col("funder")).alias("party"), "amt")
    unpaid = due.join(credits, ["saga", "party", "amt"], "left_anti").select("saga", F.lit("not credited").alias("fault")).distinct()
    return twice.union(unknown).union(unpaid)


def counter_faults(counters: DataFrame, increments: DataFrame) -> DataFrame:
    """Counters (object, n) that differ from the number of distinct increments (object, k)."""
    real = increments.groupBy("object").agg(F.count_distinct("k").alias("real"))
    return counters.join(real, "object", "full").filter(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("real", F.lit(0)))).select("object", "n", "real")


def feed_faults(final: DataFrame, delivered: DataFrame) -> DataFrame:
    """(fault, consumer, id) of deliveries (consumer, pos, id, k, durable) against
    the feed's rows (id, k): missed rows, phantoms of durable deliveries, ids
    that don't rise and keys that come twice."""
    missed = final.join(delivered.select("k").distinct(), "k", "left_anti").select(F.lit("missed").alias("fault"), F.lit(None).cast("string").alias("consumer"), "id")
    phantom = delivered.filter("durable").join(final, ["id", "k"], "left_anti").select(F.lit("phantom").alias("fault"), "consumer", "id")
    w = Window.partitionBy("consumer").orderBy("pos")
    order = delivered.withColumn("was", F.lag("id").over(w)).filter("was >= id").select(F.lit("order").alias("fault"), "consumer", "id")
    twice = delivered.groupBy("consumer", "k").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1").select(F.lit("twice").alias("fault"), "consumer", "id")
    return missed.union(phantom).union(order).union(twice)


def will_faults(armed: DataFrame, graveyard: DataFrame) -> DataFrame:
    """(k, fault): armed wills that never ran, and runs of what was never armed."""
    a, g = armed.select("k").distinct(), graveyard.select("k").distinct()
    return a.join(g, "k", "left_anti").withColumn("fault", F.lit("never ran")).union(g.join(a, "k", "left_anti").withColumn("fault", F.lit("not armed")))


def constraint_faults(rows: DataFrame, key: str, not_null: list[str], checks: dict[str, str], parent: DataFrame | None = None, fk: str | None = None) -> DataFrame:
    """(constraint, rows) that break: key uniqueness, NOT NULL, CHECK, foreign key. Null passes a CHECK and a foreign key."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"not_null({c})") for c in not_null] + [F.count_if(~F.coalesce(F.expr(x), F.lit(True))).alias(f"check({n})") for n, x in checks.items()]
    one = rows.agg(*counts) if counts else rows.limit(0).agg(F.lit(0).alias("none"))
    stacked = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("constraint"), F.col(f"`{c}`").alias("rows")) for c in one.columns])).alias("x")).select("x.*")
    dup = rows.groupBy(key).count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).select(F.lit(f"unique({key})").alias("constraint"), "rows")
    out = stacked.union(dup)
    if parent is not None and fk is not None:
        orphan = rows.filter(F.col(fk).isNotNull()).join(parent, rows[fk] == parent[parent.columns[0]], "left_anti").agg(F.count("*").alias("rows")).select(F.lit(f"references({fk})").alias("constraint"), "rows")
        out = out.union(orphan)
    return out
