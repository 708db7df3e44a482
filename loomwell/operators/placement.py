"""Placement: who owns an object, and when it moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions.scalar import default_worker
from loomwell.operators.prefix import running


def owner(objects: DataFrame, exceptions: DataFrame, logical: int) -> DataFrame:
    """(object, worker): the learned exception if there is one, else the hash owner."""
    e = exceptions.select("object", F.col("worker").alias("learned"))
    return objects.join(e, "object", "left").select("object", F.coalesce("learned", default_worker(F.col("object"), logical)).alias("worker"))


def plurality_target(parts: DataFrame, load: DataFrame) -> DataFrame:
    """(txn, worker) with most participants; ties to fewer exceptions, then to
    the lower worker. ``parts`` is (txn, object, worker), ``load`` (worker, exceptions)."""
    votes = parts.groupBy("txn", "worker").agg(F.count("*").alias("n")).join(load, "worker", "left")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.coalesce("exceptions", F.lit(0)).alias("e"), "worker"))
    return votes.groupBy("txn").agg(best["worker"].alias("worker"))


def crowded(exceptions: DataFrame, logical: int) -> DataFrame:
    """(worker, exceptions, crowded): at or past max(4, 2 * total / logical)."""
    per = exceptions.groupBy("worker").agg(F.count("*").alias("exceptions"))
    total = F.sum("exceptions").over(Window.partitionBy())
    return per.withColumn("crowded", F.col("exceptions") >= F.greatest(F.lit(4), F.floor(2 * total / logical)))


def visits(deeds: DataFrame, gap: int = 1000, needed: int = 3) -> DataFrame:
    """``deeds`` (object, tick, worker) with ``visits``, counted while the worker
    stays the same and the gap is at most ``gap`` ticks, and ``rehome``."""
    w = Window.partitionBy("object").orderBy("tick")
    fresh = ~(F.lag("worker").over(w).eqNullSafe(F.col("worker")) & (F.col("tick") - F.lag("tick").over(w) <= gap))
    island = F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w)
    out = deeds.withColumn("island", island)
    return out.withColumn("visits", F.row_number().over(Window.partitionBy("object", "island").orderBy("tick"))).withColumn("rehome", F.col("visits") >= needed).drop("island")


def release(held: DataFrame, hysteresis: int = 200) -> DataFrame:
    """``held`` (object, seq, generation, transit_generation, arrived_at, travelling)
    with the next generation and whether the deed counts as settled."""
    gen = F.greatest(F.coalesce("generation", F.lit(0)), F.coalesce("transit_generation", F.lit(0)), F.lit(0)) + 1
    return held.withColumn("next_generation", gen).withColumn("settled", F.col("travelling") | (F.col("seq") - F.col("arrived_at") >= hysteresis))


def best_claim(claims: DataFrame) -> DataFrame:
    """(object, worker, generation, owned): the claim of the highest generation,
    owned before transit, then the lower worker."""
    best = F.max(F.struct("generation", "owned", (-F.col("worker")).alias("w")))
    return claims.groupBy("object").agg(best.alias("b")).select("object", (-F.col("b")["w"]).alias("worker"), F.col("b")["generation"].alias("generation"), F.col("b")["owned"].alias("owned"))


def lease_holders(leases: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(block, epoch, holder, released): the latest epoch of each block."""
    last = leases.groupBy("block").agg(F.max(F.struct("epoch", "holder")).alias("l")).select("block", F.col("l")["epoch"].alias("epoch"), F.col("l")["holder"].alias("holder"))
    return last.join(tombstones.select("block", "epoch", F.lit(True).alias("released")).distinct(), ["block", "epoch"], "left").withColumn("released", F.coalesce("released", F.lit(False)))


def superseded(mine: DataFrame, leases: DataFrame) -> DataFrame:
    """(block) of ``mine`` (block, epoch) for which a later epoch exists."""
    last = leases.groupBy("block").agg(F.max("epoch").alias("last"))
    return mine.join(last, "block").filter("last > epoch").select("block")


def block_of(worker: Column, blocks: int, logical: int) -> Column:
    return F.floor(worker * blocks / logical).cast("long")


def block_range(block: Column, blocks: int, logical: int) -> tuple[Column, Column]:
    """First and past-the-last worker of a block; blocks tile the workers."""
    return F.ceil(block * logical / blocks).cast("long"), F.ceil((block + 1) * logical / blocks).cast("long")


def chase(hints: DataFrame, start: DataFrame, most: int = 8) -> DataFrame:
    """(object, worker, hops): follow owner hints (object, worker, next) from
    (object, worker) for at most ``most`` steps; an owner has no hint."""
    now = start.select("object", "worker").withColumn("hops", F.lit(0))
    h = hints.select("object", "worker", "next")
    for _ in range(most):
        now = now.join(h, ["object", "worker"], "left").select("object", F.coalesce("next", "worker").alias("worker"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    return now


def evict(files: DataFrame, budget: int) -> DataFrame:
    """``files`` (worker, file, bytes, touched, cache) with ``evicted``: cache files
    go, oldest touched first, until what a worker uses fits the budget. Files
    touched at the same time are a bucket of the running sum."""
    used = files.groupBy("worker").agg(F.sum("bytes").alias("used"))
    sums = running(files, ["worker", "cache"], F.col("touched"), ["file"], F.col("bytes"), "upto")
    out = sums.join(used, "worker").withColumn("evicted", F.col("cache") & (F.col("used") - (F.col("upto") - F.col("bytes")) > budget))
    return out.select(*files.columns, "evicted")


def going_home(objects: DataFrame) -> DataFrame:
    """Idle, clean objects whose home is another worker: (object, worker, home)."""
    return objects.filter("idle and not dirty and home is not null and home <> worker").select("object", "worker", "home")


def reconcile(claims: DataFrame, logical: int) -> DataFrame:
    """After a restart: the claim of the highest generation, then of the lower
    worker; and whether it is an exception to the hash owner."""
    best = F.max(F.struct("generation", (-F.col("worker")).alias("w")))
    kept = claims.groupBy("object").agg((-best["w"]).alias("worker"))
    return kept.withColumn("exception", F.col("worker") != default_worker(F.col("object"), logical))


def limits(memory: Column, disk: Column) -> Column:
    """Budgets of a node: disk, boat bytes (16 MiB to 1 GiB), activation permits."""
    boat = F.least(F.greatest(F.floor(memory / 8), F.lit(16 << 20)), F.lit(1 << 30))
    return F.struct(F.floor(disk * 6 / 10).cast("long").alias("disk_budget"), boat.cast("long").alias("boat"), F.when(memory >= 4 << 30, 4).otherwise(2).alias("permits"))


def shed(objects: DataFrame) -> DataFrame:
    """What stays after idle, clean, unqueued objects are dropped."""
    return objects.filter("not (idle and not dirty and queued = 0)")


def edge_route(requests: DataFrame, logical: int) -> DataFrame:
    """``requests`` (path, objects) with ``worker``: /objects/{id}... goes to the id's hash
    owner, /txn to that of the first participant in order, /ws?for={id} to the id's;
    anything else, null, to any."""
    of_path = F.regexp_extract("path", "^/objects/([^/?]+)", 1)
    of_socket = F.regexp_extract("path", "^/ws[?](?:.*&)?for=([^&]+)", 1)
    of_txn = F.when(F.col("path").startswith("/txn"), F.element_at(F.array_sort(F.col("objects")), 1))
    obj = F.coalesce(F.nullif(of_path, F.lit("")), F.nullif(of_socket, F.lit("")), of_txn)
    return requests.withColumn("worker", F.when(obj.isNotNull(), default_worker(F.coalesce(obj, F.lit("")), logical)))
