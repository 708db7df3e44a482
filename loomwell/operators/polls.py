"""Live queries over versions of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.operators.prefix import following


def result_hash(*cols: Column) -> Column:
    """Order-insensitive hash of a group's rows, for change detection."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))).cast("binary"), 256)


def condition_fires(versions: DataFrame) -> DataFrame:
    """Versions (object, version, rows) whose first result is not empty."""
    return versions.filter("rows > 0")


def change_fires(versions: DataFrame) -> DataFrame:
    """Versions (object, version, hash) that differ from the one before; the
    first always fires, and a result that empties fires as well."""
    w = Window.partitionBy("object").orderBy("version")
    fires = ~F.col("hash").eqNullSafe(F.lag("hash").over(w)) | (F.row_number().over(w) == 1)
    return versions.withColumn("fires", fires).filter("fires").drop("fires")


def page(feed: DataFrame, cursor: int, n: int) -> DataFrame:
    """The next ``n`` rows after a cursor, in id order: a top-k, not a sort."""
    return feed.filter(F.col("id") > cursor).orderBy("id").limit(n)


def pages(feed: DataFrame, n: int) -> DataFrame:
    """Every page that a consumer reading ``n`` rows at a time would get:
    feed, page, first_id, last_id, rows."""
    at = F.row_number().over(Window.partitionBy("feed").orderBy("id")) - 1
    return feed.withColumn("page", F.floor(at / n)).groupBy("feed", "page").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("rows"))


def parked(polls: DataFrame, commits: DataFrame) -> DataFrame:
    """(poll, fired): the commit at which each parked poll (poll, object, since,
    durable) answers. A poll is looked at as of ``since``, the last commit when it
    parked, and after each later one that touches its object, so none is missed;
    ``commits`` (object, seq, durable, rows) has what its query finds after each. One
    that isn't durable sees changes of temporary tables too. Null: still parked.

    The commits that can answer are found once for each object, and each poll
    takes the first at or after its start by one window over both sides' rows."""
    # what holds when the poll parks is the last state before it, whatever it finds
    last = commits.select("object", "seq", "durable", "rows")
    side = F.lit(None)
    p = polls.select("object", F.col("since").alias("at"), F.lit(1).alias("side"), "poll", F.col("durable").alias("d"), side.cast("long").alias("seq"), side.cast("long").alias("rows"), side.cast("boolean").alias("firm"))
    c = last.select("object", F.col("seq").alias("at"), F.lit(0).alias("side"), side.cast(polls.schema["poll"].dataType).alias("poll"), side.cast("boolean").alias("d"), F.col("seq").cast("long").alias("seq"), F.col("rows").cast("long").alias("rows"), F.col("durable").alias("firm"))
    both = p.union(c)
    before = Window.partitionBy("object").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("object").orderBy(F.col("at").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    state = lambda c: F.last(F.when(c, F.struct("seq", "rows")), ignorenulls=True).over(before)
    later = lambda c: F.last(F.when(c & (F.col("rows") > 0), F.col("seq")), ignorenulls=True).over(after)
    seen = both.withColumns({"any_now": state(F.col("side") == 0), "firm_now": state(F.col("firm"))}).withColumns({"any_next": later(F.col("side") == 0), "firm_next": later(F.col("firm"))}).filter("side = 1")
    now, then = F.when(F.col("d"), F.col("firm_now")).otherwise(F.col("any_now")), F.when(F.col("d"), F.col("firm_next")).otherwise(F.col("any_next"))
    return seen.select("poll", F.when(now["rows"] > 0, now["seq"]).otherwise(then).alias("fired"))


def ended(polls: DataFrame, events: DataFrame) -> DataFrame:
    """(poll, reason): what ends each poll (poll, conn, object, since) first among
    events (at, kind, conn, object): fire, schema, migrate and revert concern the
    object, cancel and gone the connection, shutdown everyone; null if nothing does.
    A fire answers, schema is an error, cancel and gone are silent, the others ask for a new poll.

    Places in time are numbers. The first event beyond each is found once for an object, a
    connection and everyone, so a connection's polls and its events don't multiply."""
    ends = polls.select("poll", "object", "conn", "since")
    concerned = {"object": (F.col("object"), ("fire", "schema", "migrate", "revert")), "conn": (F.col("conn"), ("cancel", "gone")), "all": (F.lit(0), ("shutdown",))}
    for whom, (key, kinds) in concerned.items():
        marks = events.filter(F.col("kind").isin(*kinds)).select(key.alias("key"), "at", F.col("kind").alias("value"))
        found = following(polls.select(key.alias("key"), F.col("since").alias("at")), marks).toDF("__key", "__since", f"of_{whom}")
        ends = ends.join(found, (key == F.col("__key")) & (F.col("since") == F.col("__since")), "left").drop("__key", "__since")
    first = ends.groupBy("poll").agg(F.min(F.least(*[f"of_{whom}" for whom in concerned]))["value"].alias("kind"))
    reason = F.create_map(*[F.lit(x) for x in ("fire", "answer", "schema", "error", "cancel", "dropped", "gone", "dropped", "migrate", "re-poll", "revert", "re-poll", "shutdown", "re-poll")])
    return polls.select("poll").join(first, "poll", "left").select("poll", reason[F.col("kind")].alias("reason"))


def stale(uses: DataFrame, live: DataFrame, committed: DataFrame) -> DataFrame:
    """``uses`` (object, kind, dirty) with ``refold``: a read folds the log again if more is
    committed than the live copy holds, a write whenever the copy is clean and no
    system object. ``live`` is (object, live_seq), ``committed`` (object, seq)."""
    both = uses.join(live, "object", "left").join(committed.select("object", "seq"), "object", "left")
    behind = F.coalesce("seq", F.lit(0)) > F.coalesce("live_seq", F.lit(0))
    system = F.col("object").startswith("_")
    return both.withColumn("refold", F.when(F.col("kind") == "read", behind).otherwise(~F.col("dirty") & ~system)).select(*uses.columns, "refold")
