"""Dataflow over object logs: long tables keyed by (object, seq).

entries: object, seq, txn, born, kind ('snapshot' or 'delta'), payload
outcomes: txn, committed (a missing row is pending)
bases: object, base_seq
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of one object that one group holds at most.
BUCKET = 4096


def commit_race(attempts: DataFrame) -> DataFrame:
    """(txn, committed) of (txn, t, commit) attempts: the first decides, a commit
    before an abort at the same time. A partial aggregate, so a transaction
    with very many attempts costs one row a task."""
    first = F.min(F.struct(F.col("t"), (~F.col("commit")).alias("abort")))
    return attempts.groupBy("txn").agg(first.alias("f")).select("txn", (~F.col("f")["abort"]).alias("committed"))


def marked(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entries with ``committed``: null while pending."""
    return entries.join(outcomes.select("txn", "committed"), "txn", "left")


def committed_seq(entries: DataFrame, outcomes: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """(object, base_seq, seq): the end of each object's contiguous committed
    prefix above its latest base.

    Two levels: the first gap inside each bucket of BUCKET numbers, then the
    first bucket that is not whole. No group grows with an object's log.
    """
    ok = marked(entries, outcomes).select("object", "seq", F.coalesce("committed", F.lit(False)).alias("ok"))
    objects = ok.select("object").distinct()
    if bases is None:
        start = objects.withColumn("base_seq", F.lit(0).cast("long"))
    else:
        latest = bases.groupBy("object").agg(F.max("base_seq").alias("base_seq"))
        start = objects.union(latest.select("object")).distinct().join(latest, "object", "left").withColumn("base_seq", F.coalesce("base_seq", F.lit(0).cast("long")))
    above = ok.filter("ok").join(start, "object").filter("seq > base_seq").select("object", "base_seq", (F.col("seq") - F.col("base_seq") - 1).alias("at"))
    bucket = above.groupBy("object", "base_seq", F.floor(F.col("at") / BUCKET).alias("bucket")).agg(F.array_sort(F.collect_set((F.col("at") % BUCKET).cast("int"))).alias("here"))
    # length of the run 0, 1, 2, ... at the bucket's beginning
    run = F.size(F.filter("here", lambda x, i: x == i))
    runs = bucket.select("object", "base_seq", "bucket", run.alias("run"))
    w = Window.partitionBy("object").orderBy("bucket")
    whole = runs.withColumn("before", F.sum("run").over(w) - F.col("run")).filter(F.col("before") == F.col("bucket") * BUCKET)
    ends = whole.groupBy("object").agg(F.max(F.col("base_seq") + F.col("before") + F.col("run")).alias("seq"))
    return start.join(ends, "object", "left").select("object", "base_seq", F.coalesce("seq", "base_seq").alias("seq"))


def fold_committed(entries: DataFrame, outcomes: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """committed_seq with the payload of the last snapshot in the prefix and the
    number of deltas after it; a null payload means that the base stands."""
    ends = committed_seq(entries, outcomes, bases)
    inside = entries.join(ends, "object").filter((entries["seq"] > F.col("base_seq")) & (entries["seq"] <= ends["seq"]))
    inside = inside.select("object", entries["seq"].alias("at"), "kind", "payload")
    last = inside.groupBy("object").agg(F.max(F.when(F.col("kind") == "snapshot", F.struct("at", "payload"))).alias("snap"))
    return ends.join(last, "object", "left").select(
        "object", "base_seq", "seq", F.col("snap")["payload"].alias("payload"), (F.col("seq") - F.coalesce(F.col("snap")["at"], F.col("base_seq"))).alias("deltas_after")
    )


def prewrite(attempts: DataFrame, slots: DataFrame, ends: DataFrame, ttl: int) -> DataFrame:
    """Decision for each attempt (object, expected, txn, now): 'rebase', 'create',
    'own', 'rival', 'retake', 'wait' or 'abort_then_retake'. ``slots`` holds the
    entry at expected + 1 with txn, born and committed; ``ends`` committed_seq."""
    at = attempts.join(ends.select("object", F.col("seq").alias("end")), "object", "left").withColumn("slot", F.col("expected") + 1)
    held = slots.select("object", F.col("seq").alias("slot"), F.col("txn").alias("holder"), "born", "committed")
    j = at.join(held, ["object", "slot"], "left")
    choice = (
        F.when(F.coalesce("end", F.lit(0)) != F.col("expected"), "rebase")
        .when(F.col("holder").isNull(), "create")
        .when(F.col("holder") == F.col("txn"), "own")
        .when(F.col("committed"), "rival")
        .when(F.col("committed") == F.lit(False), "retake")
        .when(F.col("now") - F.col("born") <= ttl, "wait")
        .otherwise("abort_then_retake")
    )
    return j.select("object", "txn", "expected", choice.alias("decision"))


def clear_entries(entries: DataFrame, outcomes: DataFrame, txns: DataFrame) -> DataFrame:
    """Entries left when those of ``txns`` that aren't committed are removed."""
    gone = txns.select("txn").distinct().join(outcomes.filter("committed"), "txn", "left_anti")
    return entries.join(gone, "txn", "left_anti")


def compaction_due(ends: DataFrame, keep: int = 8) -> DataFrame:
    """Objects whose committed prefix is ``keep`` or more past the base, with the new base."""
    return ends.filter(F.col("seq") - F.col("base_seq") >= keep).select("object", F.col("seq").alias("base_seq"))


def ship_choice(size: str = "size", chain: str = "chain", delta: str = "delta"):
    """Payload by the delta engine's rule: small files and long chains ship whole."""
    return F.when(F.col(size) < 64 * 1024, "snapshot").when((F.col(chain) + 1 > 16) | (F.col(delta) * 3 > F.col(size)), "compacting").otherwise("delta")


def pages(images: DataFrame, page_size: int = 4096) -> DataFrame:
    """(object, version, page_no, bytes, hash, length) of binary images."""
    n = F.greatest(F.ceil(F.length("image") / page_size), F.lit(0)).cast("int")
    numbered = images.filter(F.length("image") > 0).select("object", "version", "image", F.explode(F.sequence(F.lit(0), n - 1)).alias("page_no"))
    b = F.substring("image", F.col("page_no") * page_size + 1, F.lit(page_size))
    return numbered.select("object", "version", "page_no", b.alias("bytes"), F.xxhash64(b).alias("hash"), F.length("image").alias("length"))


def page_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of ``new`` that ``old`` lacks or has otherwise."""
    o = old.select("object", "page_no", F.col("hash").alias("old_hash"))
    return new.join(o, ["object", "page_no"], "left").filter("old_hash is null or old_hash <> hash").drop("old_hash")


def page_apply(old: DataFrame, delta: DataFrame, lengths: DataFrame, page_size: int = 4096) -> DataFrame:
    """(object, image): ``old`` pages overwritten by ``delta``, cut to (object, length)."""
    both = old.select("object", "page_no", "bytes", F.lit(0).alias("v")).union(delta.select("object", "page_no", "bytes", F.lit(1).alias("v")))
    last = both.groupBy("object", "page_no").agg(F.max(F.struct("v", "bytes"))["bytes"].alias("bytes")).join(lengths.select("object", "length"), "object").filter(F.col("page_no") * page_size < F.col("length"))
    parts = last.groupBy("object", "length").agg(F.array_sort(F.collect_list(F.struct("page_no", "bytes"))).alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"]))
    return parts.select("object", F.substring(whole, F.lit(1), F.col("length")).alias("image"))


#: Fixed values of the entry format: tags of the payload's kind.
TAGS = {"snapshot": 0, "delta": 1}


def encode_entry(kind: Column, born: Column, txn: Column, payload: Column) -> Column:
    """One entry as bytes: tag, born (8, big-endian), length of txn (2), txn, payload."""

    def wide(n: Column, width: int) -> Column:
        return F.unhex(F.lpad(F.hex(n.cast("long")), width, "0"))

    return F.concat(wide(F.when(kind == "snapshot", 0).otherwise(1), 2), wide(born, 16), wide(F.octet_length(txn), 4), txn.cast("binary"), payload)


def decode_entry(b: Column) -> Column:
    """struct(kind, born, txn, payload); null for bytes that are no entry."""

    def number(at: int, width: int) -> Column:
        return F.conv(F.hex(F.substring(b, F.lit(at), F.lit(width))), 16, 10).cast("long")

    n = number(10, 2).cast("int")
    kind = F.when(number(1, 1) == 0, "snapshot").when(number(1, 1) == 1, "delta")
    txn = F.substring(b, F.lit(12), n).cast("string")
    whole = F.struct(kind.alias("kind"), number(2, 8).alias("born"), txn.alias("txn"), F.substring(b, n + 12, F.octet_length(b)).alias("payload"))
    return F.when((F.octet_length(b) >= 11) & (F.octet_length(b) >= 11 + n) & kind.isNotNull(), whole)


def roll_forward(durable: DataFrame, records: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recovery of the delta engine. ``durable`` (object, counter), committed
    ``records`` (txn, object, counter) and ``staged`` (txn, object): the objects'
    counters after replay, which never go back, and the orphans to delete."""
    after = durable.select("object", "counter").union(records.select("object", "counter")).groupBy("object").agg(F.max("counter").alias("counter"))
    return after, staged.join(records.select("txn").distinct(), "txn", "left_anti")


def live_view(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entries that a read through the owner sees: committed or still pending."""
    return marked(entries, outcomes).filter("committed is null or committed")


def durable_view(entries: DataFrame, outcomes: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Entries that a read past the owner sees: the committed prefix."""
    ends = committed_seq(entries, outcomes, bases).select("object", F.col("seq").alias("end"))
    return entries.join(ends, "object").filter("seq <= end").drop("end")


#: Fixed value: bytes above which a batch is staged beside the log.
STAGE = 96 * 1024


def ship(batches: DataFrame, entries: DataFrame) -> DataFrame:
    """What becomes of each batch on its way to the log: staged, outcome, entries.

    ``batches`` is (batch, bytes, fence, now, leases): leases of all participants
    held?; ``entries`` (batch, object, expected, seq, drops): the place prewritten, the
    log's end, and whether the durable content would lose keys. In order: wait for
    the fence, check the leases, check the content, prewrite by object; the first
    object that fails names the fault, and its batch clears what it prewrote."""
    fault = F.when(F.col("drops"), "content").when(F.col("expected") != F.col("seq"), "rebase")
    per = entries.withColumn("fault", fault).groupBy("batch").agg(F.count("*").alias("n"), F.min(F.when(F.col("fault") == "content", F.struct("object", "fault"))).alias("c"), F.min(F.when(F.col("fault") == "rebase", F.struct("object", "fault"))).alias("r"))
    first = F.coalesce(F.col("c"), F.col("r"))
    outcome = F.when(F.col("now") < F.col("fence"), "wait").when(~F.col("leases"), "fenced").when(first.isNotNull(), F.concat(first["fault"], F.lit(" "), first["object"])).otherwise("committed")
    out = batches.join(per, "batch", "left")
    return out.select("batch", (F.col("bytes") > STAGE).alias("staged"), outcome.alias("outcome"), F.when(outcome == "committed", F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("entries"))
