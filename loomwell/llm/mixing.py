"""Mixing sources to target weights by a time-varying curriculum (native).

Each source has a weight (its share of the whole mix) and a schedule: a
piecewise-linear density over training time 0..1 that says when its words are
wanted. The schedule is integrated, a document's place in its source's stream
is a cumulative demand, and inverting the integral at that demand gives the
document's training position; the mix is then range-sorted by position.

The stream of a source is its documents in an order drawn by hash. Its offsets
are prefix sums in two levels (hash buckets of a source, then rows of a
bucket), so a source with a third of all rows is dealt over thousands of
groups. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.llm.common import n_words, own_prefix

#: Schedules dealt to the sources in turn: (time, density) knots.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 1.5)),
)

#: 2**BITS hash buckets of each source: rows of one bucket are summed in order by one task.
BITS = 12


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """The normalised integral of a schedule, one tuple a segment:
    (demand at its start, demand at its end, time at its start, density there, slope)."""
    area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))
    if area <= 0 or any(d < 0 for _, d in knots):
        raise ValueError("a schedule needs densities of 0 or more and a positive integral")
    out, y = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        if t1 > t0:
            a, b, d = a / area, b / area, t1 - t0
            out.append((y, y + d * (a + b) / 2, t0, a, (b - a) / d))
            y = out[-1][1]
    return out


def inverse(knots: Sequence[tuple[float, float]], demand: Column) -> Column:
    """The time at which the integral of the schedule reaches ``demand`` (0..1)."""
    parts = segments(knots)
    out = None
    for k, (y0, y1, t0, a, slope) in enumerate(parts):
        y = F.greatest(demand - F.lit(y0), F.lit(0.0))
        # a x + slope x**2 / 2 = y, in the form that holds for slope 0 and a 0 too
        root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * y, F.lit(0.0)))
        t = F.lit(t0) + F.coalesce(F.try_divide(2 * y, F.lit(a) + root), F.lit(0.0))
        if k == len(parts) - 1:
            out = t if out is None else out.otherwise(t)
        else:
            out = F.when(demand < y1, t) if out is None else out.when(demand < y1, t)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (skey, source_size) with rank and target: ``share`` times all
    sizes dealt by weight, each stopping at ``most`` times its source's size
    and the rest dealt again. The fixed point is min(most * size, level *
    weight); the level is found with sums over the sources in the order in
    which they fill. One row a source, as many as there are sources."""
    by_name, filling = Window.orderBy("skey"), Window.orderBy("fills_at", "skey")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    return (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("wanted", share * F.sum("source_size").over(everything))
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level_if", (F.col("wanted") - F.col("cap_before")) / F.col("weight_left"))
        # the first source in filling order that its level does not fill sets the level of all after it
        .withColumn("level", F.min(F.when(F.col("level_if") < F.col("fills_at"), F.struct("fills_at", "skey", "level_if"))).over(everything)["level_if"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
        .select("skey", "rank", "source_size", "target")
    )


def aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns of those names, in any case, renamed by as many ``_in`` as make them new."""
    for name in names:
        for c in [c for c in df.columns if c.lower() == name.lower()]:
            new = c + "_in"
            while new.lower() in {x.lower() for x in df.columns}:
                new += "_in"
            df = df.withColumnRenamed(c, new)
    return df


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: int = 42,
    bits: int = BITS,
    name: str = "mix",
) -> DataFrame:
    """One row for each document: the columns of ``docs`` and ``name``, a struct of
    size, source_size, target, taken, copies, position (0..1, of its first words
    in the mix) and positions (of all copies: a second one comes when a whole
    pass over the source has been taken).

    ``taken`` counts words: whole passes over the source, then the stream's
    beginning up to the target, so a source's taken words are its target
    rounded down. At most one document of a source is taken in part in the
    last pass; ``copies`` is taken / size rounded. Null text has size 0 and
    null sources are one source of their own, last in order. Documents of size
    0 take part with taken 0 and copies 1 if their place is wanted. Repeated
    rows are separate documents: rows alike in id, source and text follow each
    other in one bucket, whose sum runs through them without holding them. An
    empty table gives no rows. Columns pass through whatever their names; one
    called ``name`` is renamed (``aside``).
    """
    docs = aside(docs, name)
    named, p = docs.columns, own_prefix(docs)
    skey, h, bucket, size = (F.col(f"{p}{x}") for x in ("skey", "h", "bucket", "size"))
    own = docs.withColumns(
        {
            f"{p}skey": F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")),
            # the text's hash too, so that rows of one id, or of none, are dealt over all buckets
            f"{p}h": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.xxhash64("text")),
            f"{p}size": n_words("text"),
        }
    ).withColumn(f"{p}bucket", F.shiftrightunsigned(h, 64 - bits).cast("int"))
    sums = own.groupBy(skey.alias("skey"), bucket.alias("bucket")).agg(F.sum(size).alias("bucket_size"))
    sizes = sums.groupBy("skey").agg(F.sum("bucket_size").alias("source_size"))
    starts = sums.join(targets(sizes, weights, share, most), "skey").withColumn(
        "before", F.sum("bucket_size").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("bucket_size")
    )
    starts = starts.select(*[F.col(c).alias(f"{p}{c}") for c in ("skey", "bucket", "before", "rank", "source_size", "target")])
    inside = Window.partitionBy(skey, bucket).orderBy(h, "doc_id", size).rowsBetween(Window.unboundedPreceding, 0)
    placed = own.withColumn(f"{p}at", F.sum(size).over(inside) - size).join(starts, [f"{p}skey", f"{p}bucket"])
    at, target, source_size = F.col(f"{p}at") + F.col(f"{p}before"), F.col(f"{p}target"), F.col(f"{p}source_size")
    whole = F.floor(target).cast("long")
    passes = F.coalesce(F.try_divide(whole, source_size).cast("long"), F.lit(0))
    rest = whole - passes * source_size
    part = F.greatest(F.least(rest - at, size), F.lit(0)).cast("long")
    taken = passes * size + part
    copies = F.coalesce(F.floor(F.try_divide(taken, size) + F.lit(0.5)), F.when((passes > 0) | (at < rest), 1).otherwise(0)).cast("int")
    chosen = F.col(f"{p}rank") % len(schedules)

    def place(copy: Column) -> Column:
        """Where the demand that lies before a copy is reached."""
        demand = F.least(F.coalesce(F.try_divide((at + copy * source_size).cast("double"), target), F.lit(0.0)), F.lit(1.0))
        out = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            out = F.when(chosen == k, inverse(knots, demand)).otherwise(out)
        return out

    numbers = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    fields = {"size": size, "source_size": source_size, "target": target, "taken": taken, "copies": copies, "position": place(F.lit(0)), "positions": F.transform(numbers, place)}
    made = F.struct(*[c.alias(k) for k, c in fields.items()])
    return placed.select(*[F.col(f"`{c}`") for c in named], made.alias(name))


def ordered(mixed: DataFrame, name: str = "mix", every: bool = False) -> DataFrame:
    """The mix itself: every taken document, as many rows as copies, range-sorted
    by training position, with ``name`` + _copy and ``name`` + _position (columns
    of those names are renamed). With ``every``, documents that are not taken
    have one row too, where their first copy would be."""
    copy, at = f"{name}_copy", f"{name}_position"
    mixed = aside(mixed, copy, at)
    places = F.col(f"`{name}`")["positions"]
    if every:
        places = F.when(F.size(places) > 0, places).otherwise(F.array(F.col(f"`{name}`")["position"]))
    rows = mixed.select(*[F.col(f"`{c}`") for c in mixed.columns], F.posexplode(places).alias(copy, at))
    return rows.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id", copy)


def taken(docs: DataFrame) -> DataFrame:
    """``docs`` as often as the mix takes them, in training order, no other column."""
    name = own_prefix(docs) + "mix"
    return ordered(mix(docs, name=name), name).select(*[F.col(f"`{c}`") for c in docs.columns])
