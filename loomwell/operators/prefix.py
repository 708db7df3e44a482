"""Running sums and next marks in two levels, so that no task walks all rows of a hot key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a bucket where the order is a number.
BUCKET = 4096


def running(df: DataFrame, by: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``by`` up to
    and with each row, in the order of (``bucket``, ``order``), which must name rows
    without ties. Buckets are summed first, a row each; a window then runs over a
    key's buckets, and one over each bucket's rows."""
    b, v, s, i = (f"__{name}_{x}" for x in ("bucket", "value", "before", "inside"))
    own = df.withColumn(b, bucket).withColumn(v, value)
    sums = own.groupBy(*by, b).agg(F.sum(v).alias(s))
    starts = sums.withColumn(s, F.sum(s).over(Window.partitionBy(*by).orderBy(b)) - F.col(s))
    inside = Window.partitionBy(*by, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    left, right = own.withColumn(i, F.sum(v).over(inside)).alias("rows"), starts.alias("starts")
    same = reduce(lambda x, y: x & y, [F.col(f"rows.{c}").eqNullSafe(F.col(f"starts.{c}")) for c in (*by, b)])
    return left.join(right, same).select(*[F.col(f"rows.{c}") for c in df.columns], (F.col(i) + F.col(f"starts.{s}")).alias(name))


def following(asks: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, at, next): for each place of ``asks`` (key, at), once, the first of ``marks`` (key,
    at, value) of its key that lies beyond it, as a struct of at and the least value there;
    null if none. Places are numbers; those without a key have no row. Asks and marks
    never meet as pairs: a window runs over each bucket's places, of which a key has
    BUCKET at most if they are whole, and one over a key's buckets."""
    kind = marks.schema["value"].dataType
    both = asks.select("key", "at", F.lit(None).cast(kind).alias("value"), F.lit(True).alias("ask")).union(marks.select("key", "at", "value", F.lit(False)))
    places = both.filter("key is not null and at is not null").groupBy("key", F.floor(F.col("at") / BUCKET).alias("bucket"), "at").agg(F.max("ask").alias("ask"), F.min("value").alias("value"))
    places = places.select("key", "bucket", "at", "ask", F.when(F.col("value").isNotNull(), F.struct("at", "value")).alias("mark"))
    beyond = lambda c, order, *by: F.last(c, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1))
    heads = places.groupBy("key", "bucket").agg(F.min("mark").alias("head")).select("key", "bucket", beyond("head", "bucket", "key").alias("later"))
    inside = places.withColumn("inside", beyond("mark", "at", "key", "bucket")).filter("ask")
    return inside.join(heads, ["key", "bucket"]).select("key", "at", F.coalesce("inside", "later").alias("next"))
