"""Scalar functions with the semantics of the small-database dialect, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits: offset basis and prime (fixed values).
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a64(text: Column) -> Column:
    """FNV-1a-64 of an ASCII string as decimal(20,0), without a UDF. XOR only
    touches the low byte, so the state fits a decimal."""
    dec = "decimal(20,0)"
    codes = F.transform(F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>")), lambda i: F.ascii(text.substr(i, F.lit(1))))

    def step(h: Column, b: Column) -> Column:
        low = (h % 256).cast("int")
        mixed = h - low + low.bitwiseXOR(b)
        return ((mixed.cast(dec) * F.lit(str(FNV_PRIME)).cast("decimal(13,0)")) % F.lit(str(1 << 64)).cast(dec)).cast(dec)

    return F.aggregate(codes, F.lit(str(FNV_BASIS)).cast(dec), step)


def default_worker(obj: Column, logical: int) -> Column:
    """Hash owner of an object among ``logical`` workers."""
    return (fnv1a64(obj) % logical).cast("long")


def py_fnv1a64(data: bytes) -> int:
    return reduce(lambda h, b: ((h ^ b) * FNV_PRIME) % (1 << 64), data, FNV_BASIS)


def poll_hash(results_json: str) -> str:
    """Change-detection hash of a serialised result, 16 lower-case hex digits."""
    return f"{py_fnv1a64(results_json.encode()):016x}"


def valid_id(obj: Column) -> Column:
    """1 to 64 characters of ``A-Za-z0-9_-``, not beginning with an underscore."""
    return F.coalesce(obj.rlike("^[A-Za-z0-9-][A-Za-z0-9_-]{0,63}$") & ~obj.contains("\n"), F.lit(False))


def glob(text: Column, pattern: str) -> Column:
    """Case-sensitive GLOB: ``*``, ``?`` and ``[...]`` classes."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2)
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + inner + "]"
            i = close
        else:
            out += re.escape(ch)
        i += 1
    return text.rlike(f"(?s)^{out}$")


def like(text: Column, pattern: str) -> Column:
    """LIKE, which ignores case."""
    return text.ilike(pattern)


def least_of(*cols: Column) -> Column:
    """Scalar min: null if any argument is."""
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in cols]), F.lit(None)).otherwise(F.least(*cols))


def greatest_of(*cols: Column) -> Column:
    """Scalar max: null if any argument is."""
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in cols]), F.lit(None)).otherwise(F.greatest(*cols))


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates; null by zero."""
    q = F.try_divide(a.cast("decimal(20,0)"), b.cast("decimal(20,0)"))
    return F.when(b == 0, F.lit(None)).otherwise(F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))).cast("long")


def int_mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; null by zero."""
    return F.try_mod(a, b)


def to_integer(text: Column) -> Column:
    """CAST(text AS INTEGER): the longest integer at the beginning, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]{1,18})", 1).try_cast("long"), F.when(text.isNull(), F.lit(None)).otherwise(F.lit(0))).cast("long")


def total(c: Column) -> Column:
    """TOTAL: a double, 0.0 for no rows."""
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def group_concat(c: Column, sep: str = ",", *order: Column) -> Column:
    """GROUP_CONCAT of the values in a stated order; null for no values."""
    items = F.array_sort(F.collect_list(F.struct(*order, c.cast("string").alias("__v")))) if order else F.collect_list(F.struct(c.cast("string").alias("__v")))
    kept = F.filter(F.transform(items, lambda x: x["__v"]), lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))


def typeof(c: Column, kind: str) -> Column:
    """Storage class of a value of the given Spark type."""
    name = {"string": "text", "binary": "blob", "double": "real", "float": "real"}.get(kind, "integer")
    return F.when(c.isNull(), "null").otherwise(name)


def quote(c: Column, kind: str) -> Column:
    """The value as a literal."""
    if kind == "string":
        return F.when(c.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))
    if kind == "binary":
        return F.when(c.isNull(), "NULL").otherwise(F.concat(F.lit("X'"), F.hex(c), F.lit("'")))
    return F.when(c.isNull(), "NULL").otherwise(c.cast("string"))


def add_months_overflowing(ts: Column, months: int) -> Column:
    """'+N months' that lets a day past the month's end run into the next."""
    first = F.trunc(ts, "month")
    return F.date_add(F.add_months(first, months), F.dayofmonth(ts) - 1)


def split_mix(seed: int, n: Column) -> Column:
    """The ``n``-th number (from 1) of a SplitMix64 stream, as a signed long: the
    generator's state is seed + n times its step, so any place is found without
    those before it. Products wrap, which a long's bits do by halves."""
    golden, m1, m2, half = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, F.lit(0xFFFFFFFF)

    def let(x: Column, f) -> Column:
        """f of x, with x computed once."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def plus(x: Column, y: Column) -> Column:
        """x + y modulo 2**64, by halves, as a long's overflow is an error."""

        def of(a: Column, b: Column) -> Column:
            low = a.bitwiseAND(half) + b.bitwiseAND(half)
            high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32)
            return let(low, lambda c: F.shiftleft(high + F.shiftrightunsigned(c, 32), 32).bitwiseOR(c.bitwiseAND(half)))

        return let(x, lambda a: let(y, lambda b: of(a, b)))

    def small(u: Column, v: int) -> Column:
        """u * v modulo 2**64 of two 32-bit numbers, by the halves of v."""
        return plus(F.shiftleft(u * F.lit(v >> 16), 16), u * F.lit(v & 0xFFFF))

    def times(x: Column, m: int) -> Column:
        """x * m modulo 2**64."""

        def of(v: Column) -> Column:
            low, high = v.bitwiseAND(half), F.shiftrightunsigned(v, 32)
            middle = small(low, m >> 32).bitwiseAND(half) + small(high, m & 0xFFFFFFFF).bitwiseAND(half)
            return plus(small(low, m & 0xFFFFFFFF), F.shiftleft(middle, 32))

        return let(x, of)

    def mixed(z: Column, by: int) -> Column:
        return let(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, by)))

    signed = seed - (1 << 64) if seed >= 1 << 63 else seed
    z = plus(F.lit(signed).cast("long"), times(n.cast("long"), golden))
    return mixed(times(mixed(times(mixed(z, 30), m1), 27), m2), 31)
