"""Helpers shared by the training-data operators.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.sources.shared import scratch, shared_dir, stored  # noqa: F401

#: A word: a run without space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_prefix(df: DataFrame) -> str:
    """A beginning of names that no column of ``df`` has."""
    p = "__own_"
    while any(c.lower().startswith(p) for c in df.columns):
        p = "_" + p
    return p


def n_words(text: Column | str) -> Column:
    """Number of words as a long; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_slices(column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``most`` bytes (always a
    row at least): (first row, past last row, bytes, offsets from 0). Null
    gives an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def trim() -> None:
    """Memory that is free here goes back to the system; Python workers outlive their tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes that part words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: 64-bit words of a bitmap.
BITMAP = 1 << 20


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each hash ``k``: 8 MB whatever the input. With more keys more of the bits that it has none for are set."""
    words = keys.select(F.pmod(F.shiftright("k", 6), F.lit(BITMAP)).alias("w"), F.expr("shiftleft(1L, int(k & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITMAP, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(k: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes may be among a bitmap's keys; all that are, and some others."""
    return (bits[np.mod(k >> 6, BITMAP)] >> (k & 63).astype(np.uint64)) & np.uint64(1) == 1
