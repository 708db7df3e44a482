"""Best-fit packing of documents into fixed-length sequences by sum of squares.

Let N(g) be the number of open bins with residual gap g. A piece of length s
goes where the sum of N(g)**2 over the gaps becomes smallest: into a bin of gap
g the sum changes by 2 (N(g - s) - N(g) + 1), less if it fills the bin or
opens one. Keeping the counts even leaves a bin for every length to come.

Pieces are dealt to shards of a bounded number, by hash or, where an order is
given, by runs of it, and packed there; the bins that a shard leaves unfilled
are dealt again to fewer shards and packed once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.llm.common import own_prefix, stored, utf8_slices
from loomwell.llm.tokens import encoder, vocabulary

#: Tokens of a sequence, the id that ends a document, pieces of a shard.
LENGTH, END, SHARD = 2048, 0, 40_000

#: Bits of an order that number the rows of a file, and those of a shard's number that number its parts.
PLACE, PART = 40, 18

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def in_order(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the rows' present order as the long ``name``: the number in a
    Parquet file's name (part-00012-...) and the place in the file, or the
    partition and the place in it where rows don't come from such files."""
    try:
        file, row = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), F.col("_metadata.row_index")
        return docs.select("*", (F.shiftleft(F.coalesce(file.try_cast("long"), F.lit(0).cast("long")), PLACE) + row).alias(name))
    except AnalysisException as e:
        if e.getCondition() is None or not e.getCondition().startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND")):
            raise
        n = F.monotonically_increasing_id()
        return docs.select("*", (F.shiftleft(F.shiftright(n, 33), PLACE) + n.bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """Cut each document's ids, with the end id, into pieces of at most ``length``:
    doc_id, piece, start, length, ids_crc32.

    Only longer documents are cut; the last piece may be shorter. Null and
    empty texts are the end id alone. Repeated rows are separate documents. An
    empty table gives no rows; other columns are not read. ``with_ids`` adds the
    ids themselves, ``order`` names a long column that goes along as ``order``.
    """
    tokenizer = tokenizer or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for a, b, _, _ in utf8_slices(texts, 4 << 20):
                ids, at = encode(texts[a:b].fill_null("").to_pylist())
                n = np.diff(at) + 1
                ids = np.insert(ids, at[1:], end).astype("<u4")
                cuts = -(-n // length)
                doc = np.repeat(np.arange(b - a), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * length
                size = np.minimum(n[doc] - start, length)
                data = memoryview(ids).cast("B")
                begin = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(data[4 * x : 4 * (x + k)]) for x, k in zip(begin.tolist(), size.tolist(), strict=True)]
                cols = [batch.column(0)[a:b].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                if order:
                    cols.append(batch.column(2)[a:b].take(pa.array(doc)))
                if with_ids:  # pieces follow each other in ids
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", *["order"] * bool(order), *["ids"] * with_ids])

    read = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(f"`{order}`").cast("long")] * bool(order))
    return read.mapInArrow(run, PIECES + ", order long" * bool(order) + ", ids array<int>" * with_ids)


def sum_of_squares(sizes: np.ndarray, length: int, open_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, taken in the given order, and the bins' fill.

    ``open_only`` opens a bin only when no open one has room.
    """
    n_open = np.zeros(length + 1, np.int64)  # by gap; gaps 0 and length aren't counted
    bins: list[list[int]] = [[] for _ in range(length + 1)]
    where, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        gap, best = length, far
        if s < length:
            here = n_open[s + 1 : length]
            if here.any():  # a wider gap turns into a narrower one
                change = np.where(here > 0, 2 * (n_open[1 : length - s] - here + 1), far)
                k = int(change.argmin())
                gap, best = s + 1 + k, int(change[k])
            if n_open[s] and 1 - 2 * n_open[s] <= best:  # an exact fill takes a gap away
                gap, best = s, 1 - 2 * int(n_open[s])
            if 2 * n_open[length - s] + 1 < best and not (open_only and best < far):
                gap = length
        if gap == length:
            b = len(fill)
            fill.append(0)
        else:
            b = bins[gap].pop()
            n_open[gap] -= 1
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if gap - s:
            bins[gap - s].append(b)
            n_open[gap - s] += 1
    return where, offset, np.array(fill, np.int64)


def pack(items: DataFrame, length: int = LENGTH, shard: int = SHARD, rounds: int = 2, order: str | None = None) -> DataFrame:
    """``items`` (any columns, with an integer ``length`` of 1 to ``length``)
    with sequence_id and offset, gapless from 0 in each sequence.

    Rows are dealt to shards of about ``shard`` rows, by hash of a row's number,
    so that neither a hot key nor repeated rows meet in one, or, with ``order``
    (a column as of ``in_order``), by runs of it; a shard is packed in one
    task, longest pieces first. Bins filled below the whole are dealt again to
    shards of the same size in the next round, which are fewer, and the last
    round settles: a shard then leaves a few bins unfilled. With ``order`` a
    sequence holds pieces of one run or of neighbouring ones, and sequence ids
    rise with the order. Columns named sequence_id and offset are replaced, all
    other names pass through; an empty table gives no rows. Null, zero and
    longer lengths are an error of the caller.
    """
    p = own_prefix(items)
    names = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    kept = [F.col(f"`{c}`") for c in names]
    number = F.col(f"`{order}`") if order else F.monotonically_increasing_id()
    df = stored(items.select(*kept, number.alias(f"{p}row")), "pieces")
    out_schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    row, at = F.col(f"{p}row"), F.col(f"{p}shard")
    if order:
        # shards are runs of a file's rows, numbered as files and rows are
        run = F.shiftleft(F.shiftright(row, PLACE), PART) + F.floor(row.bitwiseAND(F.lit((1 << PLACE) - 1)) / shard).cast("long")
        todo, done = df.withColumn(f"{p}shard", run), []
    else:
        full = df.filter(F.col("length") == length).select(*kept, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        todo, done = df.filter(F.col("length") < length), [full]
    for k in range(rounds):
        if not order:
            n = max(1, -(-todo.count() // shard))
            todo = todo.withColumn(f"{p}shard", F.pmod(F.xxhash64(F.lit(k), row), F.lit(n)))
        else:
            n, shards, files, runs = todo.agg(F.count("*"), F.count_distinct(at), F.max(F.shiftright(at, PART)), F.max(at.bitwiseAND(F.lit((1 << PART) - 1)))).first()
            n = max(1, -(-n // shard))
            if k:  # neighbouring shards become one
                step = F.lit(max(1, -(-shards // n)))
                todo = todo.withColumn(f"{p}shard", at - at % step if runs else F.shiftleft(F.floor(F.shiftright(at, PART) / step).cast("long") * step, PART))
        schema = T.StructType([*out_schema.fields, T.StructField(f"{p}row", T.LongType()), T.StructField(f"{p}shard", T.LongType()), T.StructField(f"{p}full", T.BooleanType())])
        packed = todo.groupBy(f"{p}shard").applyInPandas(_packer(length, k, p, bool(order)), schema)
        if k == rounds - 1 or n == 1:
            done.append(packed)
            break
        packed = stored(packed, "packed")
        done.append(packed.filter(f"{p}full"))
        todo = packed.filter(f"not {p}full").select(*kept, f"{p}row", f"{p}shard")
    final = [*kept, F.col("sequence_id"), F.col("offset")]
    out = done[0].select(*final)
    for more in done[1:]:
        out = out.unionByName(more.select(*final))
    return out


def _packer(length: int, k: int, p: str, ordered: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs a shard in round ``k``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", f"{p}row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        where, offset, fill = sum_of_squares(pdf["length"].to_numpy(), length, open_only=True)
        out = pdf.assign(sequence_id=where, offset=offset)
        out[f"{p}full"] = fill[where] == length
        shard = int(pdf[f"{p}shard"].iloc[0])
        if ordered:  # sequences in the order of their first rows
            first = np.full(len(fill), np.iinfo(np.int64).max)
            np.minimum.at(first, where, pdf[f"{p}row"].to_numpy())
            place = np.empty(len(fill), np.int64)
            place[np.argsort(first, kind="stable")] = np.arange(len(fill))
            out["sequence_id"] = (shard << 22) + (k << 20) + place[where]
        else:
            out["sequence_id"] = (shard << 34) + (k << 60) + where
        return out

    return run


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of pieces made ``with_ids``: sequence_id, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
