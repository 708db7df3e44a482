"""Token-id files: ORC with run-length encoded integers, row indexes and Bloom
filters on document ids.

Documents are range-partitioned by id, so files follow each other in id order;
each worker encodes its texts and streams them to its ORC file. Readers take
stripes in parallel, and statistics and Bloom filters on ``doc_id`` let them
skip stripes and row groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwell.llm.common import utf8_slices
from loomwell.llm.tokens import encoder, vocabulary

#: End-of-document id.
END = 2

#: ORC writer options: Bloom filter, rows of a row group, bytes of a stripe.
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}

SCHEMA = "doc_id long, seq long, n_tokens long, ids array<int>"


#: Files whose lengths are summed up by one task.
FILES = 1024


def file_number(name: Column) -> Column:
    """The range that a file holds: the number in part-00012-..., which outgrows its five digits from 100,000 files on."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Write (doc_id, seq, n_tokens, ids) files in ascending doc_id order.

    Null texts are empty and hold the end id alone; null ids come first;
    repeated ids and rows are all written, in an order settled by the text.
    ``seq`` numbers the rows of a file. Other columns are not read. An empty
    table writes an empty folder of that schema.
    """
    tokenizer = tokenizer or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seq = encoder(tokenizer), 0
        for batch in batches:
            texts = batch.column(1)
            for a, b, _, _ in utf8_slices(texts, 4 << 20):
                ids, at = encode(texts[a:b].fill_null("").to_pylist())
                n = np.diff(at) + 1
                out = np.insert(ids.astype(np.int32), at[1:], end)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.arange(seq, seq + b - a)), pa.array(n), rows], names=["doc_id", "seq", "n_tokens", "ids"])
                seq += b - a

    tie = F.xxhash64("text")
    # the row's number parts rows alike in id and text, which may be in any order, so that many of them fill many files
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("doc_id", tie, "row").sortWithinPartitions("doc_id", tie, "row").select("doc_id", "text")
    dealt.mapInArrow(run, SCHEMA).write.mode("errorifexists").options(**ORC).orc(path)


def read(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """The files' rows; bounds and single ids are pushed to the ORC reader."""
    df = spark.read.schema(SCHEMA).orc(path)
    if low is not None:
        df = df.filter(F.col("doc_id") >= low)
    if high is not None:
        df = df.filter(F.col("doc_id") <= high)
    return df if ids is None else df.filter(F.col("doc_id").isin(ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all rows before it), n_tokens, ids_crc32.

    Starts are prefix sums in three levels: over blocks of FILES files, over a
    block's files, then inside a file by ``seq``. An empty folder gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "seq", "doc_id", "n_tokens", "ids_crc32"])

    df = spark.read.schema(SCHEMA).orc(path)
    rows = df.select(F.col("_metadata.file_name").alias("file"), "seq", "doc_id", "ids").mapInArrow(run, "file string, seq long, doc_id long, n_tokens long, ids_crc32 long")
    files = df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("of_file")).withColumn("number", file_number(F.col("file"))).withColumn("block", F.floor(F.col("number") / FILES))
    blocks = files.groupBy("block").agg(F.sum("of_file").alias("of_block"))
    blocks = blocks.select("block", (F.sum("of_block").over(Window.orderBy("block")) - F.col("of_block")).alias("before_block"))  # a row for FILES files
    in_block = F.sum("of_file").over(Window.partitionBy("block").orderBy("number", "file")) - F.col("of_file")
    files = files.select("file", "block", in_block.alias("before_file")).join(blocks, "block").select("file", (F.col("before_block") + F.col("before_file")).alias("before"))
    inside = Window.partitionBy("file").orderBy("seq")
    rows = rows.withColumn("at", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(files, "file")
    return rows.select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
