"""The folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where none is named a local folder is set, if driver
    and executors are one machine's process; elsewhere that is an error, as no
    executor would see another's files."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomwell-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: The folders of each open ``scratch_space`` of a thread, innermost last.
_spaces = threading.local()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if open_spaces := getattr(_spaces, "open", None):
        open_spaces[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """What this thread writes by ``scratch`` and ``stored`` inside goes at the end, so
    what is read from it has to be written elsewhere by then."""
    _spaces.open = [*getattr(_spaces, "open", []), []]
    try:
        yield
    finally:
        *_spaces.open, mine = _spaces.open
        for path in mine:
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and a lost executor costs nothing that was written."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
