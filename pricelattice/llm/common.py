"""Shared folders, staged tables, shipping of this package, and batch helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import folder

_OWN: list[tuple[SparkSession, str]] = []


class Work:
    """Tables that one operator writes and reads again, under a name of their own in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        _OWN.append((spark, self.path))
        self.n = 0

    def close(self) -> None:
        """Deletes the tables, once nothing that is still to run reads them; what is not closed goes when the process ends."""
        _delete(self.spark, self.path)
        _OWN.remove((self.spark, self.path))

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """df written as Parquet and read again: lineage is cut, lost executors cost no more than a task."""
        self.n += 1
        path = f"{self.path}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _OWN:
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session's context."""
    sc = spark.sparkContext
    if getattr(sc, "_pricelattice_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="pricelattice-"), "pricelattice_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("pricelattice", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._pricelattice_shipped = True


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20):
    """Parts of the batch with about limit bytes of text each; one longer text stands alone."""
    _, off = text_buffer(batch.column(text))
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def giving_back(run):
    """run over a task's batches; then the worker's Arrow pool gives back what it holds unused, for a worker outlives its
    task, and what later stages do in it has to fit beside that."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return own


def hot_join(left: DataFrame, right: DataFrame, key: str, total: int, parts: int = 1000) -> DataFrame:
    """left joined with right, which has one row a key and, in n, how many of left's `total` rows have that key.

    Keys of more than total / parts rows, fewer than `parts` by that, are broadcast: their rows stay where they are, and
    no other key is more than that share of the join's shuffle. n does not come out.
    """
    hot = F.col("n") * parts > total
    often, rare = right.where(hot).drop("n"), right.where(~hot).drop("n")
    stays = left.join(F.broadcast(often.select(key)), key, "left_anti")
    return left.join(F.broadcast(often), key).unionByName(stays.join(rare, key))
