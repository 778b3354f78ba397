"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled together inside one Arrow batch, so that a Python worker holds the words of few texts only.
ROWS_AT_ONCE = 384
#: Bytes of such rows, but for a single longer row.
BYTES_AT_ONCE = 4 << 20
#: Entries a worker's word cache may hold before it starts over with the words in use.
CACHE_ENTRIES = 600_000
#: Stands for a null id where ids are ordered: after all others.
LAST_ID = np.iinfo(np.int64).max


class Recent:
    """A cache bounded in entries and bytes, in two generations: what the older one holds moves up when it is asked for, the
    rest is forgotten. Keys of over LONGEST characters stay until the next call only."""

    LONGEST = 64

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries, self.new, self.old, self.long = entries, {}, {}, []

    def missing(self, keys: set) -> list:
        """The keys that new doesn't hold afterwards; the caller puts them there."""
        for k in self.long:
            self.new.pop(k, None)
        if len(self.new) > self.entries:
            self.new, self.old = {}, self.new
        new, old, out = self.new, self.old, []
        for k in keys.difference(new):
            if (v := old.get(k)) is None:
                out.append(k)
            else:
                new[k] = v
        self.long = [k for k in out if len(k) > self.LONGEST]
        return out


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has one


def give_back() -> None:
    """Returns to the system what this worker's former tasks freed: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset (tests) a folder below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: For tables of packed rows of megabytes: pages and row groups are closed by size after any row, since readers hold a whole
#: row group's rows in one batch.
PACKED_ROWS = {"compression": "none", "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}


def written(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors. packed: rows are large and compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(PACKED_ROWS if packed else {"compression": "zstd"})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table made by written() that no later plan reads."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most rows rows in the jobs run inside, for tables with rows of megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of df: what its files hold for a scan, with no job run; 0 where it knows none."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 56 else 0


def parts_for(df: DataFrame, bytes_each: int = 6 << 20) -> int:
    """A number of partitions that grows with the input, at least the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, input_bytes(df) // bytes_each + 1))


def crc_rest(doc_id, modulus: int):
    """crc32 of the id as text modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batch, rows: int, size: int):
    """An Arrow batch in slices of up to rows rows and about size bytes; a row is never cut."""
    ends = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(ends), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def slices(batch, names: list[str], rows: int = ROWS_AT_ONCE, size: int = BYTES_AT_ONCE):
    """Column lists of an Arrow batch, a few rows at a time."""
    for part in pieces(batch, rows, size):
        yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]


def cat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges [start, start+length) one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.cumsum(n) - n
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)
