"""Shared pieces of the corpus operators: shared-folder tables and array rows.

Array rows: tasks that produce millions of small facts (hash, document, position)
pack them into one Spark row per destination bucket with list columns.  Spark still
partitions and shuffles the buckets; numpy works on whole lists inside a task.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .words import text_buffers

BUCKET_BYTES = 128 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a Python worker gets at a time; a larger row comes alone.
BATCH_BYTES = 8 << 20


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = "file://" + tempfile.mkdtemp(prefix="studylens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, *partition_by: str, batch_rows: int = 2000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write are removed when it ends; the table replaces them.
    Python workers of the write get at most ``batch_rows`` rows and BATCH_BYTES at a
    time.  Session settings are as before afterwards.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true", _BATCH: str(batch_rows), _BYTES: str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # type: ignore[attr-defined]
    return out


def discard(*frames: DataFrame, part: str = "") -> None:
    """Delete materialized tables, or one partition (``column=value``), that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}".rstrip("/"))
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def input_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the optimizer estimates it: the files' size where it is a scan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bucket_count(df: DataFrame, per_partition: int = 2) -> int:
    """Buckets of array rows about ``df``.

    A multiple of the shuffle partitions that the cluster is set to, and at least one
    for each BUCKET_BYTES of input, so a bucket does not grow where nothing was set.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, per_partition * partitions, min(input_bytes(df) // BUCKET_BYTES, 1 << 20))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def crc_mods(ids, modulus: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids], dtype=np.int64)


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray], lead: dict[str, object] | None = None) -> pa.RecordBatch | None:
    """One row per bucket that occurs, with a list column for each array."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    offsets = pa.array(np.append(first, len(bucket)).astype(np.int32))
    arrays = {"bucket": pa.array(keys.astype(np.int32))}
    for name, value in (lead or {}).items():
        arrays[name] = pa.array([value] * len(keys))
    for name, values in columns.items():
        arrays[name] = pa.ListArray.from_arrays(offsets, pa.array(values[order]))
    return pa.RecordBatch.from_pydict(arrays)


def flat(table, name: str) -> np.ndarray:
    """All elements of a list column, one after the other."""
    column = table.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    return column.flatten().to_numpy(zero_copy_only=False)


def lengths(table, name: str) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(table.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads; other columns never clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_buffers(column)
    view = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(view[a:b])
