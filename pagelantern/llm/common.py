"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints, that of spark.checkpoint.dir.

    Where a session names none, one is made if driver and executors are one process, as in tests; on a cluster that is
    an error, as executors would not share it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of intermediate results, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the session's shared checkpoint folder, without their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(rows: int, each: int, least: int = 64) -> int:
    """Into how many buckets to deal `rows` so that each gets about `each` of them."""
    return max(least, -(-rows // each))


def bucket(n: int, *cols) -> "F.Column":
    """A bucket from 0 to n - 1 by the hash of cols."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def unhex_long(col) -> "F.Column":
    """16 lowercase hex digits of a signed long's 64 bits."""
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def release() -> None:
    """Gives memory that is free in this worker back to the machine: workers are kept for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def added(docs: DataFrame, col: str, of, fields: dict, each: int = 2 << 20, done=None) -> DataFrame:
    """docs with new columns computed from one column, batch by batch; the other columns pass through untouched.

    of: from a list of the column's values to the new columns' values, a list or Arrow array for each of fields (name:
    Spark type). A column of docs named like a new one is replaced. It is called for slices of about `each` bytes,
    so memory follows the longest value and not the batch. done, if given, is called when a task's rows are through:
    workers are used again for other stages, and should not keep large caches.
    """
    rest = [c for c in docs.columns if c not in fields]
    schema = StructType([*(docs.schema[c] for c in rest), *(StructField(n, t) for n, t in fields.items())])

    def run(batches):
        kinds = [to_arrow_type(t) for t in fields.values()]
        for b in batches:
            step = max(1, each * b.num_rows // max(1, b.column(col).nbytes))
            for part in (b.slice(k, step) for k in range(0, b.num_rows, step)):
                new = of(part.column(col).to_pylist())
                new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(new, kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *new], names=[*rest, *fields])
        if done:
            done()
        release()

    # a column that is replaced is still read under its own name
    return docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*rest, col]))).mapInArrow(run, schema)
