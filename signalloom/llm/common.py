"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

import signalloom
from signalloom.session import materialize, release

__all__ = ["append_columns", "dense_ranks", "keep", "materialize", "pack", "read", "release", "shed", "shedding", "ship", "slices", "unpack", "without"]

PIECE_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = os.path.dirname(os.path.abspath(signalloom.__file__))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as out:
            for base, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(base, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        # Only the driver reads this file; Spark sends it to the executors.
        archive = os.path.join(tempfile.mkdtemp(prefix="signalloom-"), f"signalloom-llm-{application}.zip")
        with open(archive, "wb") as file:
            file.write(packed.getvalue())
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns whose names an operator is about to use."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of a few MB, since Python objects take several times the room of Arrow data."""
    for whole in batches:
        rows = max(1, whole.num_rows * PIECE_BYTES // max(whole.nbytes, 1))
        yield from (whole.slice(k, rows) for k in range(0, whole.num_rows, rows))


def shed() -> None:
    """Give back what earlier work left in this worker's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shedding(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a task, after which the worker, idle while Spark joins and sorts, holds no more memory than before."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        shed()

    return wrapped


def append_columns(
    df: DataFrame, fields: Sequence[StructField], function: Callable[[pa.RecordBatch], list[pa.Array]]
) -> DataFrame:
    """Add columns that ``function`` computes for each Arrow batch; columns of the same name are replaced."""
    kept = [f for f in df.schema.fields if f.name.lower() not in {x.name.lower() for x in fields}]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Small pieces, since Python objects take several times the room of the Arrow data.
            rows = max(1, whole.num_rows * PIECE_BYTES // max(whole.nbytes, 1))
            for batch in (whole.slice(k, rows) for k in range(0, whole.num_rows, rows)):
                added = function(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(n)) for n in names] + added,
                    names + [f.name for f in fields],
                )

    return df.mapInArrow(run, StructType([*kept, *fields]))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, read it back, and let Spark delete the shuffle files that led to it."""
    stored = materialize(df, name)
    del df
    # The first collection releases the finished query, the second one what it referred to.
    for _ in range(2):
        gc.collect()
        stored.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return stored


def pack(*arrays: np.ndarray) -> bytes:
    """A few arrays as one compressed value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a.dtype.str), a.nbytes))], np.int64).tobytes()
    body = b"".join(a.dtype.str.encode() for a in arrays) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.compress(head + body, 1)


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, 2 * n, 8).tolist()
    at = 8 * (2 * n + 1)
    kinds = []
    for k in sizes[::2]:
        kinds.append(data[at : at + k].decode())
        at += k
    out = []
    for kind, size in zip(kinds, sizes[1::2]):
        out.append(np.frombuffer(data, np.dtype(kind), size // np.dtype(kind).itemsize, at))
        at += size
    return out


def dense_ranks(df: DataFrame, group: str, position: Column, order: Sequence[Column], out: str, buckets: int) -> DataFrame:
    """Gap-free ranks from 0 inside ``group`` by (position, order), without one task per group.

    ``position`` is a whole number in [0, 2**48). Its high bits cut each group into ``buckets`` pieces; pieces are
    counted with partial sums, numbered in parallel and shifted by the pieces before them.
    """
    width = (1 << 48) // buckets
    cut = df.withColumn("_at", position).withColumn("_bucket", F.floor(F.col("_at") / F.lit(width)))
    sizes = cut.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy(group, "_bucket").orderBy("_at", *order)
    local = cut.withColumn("_local", F.row_number().over(inside) - 1)
    return (
        local.join(shifts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(out, F.col("_local") + F.col("_shift"))
        .drop("_at", "_bucket", "_local", "_shift", "_g", "_b")
    )
