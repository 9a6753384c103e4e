"""Helpers shared by the training-data operators: table access, checkpoints and batch bounds."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import HOT_GROUPS, join_groups  # noqa: F401
from ..operators.loops import cut, scratch, shared_dir  # noqa: F401

#: Bounds of an Arrow batch handed to a Python worker, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session. The bounds are read when a plan runs, so all operators use the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run):
    """A function on batches whose worker, which Spark keeps for later tasks, gives free memory back to the system at the
    end of a partition."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # not in every C library
        if trim:
            trim(0)

    return wrapped


def slices(frame, rows: int):
    """Parts of a batch, for work whose arrays are many times the batch."""
    for at in range(0, len(frame), rows):
        yield frame.iloc[at : at + rows]


def text_or_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def packed(df: DataFrame, **keys) -> DataFrame:
    """Wrap all columns of df in one struct `row` beside the given key columns.

    Extra columns of the caller can then have any name without clashing with an operator's own.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def sieved(rows: DataFrame, marks: DataFrame, *keys: str, buckets: int = 1 << 20) -> DataFrame:
    """rows with `hit`, true where marks may have a row of the same keys and null where it has none, by a broadcast of the
    hash buckets of the marks, at most `buckets` longs. Rows without a hit need not be shuffled to meet the marks."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    sieve = marks.select(bucket).distinct().withColumn("hit", F.lit(True))
    return rows.withColumn("bucket", bucket).join(F.broadcast(sieve), "bucket", "left").drop("bucket")
