"""Loops on DataFrames: frontier search with a visited set, lineage cut by reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the context's checkpoint folder. Where neither is set, a temporary
    folder in local mode, in which all tasks share this machine; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="relscope-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for shuffles that are not to be merged by their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read again. Unlike a checkpoint the table hands on nothing of what the
    optimizer had estimated and inferred; in a loop that joins its rounds with each other these would square with every
    round, and planning would take longer than the work."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def search_frontier(start: DataFrame, hop: Callable[[DataFrame, int], DataFrame], key: list[str], depth: int | None = None) -> DataFrame:
    """All rows reached from start by hop(frontier, depth), each key once, at its first depth."""
    seen = frontier = cut(start.dropDuplicates(key))
    n = 0
    while depth is None or n < depth:
        n += 1
        frontier = cut(hop(frontier, n).join(seen.select(*key), key, "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
