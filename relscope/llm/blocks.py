"""Pairs within buckets, compared in blocks of bounded size inside tasks and never emitted as rows.

A bucket of up to `block` members, and of up to CELL_BYTES where members have a size, is one cell. A larger one is split
by hash into blocks, and every pair of its blocks is a cell, so no task holds more than two blocks whatever the bucket's
size, and every pair of members still meets in exactly one cell. What a cell gives back is one row for each member that found a partner: its links, and a root that
stands for its group within the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components, few
from .common import cut, join_groups

TOUCHED = "node long, root long, links long"
#: Bytes of a block, where members have a size.
CELL_BYTES = 16 << 20


def bucketed(members: DataFrame, key: str, node: str, block: int, rows: int, size: str | None = None) -> DataFrame:
    """members of buckets with two or more, with the number of the bucket's blocks (parts), the block of the member (own) and
    the bucket's smallest node (root). rows: how many members there are, for finding the hot buckets; size: the column with
    a member's bytes, if these differ."""
    bulk = F.sum(size) if size else F.lit(0)
    sizes = members.groupBy(key).agg(F.count("*").alias("held"), bulk.cast("long").alias("bulk"), F.min(node).alias("root")).where("held > 1")
    met = join_groups(members, sizes, key, "held", rows).where("held is not null")
    parts = F.ceil(F.greatest(F.col("held") / block, F.col("bulk") / CELL_BYTES)).cast("int")
    return met.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64(node), F.col("parts")).cast("int")).drop("held", "bulk")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of cells (key, lo, hi), each cell's rows in one task and together."""
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def cells(members: DataFrame, key: str, node: str, block: int, rows: int, size: str | None = None) -> DataFrame:
    """members of buckets with two or more, dealt to cells of every two blocks: columns lo, hi and own are added."""
    met = bucketed(members, key, node, block, rows, size)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt(met.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("parts", "root", "other"), key)


def whole_cells(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of sorted rows recut so that no cell is split, with the number of each row's cell."""
    held: list[pd.DataFrame] = []

    def numbered(pdf):
        new = (pdf[[key, "lo", "hi"]].to_numpy()[1:] != pdf[[key, "lo", "hi"]].to_numpy()[:-1]).any(1)
        return np.append(0, np.cumsum(new)).astype(np.int64)

    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        last = pdf[[key, "lo", "hi"]].iloc[-1].tolist()
        if held[0][[key, "lo", "hi"]].iloc[0].tolist() == last:
            continue
        rows = pd.concat(held, ignore_index=True)
        cell = numbered(rows)
        at = int(np.searchsorted(cell, cell[-1]))
        yield rows.iloc[:at], cell[:at]
        held = [rows.iloc[at:]]
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield rows, numbered(rows)


def pairs(cell: np.ndarray, own: np.ndarray, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one cell, a distance at a time; where a cell joins two blocks, pairs across them only."""
    i, step = np.arange(len(cell)), 1
    while True:
        i = i[i + step < len(cell)]
        i = i[cell[i] == cell[i + step]]
        if not len(i):
            return
        use = i[same[i] | (own[i] != own[i + step])]
        yield use, use + step
        step += 1


def touched(ids: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """One row for each end of the links (a, b): the weights of its partners, and a root common to what is linked."""
    links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    met = np.flatnonzero(links)
    return pd.DataFrame({"node": ids[met], "root": ids[root[met]], "links": links[met].astype(np.int64)})


def linked(found: DataFrame) -> DataFrame:
    """(node, links, component) of the nodes of touched rows."""
    found = cut(found.groupBy("node", "root").agg(F.sum("links").alias("links")))
    rows = found.count()
    found = few(found, rows)
    sums = found.groupBy("node").agg(F.sum("links").alias("links")).transform(few, rows)
    groups = components(found.select("node", "root"))
    return sums.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")).transform(few, rows)


def settled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes (node, id, ...) with links, and least: the smallest id of the nodes connected with it by touched rows."""
    groups = cut(linked(found).join(nodes.select("node", "id"), "node"))
    rows = groups.count()
    groups = few(groups, rows)
    least = groups.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("held")).transform(few, rows)
    met = join_groups(groups.drop("id"), least, "component", "held", rows).select("node", "links", "least").transform(few, rows)
    return nodes.join(met, "node", "left").withColumns({"links": F.coalesce("links", F.lit(0)), "least": F.coalesce("least", "id")})


def numbered(rows: DataFrame) -> DataFrame:
    """rows with a number `node` of their own, stored at once so that a number never changes."""
    return cut(rows.withColumn("node", F.monotonically_increasing_id()))
