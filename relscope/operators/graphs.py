"""Graph steps in rounds that follow the logarithm of a path: connected components by stars, and chains by pointer jumping.

Nodes are values of any type that has an order. Every round is stored, so lineage does not grow and a lost executor costs a
round. Joins are on keys that are unique on one side; hot ones are met through join_groups, or are never asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loops import cut, cut_round

#: A group that holds this fraction of all rows or more is hot; there can be no more hot groups than this number.
HOT_GROUPS = 10_000
#: Narrow rows that one task takes without effort.
TASK_ROWS = 200_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, nulls: bool = False) -> DataFrame:
    """rows left-joined with groups (one row for each `key`, `size` rows each) so that no task gets a hot group.

    Groups of 1/HOT_GROUPS of all `total` rows or more, of which there are HOT_GROUPS at most, are broadcast; rows of
    others meet their group in a shuffle. The rule is a share at every size, so the hot part of the rows does not
    change its nature as a table grows. With nulls, rows without a key, which belong to no group, are not shuffled.
    Both sides must name the key alike, and share no other name.
    """
    hot = F.col(size) * HOT_GROUPS >= total
    others = [c for c in groups.columns if c != key]
    once = rows.join(F.broadcast(groups.where(hot)), key, "left")
    known = F.col(size).isNotNull()
    met, rest = once.where(known | F.col(key).isNull() if nulls else known), once.where(~known & F.col(key).isNotNull() if nulls else ~known)
    return met.unionByName(rest.drop(*others).join(groups.where(~hot), key, "left").select(met.columns))


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as `rows` narrow rows are worth, and no more than it has: a round over few edges is then
    no shuffle of many empty partitions, and beyond that the number of tasks follows the edges."""
    return df.coalesce(-(-rows // TASK_ROWS) or 1)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node each node of the edges (node, root) is connected with.

    Large-star and small-star rounds (Kiveris et al., 2014) on checkpointed edges, whose number never grows, until they
    are stars. A star's hot centre is met through a broadcast of the few hot nodes. Rounds grow with the logarithm of the
    longest path; edges that are no stars after `most` of them are an error and never a result. Nodes whose edges all lead
    to themselves have no row.
    """
    flat = cut(edges.where("node <> root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).distinct())
    size, seen = flat.count(), None
    for _ in range(most):
        flat = few(flat, size)
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v"))).transform(few, size)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("held")).transform(few, size)
        large = join_groups(both, low, "u", "held", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.transform(few, size).distinct().transform(few, size)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held")).transform(few, size)
        met = join_groups(large, low, "u", "held", size).transform(few, size)
        pairs = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))
        flat = cut(met.select(F.explode(pairs).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct().transform(few, size))
        state = flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        size = state[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    stars = few(flat, size).groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).transform(few, size)


def chains(edges: DataFrame, base: DataFrame) -> DataFrame:
    """The nodes of edges (src, dst, w) with one edge in and one edge out: (node, first, head, dist, base, next, step, ring).

    head is the node before the chain of such nodes that a node lies in, dist the length of the way from it, first the
    chain's first node (a ring's smallest); next and step are the node's own edge out. base (node, base) are lengths that nodes have anyway;
    that of a chain's node becomes the longest of those of the nodes before it and the ways from them. Pointers double in
    length in each round, so a chain takes rounds by its logarithm; what still has a chain before it when they are longer
    than all chains together is a ring.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.first("src").alias("ptr"), F.first("w").alias("dist"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.first("dst").alias("next"), F.first("w").alias("step"))
    links = into.where("n_in = 1").join(out.where("n_out = 1"), "node").join(base, "node", "left").drop("n_in", "n_out")
    links = cut_round(links)
    size = links.count()
    # a node's chain goes on before it if a node of a chain leads to it, of which there is one at most
    before = links.select(F.col("next").alias("node"), F.lit(True).alias("live"))
    state = links.join(before, "node", "left").select("node", F.col("node").alias("first"), "ptr", "dist", "base", F.col("node").alias("low"), F.coalesce("live", F.lit(False)).alias("live"), "next", "step")
    state = few(cut_round(state), size)
    for _ in range(max(1, size).bit_length()):
        open_ = state.where("live")
        if open_.isEmpty():
            break
        at = state.select(F.col("node").alias("ptr"), F.col("first").alias("f"), F.col("ptr").alias("p"), F.col("dist").alias("d"), F.col("base").alias("b"), F.col("low").alias("lo"), F.col("live").alias("l"))
        moved = open_.join(at, "ptr").select(
            "node", F.col("f").alias("first"), F.col("p").alias("ptr"), (F.col("dist") + F.col("d")).alias("dist"), F.greatest("base", F.col("b") + F.col("dist")).alias("base"), F.least("low", "lo").alias("low"), F.col("l").alias("live"), "next", "step"
        )
        state = few(cut_round(state.where("not live").unionByName(moved)), size)
    return state.select("node", F.when(F.col("live"), F.col("low")).otherwise(F.col("first")).alias("first"), F.col("ptr").alias("head"), "dist", "base", "next", "step", F.col("live").alias("ring"))


def shortened(edges: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with one in place of each chain that is no ring, and (node, base) of what leads on from the chains."""
    gone = chain.where("not ring").select("node")
    left = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    last = chain.where("not ring").join(gone.withColumnRenamed("node", "next"), "next", "left_anti")
    new = last.select(F.col("head").alias("src"), F.col("next").alias("dst"), (F.col("dist") + F.col("step")).alias("w"))
    over = last.select(F.col("next").alias("node"), (F.col("base") + F.col("step")).alias("base")).where("base is not null")
    return left.select("src", "dst", "w").unionByName(new).groupBy("src", "dst").agg(F.max("w").alias("w")), over
