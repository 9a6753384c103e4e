"""Operators on edge lists (src, dst, type) and on intervals, for edges between rows as well as between columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graphs import chains, components, shortened
from .loops import cut_round as cut
from .loops import search_frontier, shuffle_partitions
from .profile import union


def degree(edges: DataFrame, types: list[str]) -> DataFrame:
    """(node, in_degree, out_degree, in_<type>...): edges without repeats counted at both ends."""
    both = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), "type").unionByName(edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), "type"))
    by_type = [F.count_if((F.col("i") == 1) & (F.col("type") == t)).alias(f"in_{t}") for t in types]
    return both.groupBy("node").agg(F.count_if(F.col("i") == 1).alias("in_degree"), F.count_if(F.col("i") == 0).alias("out_degree"), *by_type)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, direction: str = "out") -> DataFrame:
    """(node, depth): nodes within `depth` hops of the starts (node), each at its shortest distance."""
    steps = {"out": edges.select("src", "dst"), "in": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": _both(edges)}[direction]
    steps = cut(steps.distinct())

    def hop(frontier, n):
        return frontier.select(F.col("node").alias("src")).join(steps, "src").select(F.col("dst").alias("node"), F.lit(n).alias("depth")).distinct()

    return search_frontier(starts.select("node", F.lit(0).alias("depth")), hop, ["node"], depth)


def component(edges: DataFrame, start: str) -> DataFrame:
    """(src, dst, type): the edges of the undirected component of a node, in rounds by the logarithm of its paths.

    Nodes with one edge lead nowhere, so rounds are over the edges between other nodes alone, of which row tables have far
    fewer; an edge is in the component if one of its ends is found there. Nodes with an edge to themselves or to nothing
    stay in, as such an edge has no other end.
    """
    kind = edges.schema["src"].dataType
    pairs = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    odd = edges.where("src = dst or dst is null").select(F.col("src").alias("node")).distinct()
    ends = union([pairs.select(F.col("u").alias("node")), pairs.select(F.col("v").alias("node")), odd, odd])
    inner = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("node") == start)).select("node")
    between = pairs.join(inner.withColumnRenamed("node", "u"), "u", "left_semi").join(inner.withColumnRenamed("node", "v"), "v", "left_semi")
    found = cut(components(between.select(F.col("u").alias("node"), F.col("v").alias("root"))))
    own = found.where(F.col("node") == start).select("component")
    alone = edges.sparkSession.createDataFrame([(start,)], "node string").select(F.col("node").cast(kind).alias("node"))
    nodes = found.join(F.broadcast(own), "component").select("node").unionByName(alone).distinct()  # own is one row
    by_src, by_dst = nodes.withColumnRenamed("node", "src"), nodes.withColumnRenamed("node", "dst")
    behind = edges.where("src is not null").join(by_dst, "dst", "left_semi").join(by_src, "src", "left_anti")
    return edges.join(by_src, "src", "left_semi").unionByName(behind.select(edges.columns))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def _without(edges: DataFrame, nodes: DataFrame, *sides: str) -> DataFrame:
    for side in sides:
        edges = edges.join(nodes.select(F.col("node").alias(side)), side, "left_anti")
    return edges


def _longest(base: DataFrame) -> DataFrame:
    return base.groupBy("node").agg(F.max("base").alias("base"))


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a root; what lies on or behind a cycle gets one level more than the highest. Self
    loops are ignored.

    A round shortens every chain to one edge of its length, and then takes away what has no edges in, whose level is known,
    and what has no edges out, whose level follows from the nodes before it at the end. So a path or a tree takes rounds by
    the logarithm of its size; only where edges part and meet again all along do rounds follow the depth. What is taken
    away gets its level in the reverse order of the rounds.
    """
    nodes = _ends(edges)
    left = cut(edges.where("src <> dst").select("src", "dst").distinct().withColumn("w", F.lit(1).cast("long")))
    base = nodes.select("node", F.lit(None).cast("long").alias("base")).limit(0)
    known = [nodes.join(_ends(left), "node", "left_anti").select("node", F.lit(0).cast("long").alias("level"))]
    later: list[tuple[str, DataFrame]] = []
    size = left.count()
    while size:
        chain = chains(left, base)
        later.append(("chain", chain.where("not ring").select("node", "head", "dist", "base")))
        left, over = shortened(left, chain)
        left, base = cut(left), cut(_longest(base.unionByName(over)))
        sources, targets = left.select(F.col("src").alias("node")).distinct(), left.select(F.col("dst").alias("node")).distinct()
        roots = cut(sources.join(targets, "node", "left_anti").join(base, "node", "left").select("node", F.coalesce("base", F.lit(0)).alias("level")))
        leaves = cut(targets.join(sources, "node", "left_anti"))
        known.append(roots)
        into = left.join(leaves.select(F.col("node").alias("dst")), "dst").join(base.withColumnRenamed("node", "dst"), "dst", "left")
        later.append(("leaf", cut(into.select(F.col("dst").alias("node"), F.col("src").alias("head"), F.col("w").alias("dist"), "base"))))
        passed = left.join(roots.select(F.col("node").alias("src"), "level"), "src").select(F.col("dst").alias("node"), (F.col("level") + F.col("w")).alias("base"))
        base = cut(_longest(base.unionByName(passed)))
        middle = _ends(left).join(roots, "node", "left_anti").join(leaves, "node", "left_anti")
        left = cut(_without(_without(left, roots, "src"), leaves, "dst"))
        # what has lost all its edges had none in but from roots
        known.append(cut(middle.join(_ends(left), "node", "left_anti").join(base, "node").select("node", F.col("base").alias("level"))))
        now = left.count()
        if now == size:
            break
        size = now
    known.append(_ends(left).select("node", F.lit(None).cast("long").alias("level")))  # on or behind a cycle
    level = cut(union(known))
    for kind, rows in reversed(later):
        if rows.isEmpty():
            continue
        met = rows.join(level.select(F.col("node").alias("head"), "level"), "head")
        reached = F.when(F.col("level").isNotNull(), F.greatest("base", F.col("level") + F.col("dist")))
        if kind == "leaf":
            met = met.groupBy("node").agg(F.when(F.count(reached) == F.count("*"), F.max(reached)).alias("level"))
        else:
            met = met.select("node", reached.alias("level"))
        level = cut(level.unionByName(met))
    top = level.agg((F.coalesce(F.max("level"), F.lit(-1)) + 1).alias("top"))
    return level.join(F.broadcast(top)).select("node", F.coalesce("level", "top").cast("int").alias("level"))  # top is one row


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node): nodes on a cycle of two or more.

    Rounds as of levels() take away what has no edges in or no edges out, and shorten every chain to one edge; so rings,
    paths and trees take rounds by the logarithm of their size. In what is left, strongly connected parts are found by
    passing the largest name forward and coming back from the nodes that keep their own. A chain is on a cycle if the edge
    in its place is: if both its ends are in one part.
    """
    left = cut(edges.where("src <> dst").select("src", "dst").distinct().withColumn("w", F.lit(1).cast("long")))
    none = _ends(left).select("node", F.lit(None).cast("long").alias("base")).limit(0)
    rings, rounds, size = [], [], left.count()
    while size:
        chain = chains(left, none)
        rings.append(chain.where("ring").select("node", F.col("first").alias("part")))
        tails = chain.where("not ring").join(chain.select(F.col("node").alias("next")), "next", "left_anti").select("first", F.col("next").alias("tail"))
        held = cut(chain.where("not ring").join(tails, "first").select("node", "head", "tail"))
        left, _ = shortened(left, chain)
        left = cut(_without(left, chain.where("ring").select("node"), "src"))
        loops = cut(left.where("src = dst").select(F.col("src").alias("node")))
        rounds.append((held, loops))
        left = left.where("src <> dst")
        sources, targets = left.select(F.col("src").alias("dst")).distinct(), left.select(F.col("dst").alias("src")).distinct()
        left = cut(left.join(sources, "dst", "left_semi").join(targets, "src", "left_semi"))
        now = left.count()
        if now == size:
            break
        size = now
    part = cut(union([_strong_parts(left.select("src", "dst")), *rings]))
    for held, loops in reversed(rounds):
        part = cut(part.unionByName(loops.join(part, "node", "left_anti").select("node", F.col("node").alias("part"))))
        ends = [part.select(F.col("node").alias(e), F.col("part").alias(f"{e}_part")) for e in ("head", "tail")]
        same = held.join(ends[0], "head").join(ends[1], "tail").where("head_part = tail_part").select("node", F.col("head_part").alias("part"))
        part = cut(part.unionByName(same))
    return part.select("node").distinct()


def _strong_parts(left: DataFrame) -> DataFrame:
    """(node, part): the strongly connected parts of two nodes or more."""
    found = left.select(F.col("src").alias("node"), F.col("src").alias("part")).limit(0)
    while not left.isEmpty():
        color = cut(_ends(left).withColumn("color", F.col("node")))
        while True:
            passed = left.join(color.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("got"))
            new = cut(color.join(passed, "node", "left").select("node", F.greatest("color", "got").alias("color"), (F.coalesce("got", "color") > F.col("color")).alias("up")))
            color = new.select("node", "color")
            if new.where("up").isEmpty():
                break
        same = color.select(F.col("node").alias("src"), F.col("color").alias("a")).join(left, "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst")
        back = reach(cut(same), color.where("node = color").select("node"), direction="in")
        own = cut(color.join(back.select("node"), "node", "left_semi"))
        big = own.groupBy("color").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.unionByName(own.join(big, "color", "left_semi").select("node", F.col("color").alias("part")))
        left = cut(_without(left, own, "src", "dst"))
        size = left.count()
        while size:  # what has no edges in or out is on no cycle
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if size == (size := left.count()):
                break
    return found


#: Targets that one caller may hold in one row.
MOST_TARGETS = 4096
#: Targets, those of several fields of a caller too, that a task is to bring to its callers.
TASK_TARGETS = 1 << 23


def _halves(kind: T.DataType) -> tuple[Column, Column, Column]:
    """Of targets: what those that may share an array have in common, the four bytes that tell them apart, and the target
    again of columns `common` and `own`. Only longs are worth it; others share all and are kept as they are."""
    if not isinstance(kind, T.LongType):
        return F.lit(0), F.col("target"), F.col("own")
    return F.shiftright("target", 31), F.col("target").bitwiseAND(2**31 - 1).cast("int"), F.shiftleft("common", 31).bitwiseOR(F.col("own").cast("long"))


def _ranged(met: DataFrame, calls: DataFrame, parts: int) -> tuple[DataFrame, list[str]]:
    """met with the range of callers that each row is of, of `parts` that hold about as many calls each, and what to group it
    by. Callers close to each other often have fields in common, and equal arrays that follow each other in a block of the
    shuffle are stored about once. Only whole numbers have ranges here; others are dealt out by themselves."""
    try:
        from pyspark.ml.feature import Bucketizer
    except ImportError:  # it needs numpy, as nothing else here does
        return met, ["caller"]
    if not isinstance(calls.schema["caller"].dataType, T.IntegralType):
        return met, ["caller"]
    cuts = calls.agg(F.percentile_approx(F.col("caller").cast("double"), [i / parts for i in range(1, parts)], max(10000, 10 * parts))).first()[0]
    splits = [-math.inf, *sorted(set(cuts or [])), math.inf]
    if len(splits) < 3:
        return met, ["caller"]
    of = Bucketizer(splits=splits, inputCol="at", outputCol="callers")
    return of.transform(met.withColumn("at", F.col("caller").cast("double"))).drop("at"), ["callers", "caller"]


def resolve(calls: DataFrame, assigned: DataFrame, known: DataFrame, most: int = MOST_TARGETS, task: int = TASK_TARGETS) -> DataFrame:
    """(caller, target): calls through a field resolved to what is assigned to it, once each, for known targets only.

    A caller's fields bring arrays of targets to it, a row a call, and its distinct targets become rows where they are met:
    so the shuffle holds a row for each call, and none for each pair. A task brings at most about `task` targets to its
    callers, which it sorts in memory: where the session's partitions are too few for that, there are more of them, by
    ranges of callers. Callers whose fields have more than `most` targets in all, and null ones, go by pairs instead, so no
    row grows with a caller or a field; they are looked for only where the most calls of a caller times the most targets of
    a field are more than `most`. Both ways give the same pairs.
    """
    calls, pairs = calls.select("caller", "field"), cut(assigned.select("field", "target").distinct().join(known, "target", "left_semi"))
    sizes = pairs.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    widest = sizes.agg(F.max("n")).first()[0] or 0
    by_caller = calls.groupBy("caller").agg(F.count(F.lit(1)).alias("n"))
    made = by_caller.agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.count_if(F.col("caller").isNull()).alias("none")).first()
    light, some, brought = calls, False, (made["all"] or 0) * widest
    if made["none"] or (made["most"] or 0) * widest > most:
        sums = cut(calls.join(sizes, "field").groupBy("caller").agg(F.sum("n").alias("n")))
        heavy = cut(sums.where((F.col("n") > most) | F.col("caller").isNull()).select("caller"))
        brought = sums.where((F.col("n") <= most) & F.col("caller").isNotNull()).agg(F.sum("n")).first()[0] or 0
        if some := not heavy.isEmpty():
            light = calls.join(heavy, "caller", "left_anti").where("caller is not null")
    few = pairs.join(sizes.where(F.col("n") > most), "field", "left_anti") if widest > most else pairs
    common, own, target = _halves(pairs.schema["target"].dataType)
    lists = few.repartition("field").groupBy("field", common.alias("common")).agg(F.sort_array(F.collect_list(own)).alias("own"))
    met, near, parts = light.join(lists, "field").drop("field"), ["caller"], shuffle_partitions(calls.sparkSession)
    if brought > parts * task:
        parts = -(-brought // task)
        met, near = _ranged(met, light, parts)
    out = met.repartition(parts, near[0]).groupBy(*near, "common").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
    out = out.select("caller", "common", F.explode("own").alias("own")).select("caller", target.alias("target"))
    if some:
        rest = calls.join(heavy.withColumnRenamed("caller", "c"), F.col("caller").eqNullSafe(F.col("c")), "left_semi").distinct()
        out = out.unionByName(rest.join(pairs, "field").select("caller", "target").distinct())
    return out


def entity_filter(entities: DataFrame, kinds=None, files=None, hidden: DataFrame | None = None, libraries=()) -> DataFrame:
    """Entities (id, kind, file) of the kinds and files wanted, without hidden ids and library files."""
    out = entities
    if kinds is not None:
        out = out.where(F.col("kind").isin(*kinds))
    if files is not None:
        out = out.where(F.col("file").isin(*files))
    if libraries:
        out = out.where(~F.col("file").isin(*libraries))
    return out if hidden is None else out.join(hidden.select("id"), "id", "left_anti")


def sliced(intervals: DataFrame, parts: int | None = None) -> DataFrame:
    """intervals (owner, start, size) with the range (slice) of the order by owner, start and size that each lies in, stored.
    An owner with many intervals, and one with many equal ones, is spread over many ranges of about the same size. There
    are `parts` of them, else as many as a shuffle has partitions: they are not merged by their bytes, of which sorted
    narrow rows have few for the memory that they take."""
    order = ["owner", "start", "size", "salt"]
    salted = intervals.select("owner", "start", "size").withColumn("salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(parts or shuffle_partitions(intervals.sparkSession), *order)
    return cut(ranged.drop("salt").withColumn("slice", F.spark_partition_id()))


def interval_gaps(intervals: DataFrame, total: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(owner, gap_start, gap_size): room before each interval (owner, start, size) that none before it covers, and up
    to the owner's total (owner, total) behind the last one.

    The running maximum of the ends is taken within each range of the whole order; an owner that lies in several ranges
    carries the maximum of its ranges before into the next. At most two owners of a range do, so what is carried is sent to
    all tasks, and no owner is one task's work.
    """
    rows = sliced(intervals, parts).repartition(parts or shuffle_partitions(intervals.sparkSession), "owner", "slice")
    end = F.col("start") + F.col("size")
    tops = rows.groupBy("owner", "slice").agg(F.max(end).alias("top"))
    by_owner = Window.partitionBy("owner")
    before = F.max("top").over(by_owner.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = tops.withColumn("n", F.count(F.lit(1)).over(by_owner)).withColumn("carried", before).where("n > 1").select("owner", "slice", "carried")
    inside = F.max(end).over(Window.partitionBy("owner", "slice").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    met = rows.withColumn("inside", inside).join(F.broadcast(carried), ["owner", "slice"], "left")
    reached = F.coalesce(F.greatest("inside", "carried"), F.lit(0))
    inner = met.select("owner", reached.alias("gap_start"), (F.col("start") - reached).alias("gap_size"))
    if total is not None:
        ends = tops.groupBy("owner").agg(F.max("top").alias("gap_start")).join(total, "owner")
        inner = inner.unionByName(ends.select("owner", "gap_start", (F.col("total") - F.col("gap_start")).alias("gap_size")))
    return inner.where("gap_size > 0")
