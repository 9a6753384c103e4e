"""Relationships between tables: from names, from values, from metadata, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import fk_candidates, singular
from .loops import cut
from .profile import union

COLUMNS = ["source_table", "source_column", "target_table", "target_column", "type", "confidence"]


def cardinality(source_unique, target_unique):
    return F.when(source_unique & target_unique, "one-to-one").when(target_unique, "one-to-many").otherwise("many-to-many")


def _unique(side: str):
    return F.col(f"{side}.unique_count") == F.col(f"{side}.total_count")


def first_pk(keyed: DataFrame) -> DataFrame:
    """(table, column, type, ...): the first primary key column of each table that has one."""
    rank = F.row_number().over(Window.partitionBy("table").orderBy("ordinal"))
    return keyed.where("key_type = 'PK'").withColumn("rank", rank).where("rank = 1").drop("rank")


def confidence(keyed_source, target_table, target_column, source_type, target_type):
    score = (
        F.when(F.array_contains(fk_candidates(keyed_source), F.lower(target_table)), 2).otherwise(0)
        + F.when(F.lower(target_column) == "id", 1).otherwise(0)
        + F.when(source_type == target_type, 1).otherwise(0)
    )
    return F.when(score >= 3, "high").when(score >= 2, "medium").otherwise("low")


def by_name(keyed: DataFrame) -> DataFrame:
    """Foreign-key-named columns whose candidate is another table with a primary key."""
    source = keyed.where("key_type = 'FK'").withColumn("candidate", F.explode(F.array_distinct(fk_candidates(F.col("column"))))).alias("s")
    target = first_pk(keyed).alias("t")
    met = source.join(target, (F.lower("t.table") == F.col("s.candidate")) & (F.col("s.table") != F.col("t.table")))
    return met.select(
        F.col("s.table").alias("source_table"), F.col("s.column").alias("source_column"), F.col("t.table").alias("target_table"), F.col("t.column").alias("target_column"),
        cardinality(_unique("s"), _unique("t")).alias("type"),
        confidence(F.col("s.column"), F.col("t.table"), F.col("t.column"), F.col("s.type"), F.col("t.type")).alias("confidence"),
    )


#: Values that stand for a column, and standard errors by which a share measured on them must miss the share asked for
#: before a pair is given up: a pair right at it is lost with a chance of 1e-9.
SAMPLE, MISS = 1024, 6
#: Drawn values that are sent to all tasks at most.
SENT = 1 << 20
#: Columns marked in one long.
WORD = 62


def _hashes(df: DataFrame, columns: list[tuple[int, str, int | None]]) -> DataFrame:
    """(id, h): a hash of the text of every cell of columns (id, name, limit), below the column's limit if it has one."""
    cells = [F.struct(F.lit(i).alias("id"), F.lit(limit).cast("long").alias("top"), F.col(f"`{name}`").cast("string").alias("text")) for i, name, limit in columns]
    texts = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("text is not null")
    return texts.select("id", "top", F.xxhash64("text").alias("h")).where("top is null or h < top").select("id", "h")


def plausible_pairs(tables: dict[str, DataFrame], chosen: list[dict], least: float) -> list[tuple[int, int]]:
    """Index pairs (source, target) of chosen columns of which the source's values may lie in the target's by `least`.

    A pair cannot if the target has too few values, or both are numbers of ranges apart. Of each source left, the values
    whose hash is below a limit are drawn, as many as SAMPLE of the number that its profile gives (all of them where there
    are no more). These few meet a scan of the targets, which only tells which of them it meets; so the share that a
    target has of them bounds its share of the whole, and nothing is shuffled but the hits.
    """
    spark = next(iter(tables.values())).sparkSession

    def apart(a, b):
        return a["type"] == b["type"] == "INT" and (a["max_num"] < b["min_num"] or b["max_num"] < a["min_num"])

    pairs = [
        (i, j) for i, a in enumerate(chosen) for j, b in enumerate(chosen)
        if a["s"] and b["t"] and a["table"] != b["table"] and b["unique_count"] >= least * a["unique_count"] and not apart(a, b)
    ]

    def scanned(ids, limits):
        own = {n: [(i, chosen[i]["column"], limits(i)) for i in ids if chosen[i]["table"] == n] for n in sorted({chosen[i]["table"] for i in ids})}
        return union([_hashes(tables[n], columns) for n, columns in own.items()])

    def below(i):
        share = 2 * SAMPLE / chosen[i]["unique_count"]
        return None if share >= 1 else int((share - 0.5) * 2**64)  # hashes are signed

    if not pairs:
        return []
    # a bounded table: about twice SAMPLE rows for each source column
    drawn = cut(scanned(sorted({i for i, _ in pairs}), below).distinct())
    size = {r["id"]: r["n"] for r in drawn.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = F.broadcast if sum(size.values()) <= SENT else lambda df: df  # beyond some hundred columns they meet in a shuffle
    met = scanned(sorted({j for _, j in pairs}), lambda j: None).join(sent(drawn.select("h").distinct()), "h", "left_semi").distinct()
    hits = met.withColumnRenamed("id", "t").join(sent(drawn.withColumnRenamed("id", "s")), "h").groupBy("s", "t").agg(F.count(F.lit(1)).alias("n"))
    found = {(r["s"], r["t"]): r["n"] for r in hits.collect()}  # a row a pair of columns

    def may(i, j):
        n = size.get(i, 0)
        slack = MISS * (least * (1 - least) / n) ** 0.5 + 1 / n if n and below(i) is not None else 0
        return n and found.get((i, j), 0) / n >= least - slack

    return [(i, j) for i, j in pairs if may(i, j)]


def value_overlaps(tables: dict[str, DataFrame], keyed: DataFrame, sources: str, targets: str, least: float) -> DataFrame:
    """(s_table, s_column, t_table, t_column, common, source_size) for pairs of columns of different tables of which the
    source has at least the share `least` of its values, as text, in the target.

    Columns are chosen from the profile before anything is scanned, and pairs by plausible_pairs(). Only columns of pairs
    that are left are counted: two hashes of a cell's text are grouped once, whatever the number of pairs, so texts are
    never shuffled and the shuffle follows the pairs that are left. A group holds a set of columns, never of rows, so
    values that occur everywhere stay small.
    """
    facts = keyed.where(f"({sources}) or ({targets})").select("table", "column", "type", "unique_count", "min_num", "max_num", F.expr(sources).alias("s"), F.expr(targets).alias("t"))
    chosen = [r.asDict() for r in facts.orderBy("table", "column").collect()]
    spark = keyed.sparkSession
    pairs = plausible_pairs(tables, chosen, least) if chosen else []
    if not pairs:
        return spark.createDataFrame([], "s_table string, s_column string, t_table string, t_column string, common long, source_size long")
    ids = sorted({i for p in pairs for i in p})
    # a value's columns are bits, WORD of them in a long
    words = [F.bit_or(F.when(F.col("word") == w, F.col("bit"))) for w in range(-(-len(ids) // WORD))]
    parts = []
    for name in sorted({chosen[i]["table"] for i in ids}):
        cells = []
        for at, i in enumerate(ids):
            if chosen[i]["table"] == name:
                text = F.col(f"`{chosen[i]['column']}`").cast("string")
                cells.append(F.struct(F.lit(at // WORD).alias("word"), F.lit(1 << at % WORD).cast("long").alias("bit"), text.alias("text")))
        parts.append(tables[name].select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("text is not null"))
    parts = [p.select("word", "bit", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("salt"), "text").alias("h2")) for p in parts]
    masks = union(parts).groupBy("h1", "h2").agg(*[w.alias(f"w{k}") for k, w in enumerate(words)])
    sets = masks.groupBy(*masks.columns[2:]).agg(F.count(F.lit(1)).alias("n"))
    # what is left is one row for each combination of columns that share a value
    there = [F.when(F.col(f"w{at // WORD}").bitwiseAND(F.lit(1 << at % WORD).cast("long")) != 0, F.lit(i)) for at, i in enumerate(ids)]
    one = sets.select(F.array_compact(F.array(*there)).alias("ids"), "n").select("ids", "n", F.explode("ids").alias("a"))
    size = one.groupBy("a").agg(F.sum("n").alias("source_size"))
    asked = spark.createDataFrame([(i, j, *(chosen[x][k] for x in (i, j) for k in ("table", "column"))) for i, j in pairs], "a int, b int, s_table string, s_column string, t_table string, t_column string")
    two = one.select("n", "a", F.explode("ids").alias("b")).join(F.broadcast(asked.select("a", "b")), ["a", "b"]).groupBy("a", "b").agg(F.sum("n").alias("common"))
    met = two.join(F.broadcast(size), "a").join(F.broadcast(asked), ["a", "b"]).where(F.col("common") >= least * F.col("source_size"))
    return met.select("s_table", "s_column", "t_table", "t_column", "common", "source_size")


def by_value(tables: dict[str, DataFrame], keyed: DataFrame, least: float = 0.5) -> DataFrame:
    """Inclusion of a column's values in a unique column of another table; of a pair seen both ways the first by name."""
    can = "type not in ('TEXT', 'BINARY') and unique_count >= 2"
    sources = f"coalesce(key_type, '') not in ('PK', 'UQ') and {can}"
    targets = f"unique_count = total_count and {can}"
    pairs = value_overlaps(tables, keyed, sources, targets, least).withColumn("overlap", F.col("common") / F.col("source_size"))
    grade = F.when(F.col("overlap") >= 0.9, "high").when(F.col("overlap") >= 0.7, "medium").otherwise("low")
    keys = keyed.select("table", "column", "unique_count", "total_count")
    met = pairs.join(keys.alias("s"), (F.col("s.table") == F.col("s_table")) & (F.col("s.column") == F.col("s_column"))).join(
        keys.alias("t"), (F.col("t.table") == F.col("t_table")) & (F.col("t.column") == F.col("t_column"))
    )
    found = met.select(
        F.col("s_table").alias("source_table"), F.col("s_column").alias("source_column"), F.col("t_table").alias("target_table"), F.col("t_column").alias("target_column"),
        cardinality(_unique("s"), _unique("t")).alias("type"), grade.alias("confidence"), F.round("overlap", 6).alias("overlap"),
    )
    ends = F.array_sort(F.array(F.concat_ws(".", "source_table", "source_column"), F.concat_ws(".", "target_table", "target_column")))
    first = F.row_number().over(Window.partitionBy(ends).orderBy("source_table", "source_column"))
    return found.withColumn("rank", first).where("rank = 1").drop("rank")


def self_references(keyed: DataFrame) -> DataFrame:
    """Foreign-key-named columns whose candidate is their own table; the target is the column id."""
    own = F.array(F.lower("table"), singular(F.col("table")))
    hit = keyed.where("key_type = 'FK'").where(F.arrays_overlap(fk_candidates(F.col("column")), own))
    return hit.select(F.col("table").alias("source_table"), F.col("column").alias("source_column"), F.col("table").alias("target_table"), F.lit("id").alias("target_column"), F.lit("one-to-many").alias("type"), F.lit("medium").alias("confidence"))


def declared(foreign: DataFrame, name_map: DataFrame, keyed: DataFrame) -> DataFrame:
    """Declared foreign keys between loaded tables: mapped, without repeats, of high confidence; the cardinality is that of
    the data, one-to-many where a column is not there."""
    n = name_map.select("meta_name", "loaded_name")
    met = foreign.join(n.select(F.col("meta_name").alias("parent_table"), F.col("loaded_name").alias("source_table")), "parent_table")
    met = met.join(n.select(F.col("meta_name").alias("referenced_table"), F.col("loaded_name").alias("target_table")), "referenced_table")
    out = met.select("source_table", F.col("parent_column").alias("source_column"), "target_table", F.col("referenced_column").alias("target_column")).distinct()
    unique = F.col("unique_count") == F.col("total_count")
    for side in ("source", "target"):
        out = out.join(keyed.select(F.col("table").alias(f"{side}_table"), F.col("column").alias(f"{side}_column"), unique.alias(f"{side}_unique")), [f"{side}_table", f"{side}_column"], "left")
    kind = F.when(F.col("source_unique").isNull() | F.col("target_unique").isNull(), "one-to-many").otherwise(cardinality(F.col("source_unique"), F.col("target_unique")))
    return out.select("source_table", "source_column", "target_table", "target_column", kind.alias("type"), F.lit("high").alias("confidence"))


def mark_declared(keyed: DataFrame, rels: DataFrame) -> DataFrame:
    """The keyed profile with FK for the source columns of declared relationships, unless they are primary keys."""
    ends = rels.select(F.col("source_table").alias("table"), F.col("source_column").alias("column"), F.lit(True).alias("is_fk")).distinct()
    kind = F.when(F.col("is_fk") & (F.coalesce("key_type", F.lit("")) != "PK"), "FK").otherwise(F.col("key_type"))
    return keyed.join(ends, ["table", "column"], "left").withColumn("key_type", kind).drop("is_fk")


def combine(parts: dict[str, DataFrame]) -> DataFrame:
    """All relationships with their origin; of equal ends the part named first wins."""
    rows = union([df.select(*COLUMNS, F.lit(name).alias("origin"), F.lit(i).alias("rank")) for i, (name, df) in enumerate(parts.items())])
    first = F.row_number().over(Window.partitionBy(*COLUMNS[:4]).orderBy("rank"))
    return rows.withColumn("first", first).where("first = 1").drop("first", "rank")


def junction_tables(keyed: DataFrame) -> DataFrame:
    """(table, fk_columns, other_columns): two or more foreign keys and at most one column that says something else."""
    meta = F.lower("column").isin("id", "created_at", "updated_at", "deleted_at")
    kind = F.coalesce("key_type", F.lit(""))
    counts = keyed.groupBy("table").agg(F.count_if(kind == "FK").alias("fk_columns"), F.count_if(~kind.isin("FK", "PK") & ~meta).alias("other_columns"))
    return counts.where("fk_columns >= 2 and other_columns <= 1")


def filter_relationships(rels: DataFrame, keyed: DataFrame, key_types=None, types=None, tables=None) -> DataFrame:
    """Relationships whose source column has one of key_types, of one of types, with an end in tables; None: any."""
    if key_types is not None:
        keys = keyed.where(F.col("key_type").isin(*key_types)).select(F.col("table").alias("source_table"), F.col("column").alias("source_column"))
        rels = rels.join(keys, ["source_table", "source_column"], "left_semi")
    if types is not None:
        rels = rels.where(F.col("type").isin(*types))
    if tables is not None:
        rels = rels.where(F.col("source_table").isin(*tables) | F.col("target_table").isin(*tables))
    return rels


def implicit_fks(tables: dict[str, DataFrame], keyed: DataFrame, known: DataFrame, least: float = 0.9) -> DataFrame:
    """Columns named like keys, with no relationship yet, whose values lie in another table's primary key; best parent."""
    named = "lower(column) rlike '_(id|ref|key)$' and coalesce(key_type, '') <> 'PK' and unique_count > 0"
    open_ = keyed.join(known.select(F.col("source_table").alias("table"), F.col("source_column").alias("column")).distinct(), ["table", "column"], "left_anti")
    pk = first_pk(keyed)
    chosen = open_.where(named).withColumn("role", F.lit("s")).unionByName(pk.withColumn("role", F.lit("t")))
    pairs = value_overlaps(tables, chosen, "role = 's'", "role = 't'", least).withColumn("overlap", F.col("common") / F.col("source_size"))
    best = F.row_number().over(Window.partitionBy("s_table", "s_column").orderBy(F.desc("overlap"), "t_table", "t_column"))
    out = pairs.withColumn("rank", best).where("rank = 1")
    return out.select(F.col("s_table").alias("source_table"), F.col("s_column").alias("source_column"), F.col("t_table").alias("target_table"), F.col("t_column").alias("target_column"), F.round("overlap", 6).alias("overlap"))
