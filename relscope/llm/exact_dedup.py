"""Exact deduplication by progressive refinement, in DataFrame functions only.

Level 1 reads each text's length and the hash of its (normalised) prefix; only pairs (length, prefix hash) that
occur twice survive. Level 2 hashes the full content of the survivors and groups them by that hash. The length and
the prefix hash are grouped in one shuffle, as the pair separates everything that the length alone would.

Survivors are recognised in the second scan by a sieve: the set of hash buckets of surviving pairs, at most
`sieve_buckets` rows of one long whatever the input, so it can always be broadcast. A false hit of the sieve only
costs one more full hash; it never changes a result. The second scan stores an id and a hash for each row, so no text
is hashed twice or shuffled. Groups of copies are folded by map-side aggregation and never gathered. Verdicts go back
by a join on the full hash; groups that hold 1/HOT_GROUPS of all rows or more, of which there can be HOT_GROUPS at
most, are broadcast, so no task of that join gets a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups, packed, sieved, text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text):
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, sieve_buckets: int = 1 << 20, digest_all: bool = False
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays. text_sha256 is null for
    rows that level 1 proved unique unless digest_all is set.

    Null text counts as empty. A null id is below every other id; a group with null ids only keeps them (keep_id
    null). Rows that repeat an id and its text each count in group_size and share the verdict. An empty table gives
    an empty result. Other columns are left out.
    """
    text = text_or_empty("t")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    rows = rows.withColumns({"n_len": F.length(text), "head": F.xxhash64(normalised(F.substring(text, 1, prefix_chars)))})
    twice = rows.groupBy("n_len", "head").agg(F.count("*").alias("n")).where("n > 1")
    digest = F.sha2(normalised(text), 256)
    marked = sieved(rows, twice, "n_len", "head", buckets=sieve_buckets).select("doc_id", "hit", (digest if digest_all else F.when(F.col("hit"), digest)).alias("text_sha256"))
    marked = cut(marked)
    hits = marked.where("hit").select("doc_id", "text_sha256")
    groups = hits.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    grouped = join_groups(hits, cut(groups), "text_sha256", "group_size", marked.count())
    alone = marked.where("hit is null").select("doc_id", "text_sha256")
    single = F.col("group_size").isNull()
    return grouped.unionByName(alone, allowMissingColumns=True).select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sieve_buckets: int = 1 << 20, **options) -> DataFrame:
    """The rows of docs that stay, with docs' own columns; rows that repeat a kept id and text stay once. Only rows that
    may go meet their verdict in a shuffle, by id and hash; the others pass a sieve of the verdicts' ids."""
    done = exact_dedup(docs, id_col, text_col, sieve_buckets=sieve_buckets, **options).where("text_sha256 is not null")
    marks = done.groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    marks = cut(marks.where("not kept or n > 1").select(F.col("doc_id").alias("m_id"), F.col("text_sha256").alias("m_sha"), "kept"))
    rows = packed(docs, doc_id=F.col(f"`{id_col}`"), t=F.col(f"`{text_col}`"))
    rows = sieved(rows, marks.select(F.col("m_id").alias("doc_id")), "doc_id", buckets=sieve_buckets)
    hits = rows.where("hit").withColumn("sha", F.sha2(normalised(text_or_empty("t")), 256))
    met = hits.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("sha") == F.col("m_sha")), "left")
    repeated = met.where("kept").dropDuplicates(["doc_id", "sha"])
    return rows.where("hit is null").select("row.*").unionByName(met.where("kept is null").select("row.*")).unionByName(repeated.select("row.*"))
