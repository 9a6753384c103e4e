"""N-gram Jaccard join by a MinHash LSH forest, followed by exact verification.

Texts with the same set of shingles are one text with a weight. Every distinct set has a MinHash signature, cut into
the trees of a forest; texts that share a prefix of a tree's hashes are candidates. The prefix is shortened from the
longest on until a pair right at the threshold meets in some tree with the target's chance, so what is found of a pair
does not depend on the other texts. Each tree's prefixes are dealt and sorted by Spark's shuffle, where the runs of
equal prefixes are the nodes of its trie at that depth.

Candidates within a prefix are filtered by a 64-byte sketch of the signature at a similarity five standard deviations
below the threshold, and only spanning edges of what passes leave a task, of which a prefix has no more than sets. The
groups they span are then verified on the sorted hashes of their shingles, in blocks of bounded size. A pair links if its
exact similarity reaches the threshold and it shares a prefix in some tree, wherever it is compared: a group of up to a
block is compared whole, a larger one whole or by prefix, whichever has fewer pairs. A dense group is cheaper whole, a long
chain of texts of which each is near a few others is cheaper by the prefixes they share, where a pair counts in the first
tree it meets in.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import CELL_BYTES, TOUCHED, bucketed, cells, components, dealt, few, numbered, pairs, settled, touched, whole_cells
from .common import HOT_GROUPS, bound_batches, cut, join_groups, lean, packed, sieved, slices
from .words import split_words

TREES, DEEPEST = 18, 7
HASHES = 128  # of which TREES * DEEPEST are in the forest
BLOCK = 256
#: Texts whose shingles are held at once.
TEXTS = 250
_rng = np.random.default_rng(20240607)
FACTORS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
#: Equal half bytes of two sketch bytes.
EQUAL_HALVES = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of each text, joined; how many each text has).

    Words are lower-cased and separated by ASCII white space; a text with fewer than `words` words has one shingle of
    all its words, a text without words none.
    """
    lowered = pc.utf8_lower(pa.array(texts, pa.large_string()))
    codes, distinct, counts = split_words(lowered)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    word = pd.util.hash_array(np.array(distinct, object), categorize=False)[codes]
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(codes)) - np.repeat(ends - counts, counts)
    size = np.minimum(counts, words)
    hashed = np.zeros(len(codes), np.uint64)
    for k in range(words):
        inside = np.flatnonzero((at + k < counts[owner]) & (k < size[owner]))
        hashed[inside] = hashed[inside] * np.uint64(0x9E3779B97F4A7C15) + _mix(word[inside + k] + np.uint64(k + 1))
    starts = at <= counts[owner] - size[owner]
    hashed, owner = _mix(hashed[starts]), owner[starts]
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.append(True, (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1]))
    return hashed[new], np.bincount(owner[new], minlength=len(counts))


def signatures(hashed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts with shingles, HASHES): the high halves of the smallest values of each hash over each text's shingles."""
    have = counts[counts > 0]
    starts = np.cumsum(have) - have
    out = np.empty((len(have), HASHES), "<u4")
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(hashed * FACTORS[k] + SHIFTS[k], starts) >> np.uint64(32) if len(have) else 0
    return out


def _sketch(signature: np.ndarray) -> np.ndarray:
    low = (signature & 15).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, set_hash, signature, sketch); text_key tells rows of one id apart, set_hash is null for texts
    without words."""

    def run(batches):
        for part in (p for pdf in batches for p in slices(pdf, TEXTS)):
            hashed, counts = shingle_sets([t or "" for t in part["text"]], words)
            mins = signatures(hashed, counts)
            sketch, ends = _sketch(mins), np.cumsum(counts)
            n, out = 0, []
            for size, end in zip(counts.tolist(), ends.tolist()):
                if size:
                    key = hashlib.blake2b(hashed[end - size : end].tobytes(), digest_size=16).digest()
                    out.append((key, mins[n, : TREES * DEEPEST].tobytes(), sketch[n].tobytes()))
                    n += 1
                else:
                    out.append((None, None, None))
            yield part[["doc_id", "text_key"]].assign(**dict(zip(["set_hash", "signature", "sketch"], map(list, zip(*out)))))

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInPandas(lean(run), "doc_id long, text_key long, set_hash binary, signature binary, sketch binary")


def meeting_chance(similarity, depth: int):
    """The chance that two sets of this similarity share a prefix of this depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_depth(limit: float, target: float, shallowest: int) -> int:
    """The longest prefix by which sets at the threshold meet with the target's chance; `shallowest` if none does."""
    return next((d for d in range(DEEPEST, shallowest, -1) if meeting_chance(limit, d) >= target), shallowest)


def _prefixes(sets: DataFrame, depth: int) -> DataFrame:
    """sets (signature, ...) once for each tree, with tree and prefix."""
    trees = sets.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    return trees.withColumn("prefix", F.expr(f"substring(signature, tree * {4 * DEEPEST} + 1, {4 * depth})"))


def candidates(sets: DataFrame, depth: int, threshold: float, rows: int) -> DataFrame:
    """Spanning edges (node, root) of sets that share a prefix of `depth` and pass the sketch.

    A prefix of up to BLOCK sets is one cell. Of a larger one all sets meet its first block; what passes there hangs on the
    prefix's smallest node. Only the sets that passed with none of that block meet the others, in a second round. So a
    dense group costs two rows a set, of which it has one edge, however large it is.
    """
    forest = _prefixes(sets.select("node", "sketch", "signature"), depth)
    forest = forest.select("node", "sketch", F.xxhash64("tree", "prefix").alias("key"))
    match = threshold + (1 - threshold) / 16
    least = match - 5 * np.sqrt(match * (1 - match) / HASHES)

    def passing(pdf, cell, own, same):
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in pairs(cell, own, same):
            near = EQUAL_HALVES[sketch[i] ^ sketch[j]].sum(1) / HASHES >= least
            a.append(i[near])
            b.append(j[near])
        return np.concatenate(a), np.concatenate(b)

    def first(batches):
        for pdf, cell in whole_cells(batches, "key"):
            node, own, hi, parts = (pdf[c].to_numpy() for c in ("node", "own", "hi", "parts"))
            a, b = passing(pdf, cell, own, hi == 0)
            one = parts[a] == 1
            small = touched(node, np.ones(len(pdf)), a[one], b[one])[["node", "root"]]
            linked = np.zeros(len(pdf), bool)
            linked[a], linked[b] = True, True
            hung = pdf.loc[linked & (parts > 1), ["node", "root"]]
            loose = pdf.loc[~linked & (parts > 1) & (own > 0), ["key", "node", "sketch"]]
            yield pd.concat([small, hung, loose]).reindex(columns=["node", "root", "key", "sketch"]).astype({"root": "Int64", "key": "Int64"})

    met = bucketed(forest, "key", "node", BLOCK, rows * TREES)
    all_blocks = F.sequence(F.lit(0), F.col("parts") - 1)
    hi = F.explode(F.when(F.col("own") == 0, all_blocks).otherwise(F.array("own")))
    found = cut(dealt(met.withColumns({"lo": F.lit(0), "hi": hi}), "key").mapInPandas(lean(first), "node long, root long, key long, sketch binary"))
    edges, loose = found.where("root is not null").select("node", "root"), found.where("root is null").select("key", "node", "sketch")
    if loose.isEmpty():
        return edges

    def second(batches):
        for pdf, cell in whole_cells(batches, "key"):
            node, own = pdf["node"].to_numpy(), pdf["asks"].to_numpy().astype(np.int64)
            a, b = passing(pdf, cell, own, np.zeros(len(pdf), bool))
            other = node[a] != node[b]
            ends = np.concatenate([a[other], b[other]])
            yield pdf.iloc[np.unique(ends[own[ends] == 1])][["node", "root"]]

    counts = loose.groupBy("key").agg(F.count("*").alias("loose"))
    known = cut(forest.join(F.broadcast(counts.select("key")) if counts.count() <= HOT_GROUPS else counts.select("key"), "key", "left_semi"))
    known = bucketed(known, "key", "node", BLOCK, known.count()).where("own > 0")
    known = join_groups(known, counts, "key", "loose", rows * TREES)
    n = F.ceil(F.col("loose") / BLOCK).cast("int")
    asked = known.select("key", "node", "sketch", "root", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("lo"), F.col("own").alias("hi"))
    sizes = known.groupBy("key").agg(F.first("parts").alias("parts"), F.first("root").alias("root"), F.first("loose").alias("loose"))
    asking = join_groups(loose, sizes, "key", "loose", rows * TREES)
    asking = asking.select("key", "node", "sketch", "root", F.lit(True).alias("asks"), F.pmod(F.xxhash64("node", F.lit(1)), n).cast("int").alias("lo"), F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("hi"))
    return edges.unionByName(dealt(asked.unionByName(asking), "key").mapInPandas(lean(second), "node long, root long"))


def hashed_members(members: DataFrame, words: int) -> DataFrame:
    """members (node, weight, component, signature, text) with the text's place taken by its packed shingle hashes."""

    def run(batches):
        for pdf in batches:
            hashed, counts = shingle_sets(pdf.pop("text").tolist(), words)
            ends = np.cumsum(counts)
            yield pdf.assign(hashes=[hashed[e - n : e].tobytes() for n, e in zip(counts.tolist(), ends.tolist())])

    return members.mapInPandas(lean(run), "node long, weight long, component long, signature binary, hashes binary")


def comparisons(members: DataFrame, depth: int, rows: int) -> DataFrame:
    """Hashed members dealt to what they are compared in: columns key and tree, -1 for a group that is compared whole."""
    bulk = F.sum(F.length("hashes"))
    groups = cut(members.groupBy("component").agg(F.count("*").alias("held"), bulk.cast("long").alias("bulk")))
    n = groups.count()
    groups = few(groups, n)
    large = groups.where((F.col("held") > BLOCK) | (F.col("bulk") > CELL_BYTES))
    met = cut(join_groups(members.select("node", "component", "signature"), large, "component", "held", rows).where("held is not null"))
    size = met.count()
    by_prefix = _prefixes(few(met, size), depth).groupBy("component", "tree", "prefix").agg(F.count("*").alias("n")).transform(few, size)
    by_prefix = by_prefix.groupBy("component").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).transform(few, size)
    cheaper = by_prefix.join(large, "component").where(F.col("pairs") < F.col("held") * (F.col("held") - 1))
    split = cut(groups.join(cheaper.select("component", F.lit(True).alias("apart")), "component", "left").drop("bulk"))
    out = join_groups(members, few(split, n), "component", "held", rows).drop("held")
    whole = out.where("apart is null").withColumns({"tree": F.lit(-1), "key": F.col("component")})
    apart = _prefixes(out.where("apart"), depth).withColumn("key", F.xxhash64("component", "tree", "prefix")).drop("prefix")
    return whole.unionByName(apart).drop("apart")


def _meets(a: np.ndarray, b: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Whether pairs share a prefix in any tree, and where they are compared for one tree, whether it is their first."""
    meets = (a == b).all(2)
    return meets.any(1) & ((tree < 0) | (meets.argmax(1) == tree))


def verified(members: DataFrame, depth: int, threshold: tuple[int, int], rows: int) -> DataFrame:
    """Touched rows of hashed members: the pairs of comparisons(), by their exact sets."""
    over, under = threshold

    def run(batches):
        for pdf, cell in whole_cells(batches, "key"):
            own, same, tree = pdf["own"].to_numpy(), (pdf["lo"] == pdf["hi"]).to_numpy(), pdf["tree"].to_numpy()
            group, hashes, signature = pdf["component"].to_numpy(), pdf["hashes"].tolist(), pdf["signature"].tolist()
            a, b = [], []
            bounds = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = np.frombuffer(b"".join(hashes[first:last]), np.uint64)
                size = np.fromiter(map(len, hashes[first:last]), np.int32, last - first) // 8
                common = _common(part, size)
                union = size[:, None] + size[None, :] - common
                link = np.triu(common * under >= over * union, 1) & (common > 0)
                if not same[first]:
                    link &= own[first:last, None] != own[None, first:last]
                i, j = np.nonzero(link)
                i, j = i + first, j + first
                good = (group[i] == group[j]) & (tree[i] == tree[j])  # keys are hashes
                if len(i):
                    prefix = np.frombuffer(b"".join(signature[first:last]), "<u4").reshape(last - first, TREES, DEEPEST)[:, :, :depth]
                    good &= np.concatenate([_meets(prefix[p - first], prefix[q - first], tree[p]) for p, q in zip(np.array_split(i, len(i) // 4096 + 1), np.array_split(j, len(i) // 4096 + 1))])
                a.append(i[good])
                b.append(j[good])
            yield touched(pdf["node"].to_numpy(), pdf["weight"].to_numpy(), np.concatenate(a), np.concatenate(b))

    compared = comparisons(members, depth, rows).withColumn("bytes", F.length("hashes"))
    return cells(compared, "key", "node", BLOCK, rows, "bytes").mapInPandas(lean(run), TOUCHED)


def _common(part: np.ndarray, size: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many elements each two of the sets share: products of membership matrices, some columns at a time."""
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    values, at, often = np.unique(part, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    place = place[at]
    out = np.zeros((n, n), np.int32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for first in range(0, len(shared), columns):
        lo, hi = np.searchsorted(place, [first, first + columns])
        some = np.zeros((n, min(columns, len(shared) - first)), np.float32)
        some[owner[lo:hi], place[lo:hi] - first] = 1
        out += np.rint(some @ some.T).astype(np.int32)  # at most `columns` each, so whole numbers
    return out


def _classes(docs: DataFrame, words: int, threshold: tuple[int, int], target: float, shallowest: int) -> DataFrame:
    """(doc_id, text_key, set_hash, class_id, n_links, first): a row of near_texts with the key of its text and set, null
    for rows that are compared by no one; first is the set that stays of its class."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    limit = threshold[0] / threshold[1]
    depth = prefix_depth(limit, target, shallowest)
    sign = cut(signed(rows, words))
    total = sign.count()
    # a set's node is a number of its own, as rows may repeat an id; its text is that of its smallest (id, text)
    one = F.min(F.struct("doc_id", "text_key")).alias("one")
    sets = numbered(sign.where("set_hash is not null").groupBy("set_hash").agg(one, F.count("*").alias("weight"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")))
    n_sets = sets.count()
    edges = cut(candidates(sets, depth, limit, n_sets))
    groups = sets.select("node", "weight", "signature", "one.*").join(components(edges), "node")
    groups = cut(groups)
    # only texts of the groups are shuffled, and those that share a bucket of the sieve with them
    near = sieved(rows.withColumn("text_key", F.xxhash64("text")), groups, "doc_id", "text_key").where("hit").drop("hit")
    texts = near.join(groups, ["doc_id", "text_key"]).dropDuplicates(["node"])
    members = cut(hashed_members(texts.select("node", "weight", "component", "signature", "text"), words))
    found = verified(members, depth, threshold, n_sets)
    # the smallest id of a class, with the set that has it, so one set stays where several share that id
    done = settled(sets.select("node", "set_hash", "weight", F.struct("one.doc_id", "set_hash").alias("id")), found)
    verdict = done.select("set_hash", "weight", (F.col("weight") - 1 + F.col("links")).alias("n_links"), F.col("least.doc_id").alias("class_id"), F.col("least.set_hash").alias("first"))
    met = join_groups(sign.where("set_hash is not null").select("doc_id", "text_key", "set_hash"), verdict, "set_hash", "weight", total).drop("weight")
    alone = sign.where("set_hash is null").select("doc_id", "text_key").unionByName(docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key")))
    none = F.lit(None).cast("binary")
    return met.unionByName(alone.withColumns({"set_hash": none, "class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"), "first": none}))


def near_texts(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5), target: float = 0.999, shallowest: int = 4) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for every row of docs (doc_id, text).

    Two rows link when the Jaccard similarity of their sets of word shingles is at least threshold[0] / threshold[1].
    class_id is the smallest doc_id reachable by links, n_links the number of other rows linked directly, copies
    included; kept marks rows with doc_id = class_id. Texts without a word (null, empty, white space) link with
    nothing. Rows that repeat an id are told apart by their texts, so each has its own class and links; rows with null
    ids are compared by no one and kept. An empty table gives an empty result. Other columns are left out.
    """
    done = _classes(docs, words, threshold, target, shallowest)
    return done.select("doc_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5), target: float = 0.999, shallowest: int = 4) -> DataFrame:
    """The rows of docs that stay, with docs' own columns: of each class of near_texts the row with the smallest doc_id,
    and of several texts with this id one of them. Rows that repeat an id and its text share the verdict. Rows with
    null ids and texts without a word all stay."""
    done = _classes(docs, words, threshold, target, shallowest).where("set_hash is not null")
    stays = (F.col("doc_id") == F.col("class_id")) & (F.col("set_hash") == F.col("first"))
    per = done.groupBy("doc_id", "text_key", "set_hash").agg(F.first(stays).alias("stays"))
    # of texts with one set and one id, too, only one stays
    order = F.row_number().over(Window.partitionBy("doc_id", "set_hash").orderBy("text_key"))
    gone = cut(per.withColumn("stays", F.col("stays") & (order == 1)).where("not stays").select("doc_id", "text_key"))
    rows = packed(docs.where("doc_id is not null"), doc_id=F.col("doc_id"), text_key=F.xxhash64("text"))
    rows = sieved(rows, gone, "doc_id", "text_key")
    left = rows.where("hit").join(gone, ["doc_id", "text_key"], "left_anti").select("row.*")
    return left.unionByName(rows.where("hit is null").select("row.*")).unionByName(docs.where("doc_id is null"))
