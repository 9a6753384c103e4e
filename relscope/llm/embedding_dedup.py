"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

A rotation of the principal axes that balances binary codes is learned (Gong and Lazebnik, 2011) from a bounded sample
of the unit vectors; several starts give several codes. Every distinct vector is coded, and codes are cut into bands; a
table for each band brings together vectors of one label whose codes agree in it. The band's width follows the number
of vectors, so buckets stay small as the table grows. The number of bands is measured with the learned codes, on sampled
vectors and partners at the threshold, so that these meet with probability `recall`; where that would take too many,
bands are narrowed. Vectors that meet are compared with their original components.

Equal vectors are one vector with a weight before anything is compared; large buckets are compared in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import TOUCHED, cells, numbered, pairs, settled, touched, whole_cells
from .common import bound_batches, cut, join_groups, lean

BLOCK = 512
#: Bands beyond which, or beyond the plan if it has more, narrower bands are tried.
BANDS = 64
#: Bits of the widest band, which a code of 32 bits holds: enough for 2^35 vectors of a label.
WIDEST = 31
#: Pairs at the threshold by which recall is measured.
TRIALS = 5000


def learn_rotation(unit: np.ndarray, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): codes are the signs of (x - mean) @ axes."""
    mean = unit.mean(0) if len(unit) else np.zeros(unit.shape[1])
    x = unit - mean
    d = unit.shape[1]
    axes = np.linalg.eigh(np.cov(x.T).reshape(d, d) if len(x) > 1 else np.eye(d))[1]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    v = x @ axes
    for _ in range(rounds if len(x) > 1 else 0):
        left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return mean, axes @ turn


def band_plan(most: int, dimension: int, threshold: float, recall: float) -> tuple[int, int]:
    """(width, bands) for a label of `most` vectors: about 16 vectors a bucket, and the recall wanted at the threshold if
    codes keep the angle of the vectors."""
    width = min(int(np.clip(np.log2(max(most, 1) / 16), 6, WIDEST)), dimension)
    return width, _planned(width, threshold, recall)


def _planned(width: int, threshold: float, recall: float) -> int:
    agree = (1 - np.arccos(threshold) / np.pi) ** width
    return int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))


def partners(unit: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector another at this cosine, in a random direction from it."""
    if unit.shape[1] == 1:
        return unit
    away = rng.normal(size=unit.shape)
    away -= (away * unit).sum(1, keepdims=True) * unit
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return cosine * unit + np.sqrt(max(0.0, 1 - cosine * cosine)) * away


def measured_plan(unit: np.ndarray, most: int, threshold: float, recall: float, seed: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
    """(rotations, width, bands): band_plan with as many more bands as pairs at the threshold need to meet.

    Centring widens the angle of vectors that share a direction, so the plan's bands are only the least there are.
    """
    width, bands = band_plan(most, unit.shape[1], threshold, recall)
    rng = np.random.default_rng(seed)
    # codes fit the vectors they were learned from better than others, so a fifth is held out to measure by
    apart = np.arange(len(unit)) % 5 == 0 if len(unit) >= 100 else np.ones(len(unit), bool)
    learned = unit[~apart] if len(unit) >= 100 else unit
    x = unit[apart][rng.integers(apart.sum(), size=TRIALS)]
    y = partners(x, threshold, rng)
    turns, same = [], []
    while True:
        each, limit = unit.shape[1] // width, max(BANDS, bands)
        met, n = np.zeros(len(x), bool), 0
        while n < bands or (met.mean() < recall and n < limit):
            if n // each == len(turns):
                mean, axes = learn_rotation(learned, seed + len(turns))
                turns.append((mean, axes))
                same.append(((x - mean) @ axes >= 0) == ((y - mean) @ axes >= 0))
            k = n % each * width
            met |= same[n // each][:, k : k + width].all(1)
            n += 1
        if met.mean() >= recall or width == 1:
            return turns[: -(-n // each)], width, n
        width -= 1
        bands = _planned(width, threshold, recall)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, sample: int = 20_000, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their vectors have the same length and a cosine, in double
    precision, of `threshold` or more. Null, empty and zero vectors, vectors with null or non-finite components and rows
    with null labels or ids link with nothing and are kept. Equal vectors always link. Rows that repeat an id are told
    apart by label and vector, so each has its own links; other columns are left out. An empty table gives an empty result. Pairs found all have the cosine asked
    for; about `recall` of those right at the threshold are found, and more of closer ones.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(finite & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select("vec_id", "label", e.alias("v"), valid.alias("valid"))
    good = rows.where("valid").withColumn("v_key", F.xxhash64("label", "v"))
    distinct = numbered(good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    found = None
    for dimension in sorted(r[0] for r in distinct.select(F.size("v")).distinct().collect()):
        part = distinct.where(F.size("v") == dimension)
        touches = _touches(part, dimension, threshold, sample, recall, seed)
        found = touches if found is None else found.unionByName(touches)
    if found is None:
        found = spark.createDataFrame([], TOUCHED)
    verdict = settled(distinct, found).select("label", "v", "weight", (F.col("weight") - 1 + F.col("links")).alias("n_links"), F.col("least").alias("component_id"))
    # rows find their distinct vector by hash and then by the vector itself; hot vectors are broadcast
    verdict = verdict.withColumn("v_key", F.xxhash64("label", "v")).withColumnRenamed("label", "g_label").withColumnRenamed("v", "g_v")
    met = join_groups(good, verdict, "v_key", "weight", vectors.count())
    met = met.where((F.col("label") == F.col("g_label")) & (F.col("v") == F.col("g_v"))).select("vec_id", "n_links", "component_id")
    rest = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _touches(part: DataFrame, dimension: int, threshold: float, sample: int, recall: float, seed: int) -> DataFrame:
    spark = part.sparkSession
    some = part.select("v", F.xxhash64(F.lit(seed), "v").alias("h")).orderBy("h").limit(sample).select("v").toPandas()["v"]
    some = np.array(some.tolist(), np.float64).reshape(-1, dimension)
    some /= np.linalg.norm(some / np.abs(some).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(some).max(1, keepdims=True)
    counts = part.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    turns, width, bands = measured_plan(some, counts[0] or 0, threshold, recall, seed)
    sent = spark.sparkContext.broadcast(turns)
    each = dimension // width

    def unit(v):
        v = v / np.abs(v).max(1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def code(batches):
        place = 1 << np.arange(width)
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.array(pdf["v"].tolist(), np.float64).reshape(-1, dimension)
            x = unit(v)
            codes = [((x - m) @ a[:, k * width : (k + 1) * width] >= 0) @ place for m, a in sent.value for k in range(each)]
            codes = np.stack(codes[:bands], 1).astype("<u4")
            yield pd.DataFrame({"node": pdf["node"], "weight": pdf["weight"], "label_key": pdf["label_key"], "vector": [r.tobytes() for r in v], "codes": [r.tobytes() for r in codes]})

    keyed = part.select("node", "weight", "v", F.xxhash64("label").alias("label_key"))
    coded = cut(keyed.mapInPandas(lean(code), "node long, weight long, label_key long, vector binary, codes binary"))
    tables = coded.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    tables = tables.withColumn("key", F.xxhash64("label_key", "band", F.expr("substring(codes, band * 4 + 1, 4)")))

    def compare(batches):
        for pdf, cell in whole_cells(batches, "key"):
            v = unit(np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(-1, dimension))
            codes = np.frombuffer(b"".join(pdf["codes"]), "<u4").reshape(-1, bands)
            own, same, band, label = pdf["own"].to_numpy(), (pdf["lo"] == pdf["hi"]).to_numpy(), pdf["band"].to_numpy(), pdf["label_key"].to_numpy()
            a, b = [], []
            for i, j in pairs(cell, own, same):
                near = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
                i, j = i[near], j[near]
                first = (codes[i] == codes[j]).argmax(1) == band[i]  # a pair counts in the first table it meets in
                first &= label[i] == label[j]
                a.append(i[first])
                b.append(j[first])
            if a:
                yield touched(pdf["node"].to_numpy(), pdf["weight"].to_numpy(), np.concatenate(a), np.concatenate(b))

    return cells(tables, "key", "node", BLOCK, (counts[1] or 0) * bands).mapInPandas(lean(compare), TOUCHED)
