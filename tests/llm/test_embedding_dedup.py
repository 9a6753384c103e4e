import numpy as np
import pytest

from relscope.llm import embedding_dedup, queries

SF = "/root/testdata/sf0.1"


def brute(rows, threshold=0.93):
    """({id: number of links}, {id: component}) by comparing all pairs of each label."""
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by.setdefault((label, len(v)), []).append((i, v))
    for group in by.values():
        x = np.array([v for _, v in group], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            p, q = group[a][0], group[b][0]
            links[p] += 1
            links[q] += 1
            root[max(find(p), find(q))] = min(find(p), find(q))
    return links, {i: find(i) for i in root}


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    links, groups = brute(rows)
    got = {r.vec_id: r for r in queries.op4_embedding_near_dedup(spark, SF).collect()}
    assert set(got) == set(links)
    assert all(got[i].n_links <= n for i, n in links.items())
    print("links", sum(links.values()), "found", sum(r.n_links for r in got.values()))
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links.values())
    assert sum(got[i].component_id == c for i, c in groups.items()) >= 0.99 * len(groups)


def common_direction(rng, n, share, d=64):
    """Unit vectors with a mean cosine of `share`."""
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] += np.sqrt(share / (1 - share))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.7])
@pytest.mark.parametrize("width", [10, 14])
def test_recall_of_wide_bands(width, share):
    """Pairs right at the threshold that the plan has not seen, also of vectors that share a direction."""
    rng = np.random.default_rng(width)
    turns, narrowed, bands = embedding_dedup.measured_plan(common_direction(rng, 4000, share), 16 << width, 0.93, 0.99, 7)
    x = common_direction(rng, 4000, share)
    y = embedding_dedup.partners(x, 0.93, rng)
    assert np.allclose((x * y).sum(1), 0.93)
    met, each = np.zeros(len(x), bool), 64 // narrowed
    for n in range(bands):
        mean, axes = turns[n // each]
        part = axes[:, n % each * narrowed :][:, :narrowed]
        met |= (((x - mean) @ part >= 0) == ((y - mean) @ part >= 0)).all(1)
    print("width", narrowed, "bands", bands, "recall", met.mean())
    assert met.mean() >= 0.98


def test_common_direction(spark):
    rng = np.random.default_rng(8)
    x = common_direction(rng, 1000, 0.7)
    both = np.concatenate([x, embedding_dedup.partners(x, 0.931, rng)])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(both)]
    links, _ = brute(rows)
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    print("links", sum(links.values()), "found", sum(r.n_links for r in got))
    assert sum(r.n_links for r in got) >= 0.98 * sum(links.values())


def test_width_within_the_dimension():
    assert embedding_dedup.band_plan(16 << 14, 8, 0.93, 0.99)[0] == 8
    one = np.ones((3, 1))
    assert embedding_dedup.measured_plan(one, 1, 0.93, 0.99, 7)[1] == 1


@pytest.mark.parametrize("block", [512, 16])
def test_hot_vectors_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, base.tolist(), 1) for i in range(100)]
    rows += [(100 + i, (base + rng.normal(size=16) * 0.12).tolist(), 1) for i in range(150)]
    rows += [(500 + i, rng.normal(size=16).tolist(), int(i % 2)) for i in range(200)]
    links, groups = brute(rows)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i].n_links <= n for i, n in links.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(links.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_repeated_ids_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 1), (3, [0.0, 1.0], 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 2, 1)]


@pytest.mark.parametrize("dimension", [6, 8])
def test_few_dimensions_and_many_vectors(spark, dimension):
    """Labels so large that the bands' width would pass the dimension."""
    rng = np.random.default_rng(dimension)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(9000, dimension)))]
    links, _ = brute(rows)
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(links.values()) >= sum(r.n_links for r in got) >= 0.97 * sum(links.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
        (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1e-30, 0.0], 1), (None, [1.0, 0.0], 1),
    ]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == [(0, 0, None, True), (1, 4, 1, True), (2, 4, 1, False), *alone, (12, 4, 1, False), (12, 4, 1, False), (13, 4, 1, False)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(empty).count() == 0
