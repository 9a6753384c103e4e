import hashlib
import random
import zlib

import numpy as np
import pytest

from relscope.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def words_of(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(w):
    """Runs (start, length, period) by comparing a text with itself at every distance."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= 12)


def got(texts):
    codes = np.array([c for t in texts for c in t], np.int64)
    rows = periodic_runs.runs_of(codes, np.array([len(t) for t in texts], np.int64)).tolist()
    return [[tuple(r[1:]) for r in rows if r[0] == i] for i in range(len(texts))]


def nested(rng, n, letters):
    """Words full of repetitions within repetitions."""
    w = [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
    while len(w) < n:
        kind = rng.random()
        if kind < 0.4:
            w = w * rng.randint(2, 4)
        elif kind < 0.7:
            w = w + [rng.randrange(letters) for _ in range(rng.randint(1, 5))]
        elif kind < 0.85:
            w = w + w[: rng.randint(1, len(w))]
        else:
            w[rng.randrange(len(w))] = rng.randrange(letters)
    return w[:n]


@pytest.mark.parametrize("short", [24, 8, 4])
def test_runs_against_all_distances(monkeypatch, short):
    """With fewer lags the minima have to find what the lags found."""
    monkeypatch.setattr(periodic_runs, "SHORT", short)
    rng = random.Random(short)
    for _ in range(12):
        u = [rng.randrange(2) for _ in range(rng.randint(1, 4))]
        texts = [nested(rng, rng.randint(0, 500), k) for k in (1, 2, 3, 10)]
        texts += [((u * 40)[: rng.randint(20, 90)] + [7]) * rng.randint(2, 5), (u * 60)[:90] + (u * 60)[: rng.randint(20, 150)], []]
        fib = [[0], [0, 1]]
        while len(fib[-1]) < 300:
            fib.append(fib[-1] + fib[-2])
        texts += [fib[-1], [bin(i).count("1") % 2 for i in range(300)]]
        assert got(texts) == [brute(t) for t in texts]


def test_period_of_half_the_text():
    rng = random.Random(3)
    for n in (25, 50, 99, 100, 101, 777, 3000):
        w = [rng.randrange(10**6) for _ in range(n)]
        assert got([w + w]) == [[(0, 2 * n, n)]]
        assert got([w + w[:-1]]) == [[]]


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(found) == len(rows)
    planted = 0
    for doc, text in rows:
        w = words_of(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, r = brute(w), found[doc]
        drop = {i for s, size, q in runs for i in range(s + q, s + size)}
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
    assert planted > 5


def test_odd_rows(spark):
    line = "a b c d e f " * 5
    rows = [(1, None, 1), (1, "", 2), (None, " \t\n", 3), (2, line, 4), (2, line, 5), (3, "x\u00a0y " * 20, 6), (None, " ".join("zz"), 7), (4, ("w" * 1000 + " ") * 3000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed int")
    out = sorted(periodic_runs.find_runs(periodic_runs.with_planted_runs(docs)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in out] == [
        (1, 0, []), (1, 0, []), (2, 30, [(0, 30, 6)]), (2, 30, [(0, 30, 6)]), (3, 20, [(0, 20, 1)]), (4, 3000, [(0, 3000, 1)]), (None, 0, []), (None, 1, []),
    ]
    assert [r.collapsed for r in out[2:5]] == ["a b c d e f"] * 2 + ["x\u00a0y"]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
