import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from relscope.llm import quality, queries

SF = "/root/testdata/sf0.1"


def running(text):
    """The UTF-16 units of a text behind its start marks: words with one blank behind each, digits as one digit."""
    shown = "".join("0" if c in "0123456789" else c for c in "".join(f" {w}" for w in text.split()) + " ")
    raw = shown.encode("utf-16-le")
    return "\n\n" + "".join(chr(raw[i] | raw[i + 1] << 8) for i in range(0, len(raw), 2))


def brute_model(texts):
    """Interpolated modified Kneser-Ney over running text, written down directly: a function from gram to probability."""
    top = Counter()
    for t in filter(str.split, texts):
        s = running(t)
        for i in range(3, len(s)):
            top[s[i - 3 : i + 1]] += 1
    levels = {4: top}
    for k in (3, 2, 1):
        low = Counter()
        for g, n in levels[k + 1].items():
            low[g[1:]] += n if g[1] == "\n" else 1
        levels[k] = low
    discounts = {}
    for k, c in levels.items():
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            discounts[k] = [0.5, 0.75, 0.9]
        else:
            y = n1 / (n1 + 2 * n2)
            raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            discounts[k] = [min(max(d, 0.05), t) for d, t in zip(raw, (0.95, 1.9, 2.9))]
    by = {k: defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            by[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(levels[1]) + 1)
        counts = by[k].get(g[:-1])
        if not counts:
            return p(g[1:])
        d, total = discounts[k], sum(counts)
        n = levels[k].get(g, 0)
        own = (n - d[min(n, 3) - 1]) / total if n else 0
        return own + sum(d[min(c, 3) - 1] for c in counts) / total * p(g[1:])

    p.units = set(levels[1])
    return p


def test_same_as_brute_force(spark):
    """Whatever share of the n-grams is sent to the tasks, documents get the whole model's probabilities."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 7))) for _ in range(400)]
    corpus = [" ".join(words[i::7]) for i in range(7)] + ["a 10 b", "x\U0001f600y \U00010348 a\x02b"]
    texts = spark.createDataFrame([(t,) for t in corpus] + [(None,), ("",)], "text string")
    p = brute_model(corpus)
    docs = [" ".join(words[i : i + 3]) for i in range(0, 30, 3)] + ["zzz abzq", "é", "zzz " * 3000, "", None, "12 a1", "abc 12 abc\nabc", "a b c a b", "\U0001f601 \U0001f600y", "a\x02b \x03"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sizes = {}
    for rows in (1, 400, 1 << 18):
        model = quality.train(texts, table_rows=rows)
        sizes[rows] = len(model.hot.keys)
        got = {r.doc_id: r for r in quality.perplexities(frame, model).collect()}
        assert len(got) == len(docs)
        for i, text in enumerate(docs):
            s = running(text) if (text or "").split() else ""
            want = sum(math.log(p(s[k - 3 : k + 1])) for k in range(3, len(s)))
            assert got[i].size == max(0, len(s) - 3)
            assert abs(got[i].log_p - want) <= 1e-9 * max(1, abs(want))
    assert sizes[1] <= 1 and 0 < sizes[400] <= 400 < sizes[1 << 18]
    for before in ("ab", "abc", "b a", "zz"):
        assert abs(sum(p(before + c) for c in {g[-1] for g in p.units}) + p(before + "?") - 1) < 1e-9


def test_no_trusted_text(spark):
    model = quality.train(spark.createDataFrame([(None,)], "text string"))
    got = quality.perplexities(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first()
    assert got.size == 4 and got.log_p == 0.0


def test_labelled_documents(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op2_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    good = [r.kept for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 1]
    bad = [r.kept for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def test_limit_nears_the_quantile(spark):
    """What is added to the quantile comes from the number of guides and goes to 0 as they grow."""
    true, over = float(np.log(200)), {}
    for n in (100, 10_000, 1_000_000):
        x = spark.range(n).select((-F.log1p(-(F.col("id") + 0.5) / n)).alias("x"))
        over[n] = x.agg(quality.upper_quantile("x", 0.995, 2.0)).first()[0] - true
        assert 0 < over[n] <= 3 * math.sqrt(199 / n)
    assert over[100] > 5 * over[10_000] > 25 * over[1_000_000]


def test_odd_rows(spark):
    good = "the cat sat on the mat and the dog ran to the man"
    docs = [(i, good, "en", 1) for i in range(60)]
    docs += [(100, None, "en", 1), (101, "", "en", 1), (102, "12 34", "en", 1), (103, "XQZ@# KJJ%% QQQ!! " * 20, "en", 1), (104, good, None, 1), (105, good, "xx", 1), (None, good, "en", 1), (200, "ZZXQ ##%% " * 40, "en", 1), (200, good, "en", 1), (106, "the " * 50_000, "en", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(103, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.text_key): r.kept for r in quality.classify(frame, labels).collect()}
    assert len(got) == 70
    verdict = {}
    for (doc, _), kept in got.items():
        verdict.setdefault(doc, []).append(kept)
    assert verdict[100] == verdict[101] == verdict[103] == [False]
    assert verdict[104] == verdict[105] == verdict[None] == [True]
    assert sorted(verdict[200]) == [False, True]
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns
    assert kept.where("doc_id = 200").count() == 1 and kept.where("doc_id is null").count() == 1
    assert quality.classify(frame.limit(0), labels).count() == 0
    assert quality.classify(frame.where("doc_id = 5"), labels.limit(0)).first().kept


def test_verdict_against_brute_force(spark):
    """Means, limits by language or by all below `least`, the characters added to short texts, and what is kept."""
    rng = random.Random(11)
    sounds = {"xx": "ab ba abba baab aab", "yy": "cd dc cddc dccd ccd", "zz": "ef fe effe", None: "ab cd ef"}
    docs = []
    for i in range(260):
        lang = ["xx", "xx", "yy", "yy", "yy", "zz", None][i % 7]
        words = [rng.choice(sounds[lang].split()) for _ in range(rng.randint(1, 25))]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 12)))
        docs.append((i, " ".join(words), lang))
    docs += [(300, None, "xx"), (301, "", None), (302, " \n", "yy"), (303, "ab", "new"), (5, "hhh ggg", "xx"), (None, "ab ba", "xx"), (None, "gg hh gh", None)]
    labels = [(i, 1 if i % 5 else 0, 0) for i in range(0, 260, 1) if i % 4] + [(300, 1, 0), (None, 1, 0), (7, None, 0)]
    quantile, folds, errors, prior, least = 0.8, 2, 1.0, 30, 20
    frames = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(*frames, quantile, folds, errors, prior, least, 50).collect()
    assert len(got) == len(docs)

    trusted = {i for i, q, _ in labels if q == 1 and i is not None}
    sets = {i: zlib.crc32(str(i).encode()) % folds == 0 for i, _, _ in docs if i is not None}
    p = brute_model([t or "" for i, t, _ in docs if i in trusted and not sets[i]])
    rows = []
    for i, text, lang in docs:
        s = running(text) if (text or "").split() else ""
        rows.append([i, lang, sum(math.log(p(s[k - 3 : k + 1])) for k in range(3, len(s))), max(0, len(s) - 3)])
    judges = [r for r in rows if r[0] in trusted and sets[r[0]] and r[3]]

    def mean(group):
        return -sum(r[2] for r in group) / sum(r[3] for r in group)

    by = {g: [r for r in judges if r[1] == g] for g in {r[1] for r in judges} - {None}}
    by = {g: v for g, v in by.items() if len(v) >= least}
    assert set(by) == {"xx", "yy"}
    means = {g: mean(v) for g, v in by.items()}
    measure = {id(r): (means.get(r[1], mean(judges)) * prior - r[2]) / (r[3] + prior) for r in rows}

    def limit(group):
        values = sorted(measure[id(r)] for r in group)
        top, middle = (values[math.ceil(q * len(values)) - 1] for q in (quantile, 0.5))
        scale = (top - middle) / -math.log(2 * (1 - quantile))
        return top + errors * scale * math.sqrt(quantile / (1 - quantile) / len(values))

    limits, other = {g: limit(v) for g, v in by.items()}, limit(judges)
    want = sorted((r[0] is None, r[0] or 0, str(r[1]), r[3] > 0 and round(math.exp(-r[2] / r[3]), 6), round(math.exp(limits.get(r[1], other)), 6), r[3] > 0 and measure[id(r)] <= limits.get(r[1], other)) for r in rows)
    found = sorted((r.doc_id is None, r.doc_id or 0, str(r.lang), r.perplexity is not None and round(r.perplexity, 6), round(r.threshold, 6), r.kept) for r in got)
    assert found == want
    kept = [r[-1] for r in want]
    assert 0.1 < sum(kept) / len(kept) < 0.95
