import zlib

import numpy as np
import pytest

from relscope.llm import language_id as li
from relscope.llm import queries
from relscope.llm.viterbi import viterbi

SF = "/root/testdata/sf0.01"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 6, 5)
        scores, moves = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
        for m in (moves, 0.7):
            table = m if isinstance(m, np.ndarray) else -0.7 * (1 - np.eye(3))
            got, at = viterbi(scores, lengths, m), 0
            for n in lengths:
                def value(path):
                    return sum(scores[at + i, x] for i, x in enumerate(path)) + sum(table[a, b] for a, b in zip(path, path[1:]))

                if n:
                    best = max(value(p) for p in np.ndindex(*[3] * n))
                    assert abs(value(got[at : at + n]) - best) < 1e-9
                at += n


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


MASK = 2**64 - 1


def brute_grams(word):
    """The buckets of one word's n-grams by plain integers: of one to three characters, the word's ends as blanks."""
    text = [ord(c) for c in f" {word} "]
    out = [(c * 0x9E3779B97F4A7C15) & MASK for c in text[1:-1]]
    for a, b in zip(text, text[1:]):
        out.append((((((a * 0x9E3779B97F4A7C15) & MASK) ^ 0xABCD) * 0xC2B2AE3D27D4EB4F) + b * 0x165667B19E3779F9) & MASK)
    for i in range(len(text) - 2):
        two = (((((text[i] * 0x9E3779B97F4A7C15) & MASK) ^ 0xABCD) * 0xC2B2AE3D27D4EB4F) + text[i + 1] * 0x165667B19E3779F9) & MASK
        out.append((two * 0x27D4EB2F165667C5 + text[i + 2] * 0x9E3779B97F4A7C15 + 7) & MASK)
    return [(h >> 40) % li.BUCKETS for h in out]


def letters(word):
    return "".join(c for c in word if c.isalpha()).lower()


def test_counts_scores_and_labels_by_brute_force(spark):
    rng = np.random.default_rng(6)
    make = lambda alphabet: ["".join(rng.choice(list(alphabet), rng.integers(1, 6))) for _ in range(40)]
    words = {"aa": make("abcde1"), "bb": make("cdefg-"), "cc": make("жзик"), "dd": make("abcde1")}
    rows = [(lang, " ".join(rng.choice(own, 6))) for lang, own in words.items() for _ in range(12)]
    counts = {}
    for lang, text in rows:
        for w in filter(None, map(letters, text.split())):
            for b in brute_grams(w):
                counts[lang, b] = counts.get((lang, b), 0) + 1
            slot = li.BUCKETS + li.NAMES.index("cyrillic" if "а" <= w[0] <= "я" else "latin")
            counts[lang, slot] = counts.get((lang, slot), 0) + len(w)
    made = li.train(spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string"))
    assert {(r.lang, r.slot): r.n for r in made.itertuples()} == counts

    langs = sorted(words)
    total = {x: sum(counts.get((x, b), 0) + 0.5 for b in range(li.BUCKETS)) for x in langs}
    cyrillic = li.BUCKETS + li.NAMES.index("cyrillic")

    def scores(w):
        if not w:
            return [0.0] * len(langs)
        fits = [((x, cyrillic) in counts) == ("а" <= w[0] <= "я") for x in langs]
        sums = [sum(np.log((counts.get((x, b), 0) + 0.5) / total[x]) for b in brute_grams(w)) / 3 if f or not any(fits) else -np.inf for x, f in zip(langs, fits)]
        return [max(s - max(sums), -8.0) for s in sums]

    texts = [" ".join(rng.choice(sum(words.values(), []), rng.integers(1, 6))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in li.predict(docs, li.Model(made), penalty=1.0).collect():
        own = [letters(w) for w in texts[r.doc_id].split()]
        rows_ = [scores(w) for w in own]

        def value(path):
            return sum(s[x] for s, x in zip(rows_, path)) - sum(a != b for a, b in zip(path, path[1:]))

        got = [langs.index(s.lang) for s in r.spans for _ in range(s.words)]
        if not any(own):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
            continue
        assert len(got) == len(own) and abs(value(got) - max(map(value, np.ndindex(*[len(langs)] * len(own))))) < 1e-9
        mass = [sum(len(w) for w, x in zip(own, got) if x == k) for k in range(len(langs))]
        assert r.lang_pred == langs[mass.index(max(mass))] and abs(r.score - max(mass) / sum(mass)) < 1e-12


def test_too_many_languages(spark):
    docs = spark.createDataFrame([("one", "aa"), ("two", "bb"), ("three", "cc"), ("x", None)], "text string, lang string")
    assert set(li.train(docs, most=3)["lang"]) == {"aa", "bb", "cc"}
    with pytest.raises(ValueError):
        li.train(docs, most=2)


def test_equal_languages(spark):
    docs = spark.createDataFrame([("one two three", "yy"), ("one two three", "xx")], "text string, lang string")
    got = li.predict(spark.createDataFrame([(1, "two one")], "doc_id long, text string"), li.Model(li.train(docs))).first()
    assert (got.lang_pred, got.score) == ("xx", 1.0)


def test_spans_scripts_and_odd_rows(spark):
    en, ru = "the quick brown fox jumps over the lazy dog and the cat", "быстрая лиса прыгает через ленивую собаку и кота снова"
    docs = spark.createDataFrame([(i, t, lang) for i in range(20) for t, lang in ((en, "en"), (ru, "ru"))] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = li.Model(li.train(docs))
    mixed = spark.createDataFrame([(1, f"{en} {en} {ru}", "a"), (2, None, "a"), (3, "12 34 !!", "a"), (4, "", "a"), (None, en, "a"), (1, "лиса " * 30_000, "a")], "doc_id long, text string, score string")
    got = {(r.doc_id, r.lang_pred): r for r in li.predict(mixed, model).collect()}
    assert set(got) == {(1, "en"), (1, "ru"), (2, "und"), (3, "und"), (4, "und"), (None, "en")}
    spans = next(r.spans for r in li.predict(mixed.where("length(text) between 100 and 200"), model).collect())
    assert [s.lang for s in spans] == ["en", "ru"] and spans[1].first == 2 * len(en.split())
    nothing = li.Model(li.train(docs.limit(0)))
    assert [r.lang_pred for r in li.predict(mixed.limit(1), nothing).collect()] == ["und"]
    assert li.predict(mixed.limit(0), model).count() == 0
