import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from relscope.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(PATH)
    rows = queries.op8_best_fit_packing(spark, sf).collect()
    n = check_layout(rows, 4096)
    own = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    total = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*tok.encode(d.text, add_special_tokens=False).ids, 1]
        total += len(ids)
        got = sorted(own.pop(d.doc_id), key=lambda r: r.piece)
        cuts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert [(r.piece, r.start, r.length) for r in got] == [(k, k * 4096, len(c)) for k, c in enumerate(cuts)]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cuts]
    assert not own
    assert -(-total // 4096) <= n <= -(-total // 4096) * 1.03 + 1


def test_odd_texts():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    parts = [" ", "\n", "\t", "the ", "Hello", "É", "é", "中", "Σ", "<|endoftext|>", "<|", "12", "'s", "'LL", "\x00", "\x1c", " ", " ", "İ", "́", "!!!", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    ids, sizes = packing.token_ids(PATH, texts)
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert ids[at : at + n].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
        at += n


def test_another_tokenizer_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["the cat  sat", "", " Hello, World! ", "a\n\nb", "é 中 12's"]
    ids, sizes = packing.token_ids(path, texts)
    assert not packing._cache[path].apart and packing.WordIds(PATH).apart
    assert ids.tolist() == [i for t in texts for i in tok.encode(t, add_special_tokens=False).ids] and len(sizes) == len(texts)


def test_ids_are_kept_on_demand(spark):
    tok = Tokenizer.from_file(PATH)
    rows = packing.pieces(spark.createDataFrame([(1, "a b c d e"), (2, None)], "doc_id long, text string"), PATH, capacity=4).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in rows}
    ids = [*tok.encode("a b c d e").ids, 1]
    assert got == {(1, 0): (0, 4, ids[:4]), (1, 1): (4, 2, ids[4:]), (2, 0): (0, 1, [1])}


def test_plan_is_best_fit():
    rng = random.Random(7)
    for capacity in (5, 17, 64):
        hist = {}
        for _ in range(500):
            n = rng.randint(1, capacity)
            hist[n] = hist.get(n, 0) + 1
        rooms = []  # best fit, longest first, one by one
        for length in sorted((k for k, n in hist.items() for _ in range(n)), reverse=True):
            at = min((i for i, r in enumerate(rooms) if r >= length), key=lambda i: rooms[i], default=None)
            if at is None:
                rooms.append(capacity - length)
            else:
                rooms[at] -= length
        slots = packing.plan_slots(hist, capacity)
        assert max(first + n for _, _, n, first, _ in slots) == len(rooms)
        for k, n in hist.items():
            assert sorted(r for length, rank, m, _, _ in slots if length == k for r in range(rank, rank + m)) == list(range(n))


def test_nulls_repeats_hot_length_and_empty(spark):
    docs = spark.createDataFrame([(i, "a b" if i % 3 else None, 1) for i in range(9000)] + [(1, "a b", 1), (None, "c", 1), (-1, "long " * 9000, 1)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, PATH, capacity=512).collect()
    check_layout(rows, 512)
    assert len(rows) == 9002 + -(-9001 // 512)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
