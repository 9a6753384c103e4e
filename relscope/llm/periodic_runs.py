"""Periodic runs of words: every maximal stretch of a text that repeats itself with some period, and the text without the
repetitions.

Short periods are found by comparing the words of a batch with themselves at each lag. Longer ones are found by scale, for
periods from q to below 2q: every window of q words keeps its smallest hash of q/2 words (the leftmost of equal ones). In a
run whose period is of this scale the first window and the one a period later have the same words, so their minima lie a
period apart, and pairs of equal minima at such distances are all the seeds needed. A seed is extended on the words
themselves, both ways, so hashes that collide cost time and never a run.

Equal minima that lie in one run already found, of a period p of at most a quarter of the scale, are p words apart. They are
kept as one progression: pairs within it only find that run again, and of two progressions one pair a distance is enough. So
a text of one word repeated does not have all its pairs tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, text_or_empty
from .words import split_words

#: Periods up to SHORT are found by lag; a run has LEAST words or more.
SHORT, LEAST = 24, 12
BASE = 0x9E3779B97F4A7C15 | 1
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _smallest(starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) in order, of equal stretches only the one with the smallest period."""
    order = np.lexsort((periods, ends, starts))
    rows = np.stack([starts, ends, periods], 1)[order]
    new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]
    return rows[new]


def _by_lag(line: np.ndarray, q: int) -> np.ndarray:
    """All stretches of 2q words or more in which words q apart are equal."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], line[q:] == line[:-q], [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    long = last - first >= q
    return np.stack([first[long], last[long] + q, np.full(long.sum(), q)], 1)


def _gram_hashes(line: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` words in a row: differences of running sums of word hashes times powers of a base."""
    powers = np.full(len(line), BASE, np.uint64)
    powers[0] = 1
    back = np.full(len(line), pow(BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    sums = np.append(np.uint64(0), np.cumsum(_mix(line.astype(np.uint64)) * np.multiply.accumulate(powers)))
    return _mix((sums[size:] - sums[:-size]) * np.multiply.accumulate(back)[: len(line) - size + 1])


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` keys in a row, by running minima from both ends of blocks."""
    blocks = np.pad(keys, (0, -len(keys) % width), constant_values=np.iinfo(keys.dtype).max).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: len(keys) - width + 1], ahead[width - 1 : len(keys)])


def _steps(pairs: np.ndarray, from_: np.ndarray, step: np.ndarray, count: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, k) for all 0 <= k < count with q <= from_ + k * step < 2q."""
    low = np.maximum(0, -(-(q - from_) // step))
    high = np.minimum(count, -(-(2 * q - from_) // step))
    n = np.maximum(0, high - low)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return np.repeat(pairs, n), k


def _seeds(line: np.ndarray, owner: np.ndarray, q: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of pairs of equal minima at distances from q to below 2q, by distance, then place."""
    gram = q // 2
    hashes = _gram_hashes(line, gram)
    bits = np.uint64(int(len(line)).bit_length())
    places = np.arange(len(hashes), dtype=np.uint64)
    least = _window_minima((hashes >> bits << bits) | places, q - gram + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])]
    at = at[np.lexsort((at, owner[at], hashes[at]))]
    alike = (hashes[at[1:]] == hashes[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
    near = alike & (at[1:] - at[:-1] < 2 * q)
    use = np.append(near, False) | np.append(False, near)
    group = np.append(0, np.cumsum(~alike))[use]
    at = at[use]
    if not len(at):
        return at, at
    # equal minima within one known run of a short period are one progression
    calm = known[(known[:, 2] * 2 <= gram) & (known[:, 1] - known[:, 0] >= gram)]
    run = np.searchsorted(calm[:, 0], at, "right") - 1
    inside = run >= 0
    inside[inside] = at[inside] + gram <= calm[run[inside], 1]
    period = np.where(inside, calm[run, 2], 1) if len(calm) else np.ones(len(at), np.int64)
    run = np.where(inside, run, -1)
    tied = (group[1:] == group[:-1]) & (run[1:] == run[:-1]) & inside[1:] & ((at[1:] - at[:-1]) % period[1:] == 0)
    head = np.flatnonzero(np.append(True, ~tied))
    tail = np.append(head[1:], len(at)) - 1
    first, last, step, group = at[head], at[tail], period[head], group[head]
    count = (last - first) // step + 1
    found, lag, i = [], 1, np.arange(len(head))
    while True:
        i = i[i + lag < len(head)]
        i = i[(group[i] == group[np.minimum(i + lag, len(head) - 1)])]
        i = i[first[i + lag] - last[i] < 2 * q]
        if not len(i):
            break
        j = i + lag
        a, k = _steps(np.arange(len(i)), first[j] - last[i], step[j], count[j], q)
        found.append((last[i][a], first[j][a] - last[i][a] + k * step[j][a]))
        a, k = _steps(np.arange(len(i)), last[j] - last[i], step[i], count[i], q)
        found.append((last[i][a] - k * step[i][a], last[j][a] - last[i][a] + k * step[i][a]))
        lag += 1
    if not found:
        return at[:0], at[:0]
    place, distance = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, distance))
    return place[order], distance[order]


def _stretch(line: np.ndarray, place: int, d: int) -> tuple[int, int]:
    """The longest stretch around `place` in which each word equals the one d behind it."""
    first, step = place, 64
    while first:
        low = max(0, first - step)
        other = np.flatnonzero(line[low:first] != line[low + d : first + d])
        if len(other):
            first = low + int(other[-1]) + 1
            break
        first, step = low, step * 4
    last, step, end = place, 64, len(line) - d
    while last < end:
        high = min(end, last + step)
        other = np.flatnonzero(line[last:high] != line[last + d : high + d])
        if len(other):
            last += int(other[0])
            break
        last, step = high, step * 4
    return first, last


def _by_minima(line: np.ndarray, owner: np.ndarray, q: int, known: np.ndarray) -> np.ndarray:
    """All stretches with a smallest period from q to below 2q, given those of smaller ones."""
    out, before, reach = [], -1, 0
    for place, d in zip(*(x.tolist() for x in _seeds(line, owner, q, known))):
        if d == before and place < reach:
            continue
        first, reach = _stretch(line, place, d)
        before = d
        if reach - first >= d:
            out.append((first, reach + d, d))
    return np.array(out, np.int64).reshape(-1, 3)


def runs_of(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in this order, of texts with counts[i] of the words each.

    A run is a stretch of at least LEAST words and two periods that has no smaller period and cannot be extended.
    """
    texts, runs = np.arange(len(counts)), np.zeros((0, 3), np.int64)
    ends = np.cumsum(counts)
    starts = ends - counts

    def joined(chosen):
        """The words of the chosen texts with a word of its own behind each text; its text and place for every word."""
        size = counts[chosen] + 1
        owner = np.repeat(chosen, size)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        behind = inner == counts[owner]
        line = np.where(behind, -1 - owner, codes[np.where(behind, 0, starts[owner] + inner)] if len(codes) else 0)
        return line, owner, inner

    def placed(rows, owner, inner):
        """Rows of a line as rows of all words, where texts stand one behind the other with a word between."""
        base = starts[owner[rows[:, 0]]] + owner[rows[:, 0]] + inner[rows[:, 0]] if len(rows) else rows[:, 0]
        return np.stack([base, base + rows[:, 1] - rows[:, 0], rows[:, 2]], 1)

    longest = int(counts.max(initial=0))
    line, owner, inner = joined(texts)
    narrow = line.astype(np.int32)
    for q in range(1, min(SHORT, longest // 2) + 1):
        runs = np.concatenate([runs, _by_lag(narrow, q)])
    runs, q = _smallest(*runs.T), SHORT + 1
    while 2 * q <= longest:
        chosen = texts[counts >= 2 * q]
        line, owner, inner = joined(chosen)
        # what is known, in the places of this line
        text = np.searchsorted(starts + texts, runs[:, 0], "right") - 1
        there = counts[text] >= 2 * q
        size = counts[chosen] + 1
        shift = np.zeros(len(counts), np.int64)
        shift[chosen] = np.cumsum(size) - size - starts[chosen] - chosen
        known = runs[there] + np.stack([shift[text[there]], shift[text[there]], np.zeros(there.sum(), np.int64)], 1)
        new = placed(_by_minima(line, owner, q, known), owner, inner)
        runs = _smallest(*np.concatenate([runs, new]).T)
        q *= 2
    runs = runs[runs[:, 1] - runs[:, 0] >= LEAST]
    text = np.searchsorted(starts + texts, runs[:, 0], "right") - 1
    out = np.stack([text, runs[:, 0] - starts[text] - text, runs[:, 1] - runs[:, 0], runs[:, 2]], 1) if len(runs) else np.zeros((0, 4), np.int64)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def repeated(runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A mark for every word that a run contains behind its first period."""
    begin = np.cumsum(counts) - counts
    change = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(change, begin[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, begin[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(change[:-1]) > 0


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs (doc_id, text): its periodic runs by start, then period, and
    its words joined by one blank without those that a run repeats.

    Words are what ASCII white space separates, numbered from 0. Null, empty and white texts have no words, no runs and an
    empty collapsed text. Rows are independent: ids may be null or repeated, and an empty table gives an empty result. The
    work of a text grows with its length times the logarithm of it; a task holds some 100 bytes for each word of a batch,
    which is bounded by bytes, or of one text that is longer than that. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, distinct, counts = split_words(batch.column("text").cast(pa.large_string()))
            counts = counts.astype(np.int64)
            found = runs_of(codes, counts)
            kept = ~repeated(found, counts)
            words = [distinct[c] for c in codes[kept].tolist()]
            ends = np.cumsum(np.add.reduceat(np.append(kept, False), np.append(0, np.cumsum(counts))[:-1]) * (counts > 0)) if len(counts) else counts
            collapsed, first = [], 0
            for end in ends.tolist():
                collapsed.append(" ".join(words[first:end]))
                first = end
            offsets = np.append(0, np.cumsum(np.bincount(found[:, 0], minlength=len(counts)))).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(lean(run), RUNS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a run planted in every tenth text that has words: with h the crc32 of the decimal id and g its
    tenth, the words from a = g % n on repeat with period 1 + (n - a) / (3 + g % 8). Null ids plant nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    planted = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
