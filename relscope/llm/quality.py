"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over the characters of running text, four at a time and across words: words are separated by one blank
each, digits count as one digit, and the first word stands behind start marks. N-grams are packed exactly into 64 bits
(16 for each UTF-16 unit), so counting, continuation counts, context totals and the interpolation of each order with
the next are Spark group-bys and joins sharded by packed n-gram, over all trusted text. (Orders: Chen and Goodman, 1999:
three discounts an order, lower orders from the number of distinct characters before them; n-grams behind a start mark,
which nothing can precede, keep their plain counts.)

Documents meet the probabilities by sharded joins as well. N-grams that make up 1/table_rows or more of the trusted
text, of which there can be no more than table_rows, would be hot keys of such a join; they alone are sent to the tasks.
Every other n-gram of a document, known or not, is asked for once a document: distinct n-grams are looked up in the
joined counts, order by order, and their values are joined back and summed by document. So nothing is left out of the
model, which grows with the trusted text, and the result is the same for any table_rows.

Thresholds are quantiles of the perplexity of trusted documents that the model was not trained on, by language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, join_groups, lean, packed, scratch, sieved, slices
from .words import gather, per_text, split_words

ORDER = 4
#: Marks the start of a text; no word holds a line feed.
START, BLANK = 0x0A, 0x20
FLUSH = 1 << 19
#: Texts whose arrays are held at once: they stay in a Python worker beside what earlier stages left there.
TEXTS = 100
#: Trusted ids up to this number (16 MB) are broadcast; beyond it they meet the documents in a shuffle.
BROADCAST_IDS = 1 << 20


@dataclass
class Grams:
    """The packed n-grams of a batch: those inside of each distinct word, and those at each distinct seam between the
    last two units of a word and the first two of the next, the blank behind a word counting as its last unit."""

    counts: np.ndarray  # words of each text
    codes: np.ndarray  # distinct word of each word
    inside: np.ndarray
    word: np.ndarray  # distinct word of each inside n-gram
    words: int
    seams: np.ndarray  # distinct seam of each word
    across: np.ndarray  # two n-grams a seam

    @staticmethod
    def of(texts: list) -> Grams:
        codes, distinct, counts = split_words(texts)
        if not distinct:
            none = np.zeros(0, np.uint64)
            return Grams(counts, codes, none, none.astype(np.int64), 0, codes, none.reshape(0, 2))
        units = np.frombuffer(f" {' '.join(distinct)} ".encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
        units[(units >= 0x30) & (units <= 0x39)] = 0x30
        blanks = np.flatnonzero(units == BLANK)
        gram = _packed(units[:-3], units[1:-2], units[2:-1], units[3:])
        word = np.cumsum(units == BLANK)[2:-1] - 1  # of the unit that ends each n-gram; the blank behind a word is its own
        whole = np.arange(3, len(units)) - blanks[word] >= 3
        first, last = blanks[:-1], blanks[1:]
        after = np.append(units, np.uint64(BLANK))  # an empty word, which no text holds, may stand last
        head, tail = _packed(after[first + 1], after[first + 2]), _packed(units[last - 2], units[last - 1])
        before = np.empty(len(codes), np.uint64)
        before[1:] = tail[codes[:-1]]
        before[(np.cumsum(counts) - counts)[counts > 0]] = START << 16 | START
        seam, seams = np.unique(before << np.uint64(32) | head[codes], return_inverse=True)
        t1, t2, u1, u2 = (seam >> np.uint64(k) & np.uint64(0xFFFF) for k in (48, 32, 16, 0))
        blank = np.full(len(seam), BLANK, np.uint64)
        return Grams(counts, codes, gram[whole], word[whole], len(distinct), seams, np.stack([_packed(t1, t2, blank, u1), _packed(t2, blank, u1, u2)], 1))


def _packed(*units: np.ndarray) -> np.ndarray:
    out = units[0]
    for u in units[1:]:
        out = out << np.uint64(16) | u
    return out


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) over all rows of texts (text): packed n-grams of the highest order and their plain counts."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            gram, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            return gram, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for pdf in batches:
            for part in slices(pdf, TEXTS):
                g = Grams.of(part["text"].tolist())
                often, across = np.bincount(g.codes, minlength=g.words), np.bincount(g.seams, minlength=len(g.across))
                some, at = np.unique(np.concatenate([g.inside, g.across.ravel()]), return_inverse=True)
                held.append((some, np.bincount(at, np.concatenate([often[g.word], across.repeat(2)]))))
                size += len(some)
                if size > FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield pd.DataFrame({"gram": held[0][0].view(np.int64), "n": held[0][1]})
                        held, size = [], 0
        if held:
            gram, n = merged()
            yield pd.DataFrame({"gram": gram.view(np.int64), "n": n})

    return texts.mapInPandas(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _context(gram: str = "gram") -> Column:
    return F.shiftrightunsigned(gram, 16)


def _shorter(grams: DataFrame, order: int) -> DataFrame:
    """(gram, n) one order down: distinct continuations, or plain counts behind a start mark."""
    tail = F.col("gram").bitwiseAND((1 << 16 * (order - 1)) - 1)
    starts = F.shiftrightunsigned(tail, 16 * (order - 2)).bitwiseAND(0xFFFF) == START
    n = F.when(starts, F.col("n")).otherwise(F.lit(1)) if order > 2 else F.lit(1)
    return grams.select(tail.alias("gram"), n.cast("long").alias("n")).groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    row = grams.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), top) for d, top in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.9), (3 - 4 * y * n4 / n3, 2.9))]


def _level(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, n, context, own) and (context, total, rest): the discounted share of each n-gram in its context, and the
    share of the context that is left to the next order."""
    d = _discounts(grams)
    discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    keyed = grams.withColumn("context", _context())
    contexts = keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("mass")).withColumn("rest", F.col("mass") / F.col("total"))
    return keyed.join(contexts, "context").select("gram", "n", "context", ((F.col("n") - discount) / F.col("total")).alias("own"), "rest"), contexts.select("context", "total", "rest")


class Hot:
    """Sorted packed n-grams and their log probabilities."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def look(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability or 0, whether the n-gram is here)."""
        if not len(self.keys):
            return np.zeros(len(gram)), np.zeros(len(gram), bool)
        at = np.minimum(np.searchsorted(self.keys, gram), len(self.keys) - 1)
        known = self.keys[at] == gram
        return np.where(known, self.values[at], 0.0), known


@dataclass
class Model:
    """For each order the probabilities (gram, p) and what contexts leave to the next order (context, rest), both whole
    and sharded; the hot n-grams of the highest order; the log probability of a character never seen."""

    levels: list[tuple[DataFrame, DataFrame]]
    hot: Hot
    floor: float

    def resolve(self, wanted: DataFrame, order: int = ORDER) -> DataFrame:
        """(gram, p) for every row of wanted (gram), which must be distinct. At most 2^16 of them share a context or a
        shorter n-gram, so no join here has a key without a bound."""
        if order == 0:
            return wanted.select("gram", F.lit(float(np.exp(self.floor))).alias("p"))
        known, contexts = self.levels[order - 1]
        looked = cut(wanted.join(known, "gram", "left"))
        tail = F.col("gram").bitwiseAND((1 << 16 * (order - 1)) - 1)
        missed = looked.where("p is null").select("gram", tail.alias("tail"), _context().alias("context"))
        lower = self.resolve(missed.select(F.col("tail").alias("gram")).distinct(), order - 1)
        backed = missed.join(contexts, "context", "left").join(lower.select(F.col("gram").alias("tail"), "p"), "tail")
        return looked.where("p is not null").unionByName(backed.select("gram", (F.coalesce("rest", F.lit(1.0)) * F.col("p")).alias("p")))


def train(texts: DataFrame, table_rows: int = 1 << 18) -> Model:
    """The model of all rows of texts (text). Null and empty texts teach nothing; without any text the model gives
    every character the same probability."""
    bound_batches(texts.sparkSession)
    grams = {ORDER: cut(count_grams(texts.where("length(text) > 0")))}
    for order in range(ORDER, 1, -1):
        grams[order - 1] = cut(_shorter(grams[order], order))
    floor = -float(np.log(grams[1].count() + 1))
    levels, below = [], None
    for order in range(1, ORDER + 1):
        shares, contexts = _level(grams[order])
        if below is None:
            full = shares.withColumn("p", F.col("own") + F.col("rest") * float(np.exp(floor)))
        else:
            tail = F.col("gram").bitwiseAND((1 << 16 * (order - 1)) - 1)
            full = shares.withColumn("tail", tail).join(below, "tail").withColumn("p", F.col("own") + F.col("rest") * F.col("lower"))
        full = cut(full.select("gram", "n", "p"))
        below = full.select(F.col("gram").alias("tail"), F.col("p").alias("lower"))
        levels.append((full.select("gram", "p"), cut(contexts.select("context", "rest"))))
    total = full.agg(F.sum("n")).first()[0] or 0
    hot = full.where(F.col("n") >= total / table_rows).select("gram", F.ln("p").alias("v")).toPandas()
    return Model(levels, Hot(hot["gram"].to_numpy(np.int64).view(np.uint64), hot["v"].to_numpy(np.float64)), floor)


def score_batch(texts: list, hot: Hot) -> tuple[np.ndarray, np.ndarray, list, list]:
    """For each text: log probability of its hot n-grams, number of units and word ends, and the other n-grams with how
    often each occurs."""
    g = Grams.of(texts)
    none = [np.zeros(0, np.int64)] * len(texts)
    if not g.words:
        return np.zeros(len(texts)), np.zeros(len(texts), np.int64), none, none
    some, at = np.unique(np.concatenate([g.inside, g.across.ravel()]), return_inverse=True)
    logs, known = hot.look(some)
    inside, across = at[: len(g.inside)], at[len(g.inside) :].reshape(-1, 2)
    value = np.bincount(g.word, logs[inside], g.words)[g.codes] + logs[across].sum(1)[g.seams]
    size = np.bincount(g.word, minlength=g.words)[g.codes] + 2
    text_of = np.repeat(np.arange(len(texts)), g.counts)
    keys, often = [], []
    # of distinct words (and seams) with other n-grams: how often a text has them, times what they hold
    for owner, grams, n, of in (g.word, inside, g.words, g.codes), (np.arange(len(across)).repeat(2), across.ravel(), len(across), g.seams):
        other = np.flatnonzero(~known[grams])
        asked, holds = grams[other], np.bincount(owner[other], minlength=n)
        open_ = holds[of] > 0
        item, times = np.unique(text_of[open_] * n + of[open_], return_counts=True)
        flat, each = gather(asked, np.cumsum(holds) - holds, holds, item % n)
        keys.append(np.repeat(item // n, each) * len(some) + flat)
        often.append(np.repeat(times, each))
    keys, back = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.bincount(back, np.concatenate(often), len(keys)).astype(np.int64)
    ends = np.searchsorted(keys // len(some), np.arange(1, len(texts)))
    return per_text(value, g.counts), per_text(size, g.counts).astype(np.int64), np.split(some[keys % len(some)].view(np.int64), ends), np.split(times, ends)


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) with the text's place taken by log_p and size (UTF-16 units of its words and their ends). No
    column of docs may be named row_no, gram or times."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model.hot)
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        hot, no = sent.value, TaskContext.get().partitionId() << 40
        for pdf in batches:
            for part in slices(pdf, TEXTS):
                log_p, size, gram, times = score_batch(part["text"].tolist(), hot)
                yield part.drop(columns="text").assign(row_no=np.arange(no, no + len(part)), log_p=log_p, size=size, gram=gram, times=times)
                no += len(part)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    path = scratch(spark, "perplexities")
    docs.mapInPandas(lean(run), f"{fields}, row_no long, log_p double, size long, gram array<long>, times array<long>").write.parquet(path)
    scored = spark.read.parquet(path)
    pairs = scored.select("row_no", F.inline(F.arrays_zip("gram", "times")))
    wanted = cut(pairs.groupBy("gram").agg(F.count("*").alias("asked")))
    values = cut(model.resolve(wanted.select("gram")).join(wanted, "gram").select("gram", "asked", F.ln("p").alias("v")))
    met = join_groups(pairs, values, "gram", "asked", values.agg(F.sum("asked")).first()[0] or 0)
    rare = met.groupBy("row_no").agg(F.sum(F.col("times") * F.col("v")).alias("rare"))
    whole = scored.drop("gram", "times").join(rare, "row_no", "left")
    return whole.withColumn("log_p", F.col("log_p") + F.coalesce("rare", F.lit(0.0))).drop("row_no", "rare")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good. A null label is not trusted; toxicity is another question than quality."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def upper_quantile(value: str, quantile: float, errors: float) -> Column:
    """Aggregate: the quantile (over 0.5, under 1) of a sample plus `errors` of its standard errors, the square root of
    q (1 - q) / n over the density there. The density is that of an exponential tail through the median and the
    quantile, so the error falls with the square root of n whatever the unit and spread of the values."""
    top, middle = (F.percentile_approx(value, q, 10_000) for q in (quantile, 0.5))
    scale = (top - middle) / float(-np.log(2 * (1 - quantile)))
    return top + errors * scale * F.sqrt(F.lit(quantile / (1 - quantile)) / F.count(value))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, folds: int = 5, errors: float = 2.0, prior_chars: int = 200, least: int = 20, table_rows: int = 1 << 18) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, text_key, lang, perplexity, threshold, kept.

    Trusted documents whose crc32 of the id modulo `folds` is not 0 train the model; the others set the thresholds. The
    limit is the quantile of a finite set, so `errors` standard errors are added to it, which go to 0 as the set grows
    (see upper_quantile). The measure held against it is the perplexity with `prior_chars` characters of the language's mean added, so short
    texts are not judged by a few characters; the perplexity returned is the plain one. Languages with fewer than
    `least` trusted documents to set a threshold by, and null, take the threshold over all languages; if there is none
    either, every text with a word is kept. Texts without a word (null, empty, white space) have no
    perplexity and are rejected. Repeated rows are judged each by its own text. text_key is the hash of the text, by which rows that repeat
    an id can be told apart.
    """
    ids = cut(trusted_ids(labels))
    marked = ids.withColumn("trusted", F.lit(True))
    rows = docs.select("doc_id", "text", "lang").withColumn("text_key", F.xxhash64("text"))
    small = ids.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(marked) if small else marked, "doc_id", "left")
    sets = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0
    model = train(rows.where(F.col("trusted") & ~sets).select("text"), table_rows)
    scored = cut(perplexities(rows, model))
    judge = F.col("trusted") & sets & (F.col("size") > 0)
    guides = scored.where(judge)
    rate = (-F.sum("log_p") / F.sum("size")).alias("mean")
    whole = guides.agg(rate).first()
    means = guides.where("lang is not null").groupBy("lang").agg(rate, F.count("*").alias("n")).where(F.col("n") >= least)
    langs = cut(scored.groupBy("lang").agg(F.count("*").alias("held")).join(means.select("lang", "mean"), "lang"))
    total = scored.count()
    measured = join_groups(scored, langs, "lang", "held", total, nulls=True).drop("held")
    base = F.coalesce("mean", F.lit(whole["mean"]).cast("double"), F.lit(0.0))
    measured = cut(measured.withColumn("measure", (base * prior_chars - F.col("log_p")) / (F.col("size") + prior_chars)))
    judges = measured.where(judge)
    limits = judges.where("mean is not null").groupBy("lang").agg(upper_quantile("measure", quantile, errors).alias("own_limit"))
    other = judges.agg(upper_quantile("measure", quantile, errors)).first()[0]
    limit = F.coalesce("own_limit", F.lit(other).cast("double"))
    kept = (F.col("size") > 0) & F.coalesce(F.col("measure") <= limit, F.lit(True))
    judged = join_groups(measured, cut(langs.drop("mean").join(limits, "lang")), "lang", "held", total, nulls=True)
    return judged.select("doc_id", "text_key", "lang", F.when(F.col("size") > 0, F.exp(-F.col("log_p") / F.col("size"))).alias("perplexity"), F.exp(limit).alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns. Needs doc_id, text and lang."""
    verdicts = classify(docs.select("doc_id", "text", "lang"), labels, **options)
    bad = cut(verdicts.where("not kept").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key"), F.col("lang").alias("bad_lang")).distinct())
    rows = packed(docs, doc_id=F.col("doc_id"), text_key=F.xxhash64("text"), lang=F.col("lang"))
    rows = sieved(rows, bad.select(F.col("bad_id").alias("doc_id"), F.col("bad_key").alias("text_key")), "doc_id", "text_key")
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("text_key") == F.col("bad_key")) & F.col("lang").eqNullSafe(F.col("bad_lang"))
    left = rows.where("hit").join(bad, same, "left_anti").select("row.*")
    return left.unionByName(rows.where("hit is null").select("row.*"))
