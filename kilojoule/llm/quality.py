"""Quality classifier by co-training of two views of a document.

One view is the text's content: which words, and which last three bytes of words, it holds, hashed; it learns from those that tell
the labels apart by a chi-squared test. The other is the page's metadata:
source, language, and the measures of its text (length, lines, capitals, digits, symbols, repeated words). Each view has a logistic
regression; over some rounds each hands the unlabelled documents that it is most sure of, with its own label, to the other. Held-out
labels then calibrate the views and weigh them against each other. Two targets are learned that way, good quality and toxicity; a
document's score is the probability that it is good and not toxic.

The models are fitted on a bounded sample of LABELLED and UNLABELLED rows; every document is scored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilojoule.llm._shared import give_back, key, mix, own_id, pieces, Rolling, small_batches, text_bytes, words

LABELLED = 6000
UNLABELLED = 4000
ROUNDS = 3
#: Documents that a view hands over in a round, and how sure it must be.
HANDED = 300
SURE = 0.98
BITS = 18
KEEP = 0.5
#: Features of the content view: the most telling ones, if their chi-squared is this at least.
TELLING = 4000
LEAST_CHI2 = 12.0
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), each once, of a text's words and word ends."""
    h, at = words(column, PUNCTUATION)
    data, offsets = text_bytes(column)
    space = np.isin(data, np.array([0x20, *range(9, 14)], np.uint8))
    last = np.flatnonzero(~space & np.append(space[1:], True))
    last = np.union1d(last, (offsets[1:] - 1)[(offsets[1:] > offsets[:-1])])
    last = last[~space[last]] if len(last) else last
    ends = mix(Rolling(data).of(np.maximum(last - 2, 0), last + 1) + np.uint64(1)) if len(last) else np.zeros(0, np.uint64)
    row = np.concatenate([np.repeat(np.arange(len(column)), np.diff(at)), np.searchsorted(offsets, last, "right") - 1])
    bucket = (np.concatenate([h, ends]) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique((row << BITS) | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


N_NUMBERS = 8
N_META = N_NUMBERS + 2 * 256


def metadata(column: pa.Array, source: list, lang: list) -> tuple[np.ndarray, np.ndarray]:
    """A row of measures for each document, and which of the features after them its source and language are, by hash."""
    data, offsets = text_bytes(column)
    n = np.diff(offsets)
    total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets])
    share = lambda flag: total(flag) / np.maximum(n, 1)
    h, at = words(column)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    order = np.lexsort((h, row))
    once = np.ones(len(h), bool)
    once[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][once], minlength=len(column))
    n_words = np.diff(at)
    symbols = np.isin(data, np.frombuffer(b"!#$%&*+/<=>@[]^_`{|}~\\", np.uint8))
    numbers = np.stack([np.log1p(n) / 10, np.log1p(n_words) / 10, total(data == 10) / np.maximum(n_words, 1), share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), share(symbols), distinct / np.maximum(n_words, 1), n / np.maximum(n_words, 1) / 10], 1)
    slots = [[N_NUMBERS + 256 * k + (hash_of(str(v)) if v is not None else 0) for v in values] for k, values in enumerate((source, lang))]
    return numbers.astype(np.float32), np.array(slots, np.int32).T.reshape(len(column), 2)


def hash_of(value: str) -> int:
    """1 to 255, by the whole value."""
    return 1 + int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little") % 255


class Sparse:
    """Rows of hashed features, each 1; sums go through them in steps, so that little is held beside them."""

    STEP = 1 << 19

    def __init__(self, row: np.ndarray, bucket: np.ndarray, n: int):
        self.row, self.bucket, self.n = row.astype(np.int32, copy=False), bucket.astype(np.int32, copy=False), n

    def take(self, rows: np.ndarray) -> Sparse:
        place = np.full(self.n, -1, np.int32)
        place[rows] = np.arange(len(rows))
        keep = place[self.row] >= 0
        return Sparse(place[self.row[keep]], self.bucket[keep], len(rows))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.row, w, self.bucket, self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return self._sums(self.bucket, g, self.row, width)

    def _sums(self, to: np.ndarray, values: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width)
        for at in range(0, len(to), self.STEP):
            out += np.bincount(to[at : at + self.STEP], values[of[at : at + self.STEP]], width)
        return out


class Dense:
    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)

    def take(self, rows: np.ndarray) -> Dense:
        return Dense(self.x[rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return g @ self.x


class Meta:
    """Rows of measures, and two of the other features that are 1: the view's matrix without its zeros."""

    def __init__(self, numbers: np.ndarray, slots: np.ndarray):
        self.numbers, self.slots, self.n = numbers, slots, len(numbers)

    def take(self, rows: np.ndarray) -> Meta:
        return Meta(self.numbers[rows], self.slots[rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.numbers @ w[:N_NUMBERS] + w[self.slots].sum(1)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        out = np.bincount(self.slots.ravel(), np.repeat(g, 2), width).astype(float)  # whole numbers without rows
        out[:N_NUMBERS] += g @ self.numbers
        return out


def fit(x: Sparse | Dense | Meta, y: np.ndarray, width: int, l2: float, steps: int = 120, rate: float = 0.1) -> np.ndarray:
    """Logistic regression by Adam over all rows; the last weight is the intercept."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    prior = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        g = 1 / (1 + np.exp(-np.clip(x.dot(w[:-1]) + w[-1], -30, 30))) - y
        grad = np.append(x.back(g, width) / max(x.n, 1) + l2 * w[:-1], g.mean() if len(g) else 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_content(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Logistic regression on the telling features; the others weigh nothing."""
    width = 1 << BITS
    with_, pos = x.back(np.ones(x.n), width), x.back(y, width)
    n, n_pos = x.n, y.sum()
    off = pos * (n - n_pos) - (with_ - pos) * n_pos  # zero where the feature says nothing
    chi2 = off**2 * n / np.maximum(with_ * (n - with_) * n_pos * (n - n_pos), 1e-9)
    chi2[with_ < 3] = 0
    best = np.argsort(-chi2, kind="stable")[:TELLING]
    best = best[chi2[best] >= LEAST_CHI2]
    place = np.full(width, -1, np.int32)
    place[best] = np.arange(len(best))
    keep = place[x.bucket] >= 0
    small = fit(Sparse(x.row[keep], place[x.bucket[keep]], x.n), y, len(best), 1e-4, 200)
    out = np.zeros(width + 1)
    out[best], out[-1] = small[:-1], small[-1]
    return out


def co_train(text: Sparse, meta: Meta, y: np.ndarray, labelled: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weights of both views and of their combination: learned on four in five labelled rows, calibrated on the fifth, then
    fitted once more with it."""
    held = labelled[4::5] if len(labelled) >= 50 else labelled
    learn = np.setdiff1d(labelled, held) if len(labelled) >= 50 else labelled
    views, fits = (text, meta), (fit_content, lambda x, y: fit(x, y, N_META, 1e-5))
    rows, marks = [learn, learn], [y[learn], y[learn]]
    weights = []
    for turn in range(ROUNDS):
        weights = [f(v.take(r), m) for f, v, r, m in zip(fits, views, rows, marks)]
        if turn == ROUNDS - 1 or not len(free):
            break
        for k in (0, 1):  # the view hands over to the other
            left = np.setdiff1d(free, rows[1 - k])
            p = 1 / (1 + np.exp(-np.clip(views[k].take(left).dot(weights[k][:-1]) + weights[k][-1], -30, 30)))
            # both labels in the share that the labelled rows have, so that a view that can't tell them apart hands over nothing
            share = y[learn].mean() if len(learn) else 0.5
            n_pos, n_neg = int(HANDED * share), int(HANDED * (1 - share))
            order = np.argsort(-p)
            pos, neg = order[:n_pos], order[::-1][:n_neg]
            pos, neg = pos[p[pos] >= SURE], neg[p[neg] <= 1 - SURE]
            if len(pos) and len(neg):
                rows[1 - k] = np.concatenate([rows[1 - k], left[pos], left[neg]])
                marks[1 - k] = np.concatenate([marks[1 - k], np.ones(len(pos)), np.zeros(len(neg))])
    logits = np.stack([v.take(held).dot(w[:-1]) + w[-1] for v, w in zip(views, weights)], 1)
    both = fit(Dense(np.clip(logits, -30, 30)), y[held], 2, 1e-3, 300, 0.05)
    # calibrated, the views may learn from the fifth as well
    more = held if len(labelled) >= 50 else held[:0]
    weights = [f(v.take(np.concatenate([r, more])), np.concatenate([m, y[more]])) for f, v, r, m in zip(fits, views, rows, marks)]
    return weights[0], weights[1], both


def train(rows: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The models of quality and of toxicity."""
    marked = labels.groupBy("key").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality is not null and toxic is not null")
    some = marked.orderBy(F.xxhash64("key"), "key").limit(LABELLED)
    rows = rows.withColumn("turn", F.xxhash64("key", "text", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
    first = rows.join(F.broadcast(some), "key")
    others = rows.select("key").join(marked.select("key"), "key", "left_anti").distinct().orderBy(F.xxhash64("key"), "key").limit(UNLABELLED)
    second = rows.join(F.broadcast(others), "key").select(*rows.columns, F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    # within the task each text becomes its features, a few kilobytes at most; an id may have any number of rows, so the limits hold for rows, too
    kinds = "buckets array<int>, numbers array<float>, slots array<int>, quality int, toxic int, turn long"
    some_of = lambda part, most: part.select(*rows.columns, F.col("quality").cast("int"), F.col("toxic").cast("int")).mapInArrow(_features, kinds).orderBy("turn").limit(most)
    sent = pa.concat_tables([some_of(first, LABELLED).toArrow(), some_of(second, UNLABELLED).toArrow()])
    n = sent.num_rows
    buckets = sent.column("buckets").combine_chunks()
    text = Sparse(np.repeat(np.arange(n, dtype=np.int32), np.asarray(buckets.value_lengths())), np.asarray(buckets.flatten()), n)
    meta = Meta(*(np.asarray(sent.column(c).combine_chunks().flatten()).reshape(n, k) for c, k in (("numbers", N_NUMBERS), ("slots", 2))))
    quality, toxic = (np.array([np.nan if v is None else v for v in sent.column(c).to_pylist()], float) for c in ("quality", "toxic"))
    labelled, free = np.flatnonzero(~np.isnan(quality)), np.flatnonzero(np.isnan(quality))
    order = np.random.default_rng(5).permutation(len(labelled))
    del sent, buckets
    models = [co_train(text, meta, (y > 0).astype(float), labelled[order], free) for y in (quality, toxic)]
    give_back()
    return models


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 1 << 20):
        row, bucket = content(b.column("text"))
        at = np.searchsorted(row, np.arange(b.num_rows + 1))
        meta = metadata(b.column("text"), b.column("source").to_pylist(), b.column("lang").to_pylist())
        lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)))]
        lists += [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in meta]
        yield pa.RecordBatch.from_arrays([*lists, b.column("quality"), b.column("toxic"), b.column("turn")], names=["buckets", "numbers", "slots", "quality", "toxic", "turn"])


def _score(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            row, bucket = content(b.column("text"))
            text = Sparse(row, bucket, b.num_rows)
            meta = Meta(*metadata(b.column("text"), b.column("source").to_pylist(), b.column("lang").to_pylist()))
            p = []
            for w_text, w_meta, both in models.value:
                logits = np.stack([text.dot(w_text[:-1]) + w_text[-1], meta.dot(w_meta[:-1]) + w_meta[-1]], 1)
                p.append(1 / (1 + np.exp(-np.clip(np.clip(logits, -30, 30) @ both[:-1] + both[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("row"), pa.array(p[0]), pa.array(p[1]), pa.array(p[0] * (1 - p[1]))], names=["key", "row", "p_quality", "p_toxic", "score"])

    return run


def quality_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, p_quality, p_toxic, score, keep) of every row; keep where score, good and not toxic, is KEEP or more.

    labels has doc_id, quality and toxic (0 or 1); rows with a null in them are passed over, and of repeated ids the worse counts.
    Without any labels all documents score alike. Null texts count as empty; missing source or lang columns as null. Null and
    repeated ids are scored row by row; other columns are ignored, but row_col, a long, is handed on last if it is given.
    """
    small_batches(documents.sparkSession)
    column = lambda c: F.col(c).cast("string").alias(c) if c in documents.columns else F.lit(None).cast("string").alias(c)
    rows = documents.select(key(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), column("source"), column("lang"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"))
    models = documents.sparkSession.sparkContext.broadcast(train(rows.drop("row"), labels.select(key(id_col).alias("key"), "quality", "toxic")))
    out = rows.mapInArrow(_score(models), "key long, row long, p_quality double, p_toxic double, score double")
    return out.select(own_id().alias("doc_id"), "p_quality", "p_toxic", "score", (F.col("score") >= KEEP).alias("keep"), *([F.col("row").alias(row_col)] if row_col else []))
