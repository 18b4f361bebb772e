"""Language ID: multinomial naive Bayes over hashed character n-grams.

Tasks count hashed n-grams by language and the counts are summed; the matrix of log-probabilities (languages by 2**BITS) is broadcast,
and batches of texts are scored by adding up its columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoule.llm._shared import key, mix, own_id, pieces, small_batches

BITS = 15
GRAMS = (1, 2, 3)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of letters, a space standing for each run of other characters; and which rows have a letter."""
    texts = [(t.as_py() or "").lower() for t in column]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    code = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter
    code, row, letter = np.where(letter, code, 32)[keep].astype(np.uint64), row[keep], letter[keep]
    has = np.bincount(row[letter], minlength=len(texts)) > 0
    rows, buckets = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in GRAMS:
            same = row[: len(h)] == row[n - 1 :]
            rows.append(row[: len(h)][same])
            buckets.append((mix(h[same] + np.uint64(n << 40)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets), has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in pieces(batches, "text", 1 << 20):
        row, bucket, _ = grams(b.column("text"))
        langs = b.column("lang").to_pylist()
        names = sorted(set(langs))
        of = np.array([names.index(x) for x in langs])
        found = np.bincount((of[row] << BITS) + bucket, minlength=len(names) << BITS).reshape(len(names), -1)
        for x, c in zip(names, found):
            counts[x] = counts.get(x, 0) + c
            docs[x] = docs.get(x, 0) + langs.count(x)
    for x, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(c[at], docs[x]))], names=["lang", "bucket", "n"])


def train(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their log-probabilities (a row each, the log-prior last) from (text, lang); counts add up on Spark."""
    found = texts.where("lang is not null and text is not null").select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), (1 << BITS) + 1))
    counts[found["lang"].map({x: i for i, x in enumerate(langs)}), found["bucket"]] = found["n"]
    grams_, docs = counts[:, :-1] + 0.5, counts[:, -1:]
    return langs, np.hstack([np.log(grams_ / grams_.sum(1, keepdims=True)), np.log(docs / max(docs.sum(), 1))]).astype(np.float32)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for b in pieces(batches, "text", 1 << 20):
            row, bucket, has = grams(b.column("text"))
            n = b.num_rows
            if langs:
                total = np.stack([np.bincount(row, t[:-1][bucket], n) + t[-1] for t in table])
                best = total.argmax(0)
                score = 1 / np.exp(total - total.max(0)).sum(0)
            else:
                best, score, has = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("held_out"), pa.array([langs[i] if h else UNKNOWN for i, h in zip(best, has)], pa.string()), pa.array(np.where(has, score, 0.0))], names=["key", "held_out", "lang_pred", "score"])

    return run


def language_id(documents: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from rows that aren't held out and have a text and a language.

    lang_pred is `und` with score 0 where the text is null or has no letter, or nothing could be learned; score is the posterior
    probability of lang_pred otherwise; ties go to the language that sorts first. A null held_out counts as false. Null and repeated
    ids and repeated rows are scored row by row; other columns are ignored.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(key(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = documents.sparkSession.sparkContext.broadcast(train(rows.where("not held_out")))
    return rows.select("key", "text", "held_out").mapInArrow(_score(model), "key long, held_out boolean, lang_pred string, score double").select(own_id().alias("doc_id"), "held_out", "lang_pred", "score")
