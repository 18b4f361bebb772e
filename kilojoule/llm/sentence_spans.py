"""Substring dedup by sliding sentence spans: runs of consecutive sentences that occur earlier are removed.

The shortest run from a sentence on, and up to a sentence, that has LEAST_WORDS words is a span: some ten words a sentence make it
several sentences, one long sentence may be a span by itself, and three one-word exclamations are none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilojoule.llm._shared import cut, key, mix, own_id, pieces, signed, small_batches, spread

#: Words of a span at least.
LEAST_WORDS = 25
#: A span is hot from this share of all spans on, so there can't be more hot ones than one by it; and from as many rows.
HOT, LEAST_HOT = 1e-4, 1000
#: Spans that a task counts at once, and repeats among them from which it tells of a span.
BLOCK, TOLD = 1 << 20, 16
#: Parts into which a hot span is dealt.
SALTS = 64
_STOPS = ".!?。！？｡．।॥؟۔։።፧"
_SENTENCE = re.compile(rf"[^\s{_STOPS}][^{_STOPS}\n]*[{_STOPS}]*|[{_STOPS}]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Where the sentences are; they end at a full stop, exclamation or question mark of any of several scripts, or at the line's end."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def _hashes(sentence: str) -> bytes:
    return hashlib.blake2b(" ".join(sentence.lower().split()).encode(), digest_size=16).digest()


def weight(sentence: str) -> int:
    """Its words; where scripts put no spaces, eight characters count as one."""
    return max(len(sentence.split()), len(sentence) // 8)


def _found(texts: list[str], least_words: int) -> tuple[np.ndarray, ...]:
    """(span, other, row, at): two independent hashes of each span, and at = its first sentence * (least_words + 1) + its sentences."""
    found = [[t[s:e] for s, e in sentences(t)] for t in texts]
    n = np.array([len(x) for x in found], np.int64)
    h = np.frombuffer(b"".join(_hashes(x) for y in found for x in y), np.uint64).reshape(-1, 2)
    words = np.append(0, np.cumsum([weight(x) for y in found for x in y])).astype(np.int64)
    row, place = spread(n)
    begin, i = np.cumsum(n) - n, np.arange(len(row))
    ahead = np.searchsorted(words, words[:-1] + least_words)  # where the run from a sentence on ends
    back = np.searchsorted(words, words[1:] - least_words, "right") - 1  # where the run up to a sentence begins
    on, upto = i[ahead <= (begin + n)[row]], i[back >= begin[row]]
    both = np.unique(np.concatenate([on * (least_words + 1) + ahead[on] - on, back[upto] * (least_words + 1) + upto + 1 - back[upto]]))
    first, size = both // (least_words + 1), both % (least_words + 1)
    v, w = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        at = np.where(has, first + k, 0)
        v = np.where(has, mix(v * np.uint64(0x100000001B3) + h[at, 0]), v)
        w = np.where(has, mix(w * np.uint64(0x9E3779B97F4A7C55) + h[at, 1]), w)
    return v, (w >> np.uint64(33)).astype(np.int32), row[first], (place[first] * (least_words + 1) + size).astype(np.int32)


def _spans(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            span, other, row, at = _found([x.as_py() or "" for x in b.column("text")], least_words)
            yield pa.RecordBatch.from_arrays([signed(span), pa.array(other), pa.array(np.asarray(b.column("key"))[row]), pa.array(at)], names=["span", "other", "key", "at"])

    return run


def _frequent(least_words: int):
    """(span, n): what repeats within a block of spans, and the number of all spans under a null."""

    def told(block: list[np.ndarray]) -> pa.RecordBatch:
        span, n = np.unique(np.concatenate(block), return_counts=True)
        often = n >= TOLD
        return pa.RecordBatch.from_arrays([pa.array([*span[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[often].tolist(), int(n.sum())], pa.int64())], names=["span", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = []
        for b in pieces(batches, "text"):
            block.append(_found([x.as_py() or "" for x in b.column("text")], least_words)[0])
            if sum(map(len, block)) >= BLOCK:
                yield told(block)
                block = []
        if block:
            yield told(block)

    return run


def _without(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            out: dict[str, list] = {"n_sentences": [], "n_removed": [], "kept_sha256": [], "removed": [], "kept": []}
            for text, starts in zip(b.column("text"), b.column("starts")):
                text, starts = text.as_py() or "", starts.as_py() or []
                where = sentences(text)
                gone = sorted({i for s in starts for i in range(s // (least_words + 1), s // (least_words + 1) + s % (least_words + 1)) if i < len(where)})
                kept, at = [], 0
                for i in gone:
                    kept.append(text[at : where[i][0]])
                    at = where[i][1]
                left = "".join([*kept, text[at:]]) if gone else text
                out["n_sentences"].append(len(where))
                out["n_removed"].append(len(gone))
                out["kept_sha256"].append(hashlib.sha256(left.encode()).hexdigest())
                out["removed"].append(gone)
                out["kept"].append(left)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], names=["key", *out])

    return run


def sentence_span_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, kept_sha256, removed, kept): every document without the sentences that a span seen earlier covers.

    The shortest run from each sentence on, and up to each, with least_words words or more is a span. Spans are compared in lower case
    with white space as one space, by hashes of 95 bits; a span's first occurrence (smaller id, then earlier place) stays. removed
    are the sentences' numbers from 0. A text of fewer words has no span and stays whole. Null counts as empty and a null id as the
    smallest. Rows that repeat an id count as one document: what is found in any is removed from all, and of equal rows with one id
    both stay. Other columns are ignored.
    """
    small_batches(documents.sparkSession)
    texts = documents.select(key(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    often = cut(texts.mapInArrow(_frequent(least_words), "span long, n long").groupBy("span").agg(F.sum("n").alias("n")))
    limit = max(LEAST_HOT, HOT * (often.where("span is null").agg(F.sum("n")).first()[0] or 0))
    # hot spans, fewer than 1 / HOT, are broadcast; each is dealt out in SALTS parts, whose first ones are compared at the end
    hot = often.where(F.col("span").isNotNull() & (F.col("n") >= limit)).select("span", F.lit(True).alias("hot"))
    spans = texts.mapInArrow(_spans(least_words), "span long, other int, key long, at int").join(F.broadcast(hot), "span", "left")
    spans = spans.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")))
    nth = F.row_number().over(Window.partitionBy("span", "other", "salt").orderBy("key", "at"))
    met = cut(spans.withColumn("nth", nth).where("nth > 1 or hot").select("span", "other", "key", "at", (F.col("nth") == 1).alias("heads")), often)
    heads = met.where("heads")
    last = heads.groupBy("span", "other").agg(F.min(F.struct("key", "at")).alias("first"))
    again = met.where("not heads").select("key", "at").union(heads.join(last.hint("merge"), ["span", "other"]).where("key <> first.key or at <> first.at").select("key", "at"))
    starts = cut(again.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("starts")), met)
    out = texts.join(starts.hint("merge"), "key", "left")
    out = out.mapInArrow(_without(least_words), "key long, n_sentences long, n_removed long, kept_sha256 string, removed array<int>, kept string")
    return out.select(own_id().alias("doc_id"), *out.columns[1:])
