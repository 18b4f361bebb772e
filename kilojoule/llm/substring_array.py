"""Suffix-array dedup: the bytes that a long repeated substring covers, by interval expansion on a Burrows-Wheeler transform.

Every window of `length` bytes has an anchor, the smallest hash among its 20-byte grams; neighbouring windows with the same anchor
make a segment. Equal windows have equal anchors, so windows only have to be compared among segments of one anchor:

1. segments are dealt out by anchor; of equal segments all but the first are repeats as a whole, which collapses groups of copies;
2. the distinct segments of an anchor go together to one bucket of about a megabyte, where a Burrows-Wheeler transform of them is
   expanded backward, breadth first: level k sets the borders between suffixes whose common prefix has k bytes, and the expansion
   stops at `length`, so that what has no border yet are the groups of equal windows;
3. an anchor with too many distinct segments for one bucket is dealt out again by the hash of each whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilojoule.llm._shared import cut, join_checked, key, mix, own_id, pieces, Rolling, signed, small_batches, spread, text_bytes

GRAM = 20
#: Bytes of distinct segments that one bucket holds about, and that one anchor may bring to it.
BUCKET_BYTES = 1 << 20


def _segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start within its text, windows, anchor hash, segment hash) of every segment."""
    span = length - GRAM + 1
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < length:
        return none
    roll = Rolling(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = mix(roll.of(at, at + GRAM))
    # the hash above, the place below: the smallest is the leftmost of the smallest hashes
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    v = (grams >> bits << bits) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    if span > width:
        v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
    anchor = (v & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row, place = spread(np.maximum(np.diff(offsets) - length + 1, 0))
    start = offsets[row] + place
    if not len(start):
        return none
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(start)))
    s = start[first]
    return row[first], place[first], windows, grams[anchor[first]], mix(roll.of(s, s + windows + length - 1))


def _cut_up(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            row, place, windows, anchor, whole = _segments(*text_bytes(b.column("text")), length)
            ids = np.asarray(b.column("key"))
            yield pa.RecordBatch.from_arrays([signed(anchor), signed(whole), pa.array(ids[row]), pa.array(place.astype(np.int32)), pa.array(windows.astype(np.int32))], names=["anchor", "whole", "key", "start", "windows"])

    return run


def _slice(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            out = {"anchor": [], "key": [], "start": [], "string": []}
            for text, k, wanted in zip(b.column("text"), b.column("key"), b.column("wanted")):
                raw = text.as_py().encode()
                for w in wanted.as_py():
                    out["anchor"].append(w["anchor"])
                    out["key"].append(k.as_py())
                    out["start"].append(w["start"])
                    out["string"].append(raw[w["start"] : w["start"] + w["windows"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["key"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["string"], pa.binary())], names=list(out))

    return run


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """The rotations of a byte array, sorted by their first `length` bytes at least, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    for k in range(1, 4):  # four bytes to begin with
        rank = rank * 257 + np.roll(text, -k)
    _, rank = np.unique(rank, return_inverse=True)
    h = 4
    while True:
        pair = rank.astype(np.int64) * n + np.roll(rank, -h)
        order = np.argsort(pair)
        p = pair[order]
        new = np.concatenate([[0], np.cumsum(p[1:] != p[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2
        if h >= length or new[-1] == n - 1:
            return order


def borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True where suffix i of `order` and its predecessor share fewer than `length` bytes.

    Level k holds the intervals of strings of k bytes that end at a border found on level k; extending each backward by every byte
    that precedes it gives the intervals of k + 1 bytes, whose ends are borders of k + 1 common bytes unless a smaller one is there.
    """
    n = len(text)
    last = text[order - 1]
    into = np.argsort(last, kind="stable")  # of each place of the first column, its place in the last
    lf = np.empty(n, np.int64)
    lf[into] = np.arange(n)
    first = last[into]
    same = np.zeros(n + 1, bool)
    same[1:n] = first[1:] == first[:-1]
    before = np.concatenate([[-1], into])  # before[p + 1] = into[p]
    after = np.concatenate([into, [n]])
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        of, place = spread(high - low)
        p = lf[low[of] + place]
        ends = ~same[p + 1] | (after[p + 1] >= high[of])
        begins = ~same[p] | (before[p] < low[of])
        e, s = np.sort(p[ends]) + 1, np.sort(p[begins])
        # a whole first column's last interval ends where the next byte begins, so each end is looked at once
        fresh = ~found[e]
        if not fresh.any() and not (e == n).any():
            break
        fresh |= e == n
        found[e] = True
        low, high = s[fresh], e[fresh]
    return found[:n]


def _repeats(length: int):
    """The removed runs among the distinct segments of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("start", "ascending")]).combine_chunks()
        strings = table.column("string").combine_chunks() if table.num_rows else pa.array([], pa.binary())
        data, offsets = text_bytes(strings)
        sizes = np.diff(offsets)
        # one after another, a zero after each; bytes are one more
        text = np.zeros(len(data) + len(sizes), np.uint16)
        row, place = spread(sizes)
        begin = offsets[:-1] + np.arange(len(sizes))
        text[begin[row] + place] = data.astype(np.uint16) + 1
        order = suffix_order(text, length)
        group = np.cumsum(borders(text, order, length))
        keys, starts = np.asarray(table.column("key")), np.asarray(table.column("start"))
        _, doc = np.unique(keys, return_inverse=True)
        wrow, wplace = spread(np.maximum(sizes - length + 1, 0))
        where = begin[wrow] + wplace
        rank = np.full(len(text), np.iinfo(np.int64).max)
        rank[where] = (doc[wrow].astype(np.int64) << 32) | (starts[wrow] + wplace)
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(rank[order], heads)
        smallest = np.empty(len(text), np.int64)
        smallest[order] = least[group - group[0]]
        gone = rank[where] > smallest[where]
        # runs of neighbouring windows
        at = np.flatnonzero(gone)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (wrow[at[1:]] != wrow[at[:-1]])
        lo = at[new]
        hi = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else at
        return pa.table({"key": pa.array(keys[wrow[lo]]), "start": pa.array((starts[wrow[lo]] + wplace[lo]).astype(np.int32)), "end": pa.array((starts[wrow[hi]] + wplace[hi] + length).astype(np.int32))})

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "string", 1 << 18):
            data, offsets = text_bytes(b.column("string"))
            row, place = spread(np.maximum(np.diff(offsets) - length + 1, 0))
            at = offsets[row] + place
            roll = Rolling(data)
            start = (np.asarray(b.column("start"))[row] + place).astype(np.int32)
            anchor = np.asarray(b.column("anchor"))[row]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), signed(mix(roll.of(at, at + length))), pa.array(np.asarray(b.column("key"))[row]), pa.array(start)], names=["anchor", "whole", "key", "start"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": [], "kept": []}
        for text, spans in zip(b.column("text"), b.column("spans")):
            raw = (text.as_py() or "").encode()
            merged: list[list[int]] = []
            for x in sorted((s["start"], min(s["end"], len(raw))) for s in spans.as_py() or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                elif x[0] < x[1]:
                    merged.append(list(x))
            cuts = [0, *(p for s in merged for p in s), len(raw)]
            kept = b"".join(raw[a:z] for a, z in zip(cuts[::2], cuts[1::2]))
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["spans"].append([{"start": s, "end": e} for s, e in merged])
            out["kept"].append(kept)
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(out["kept"], pa.binary())], names=["key", *out])


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """(key, start, end): runs of bytes that windows seen earlier cover; runs of one document may touch or overlap."""
    w = Window.partitionBy("anchor", "whole")
    cut_up = texts.mapInArrow(_cut_up(length), "anchor long, whole long, key long, start int, windows int")
    met = cut_up.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1")
    met = cut(met.withColumn("nth", F.row_number().over(w.orderBy("key", "start"))).select("anchor", "key", "start", "windows", "nth"))
    whole = met.where("nth > 1").select("key", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("end"))

    # distinct segments, where an anchor has several
    distinct = met.where("nth = 1").select("anchor", "key", "start", "windows")
    size = F.sum(F.col("windows").cast("long") + (length - 1))
    several = distinct.groupBy("anchor").agg(F.count("*").alias("n"), size.alias("size")).where("n > 1")
    wanted = cut(distinct.join(several.hint("merge"), "anchor").select("anchor", "key", "start", "windows", "size"))
    total = wanted.agg(size).first()[0] or 0
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("wanted"))
    strings = cut(texts.join(lists.hint("merge"), "key").mapInArrow(_slice(length), "anchor long, key long, start int, string binary"))
    hot = cut(wanted.where(F.col("size") > BUCKET_BYTES).select("anchor").distinct())
    n_buckets = max(1, total // BUCKET_BYTES)
    cold = join_checked(strings, hot, "anchor", "left_anti")
    dealt = cold.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n_buckets))).repartition(max(1, min(n_buckets, 20_000)), "bucket")
    part = dealt.groupBy("bucket").applyInArrow(_repeats(length), "key long, start int, end int")
    each = join_checked(strings, hot, "anchor", "left_semi").mapInArrow(_windows(length), "anchor long, whole long, key long, start int")
    each = each.withColumn("nth", F.row_number().over(w.orderBy("key", "start"))).where("nth > 1").select("key", "start", (F.col("start") + length).alias("end"))
    return whole.union(part).union(each)


def substring_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept): every document without the bytes that a repeated substring
    of `length` bytes covers, the first occurrence (smaller id, then earlier start) kept.

    Texts are whole UTF-8 bytes, null is empty; matches don't cross documents; what repeats is judged on the input. A text shorter
    than `length` keeps all. A null id counts as the smallest id. Rows that repeat an id count as one document: what is found in any
    of them is removed from all, and of two equal texts with one id both stay. Other columns are ignored.
    """
    small_batches(documents.sparkSession)
    texts = documents.select(key(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(texts, length)
    spans = cut(spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")))
    out = texts.join(spans.hint("merge"), "key", "left").mapInArrow(_apply, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept binary")
    return out.select(own_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
