"""Benchmark decontamination: which documents hold a benchmark item, allowing for edits.

Item and text go through the CGK embedding: at each step of a random walk the current character is written out, and a random bit, fixed
by the step and the character, says whether to go on to the next one. Two walks that an edit drives apart soon meet again, so what they
write agrees wherever edits are few. A walk starts at every place of the items and of the text; SAMPLES of its STEPS are what a place is
filed under (bit sampling), for each of SEARCH_WALKS walks. Item and text meet where they are filed alike, and those meetings that belong
to one occurrence lie near one diagonal (place in the text less place in the item). Meetings are summed by item and band of diagonals,
each weighing less the more of the items' places are filed there, and wherever a band and its neighbour have LEAST_SHARED of the item's
weight, the item's exact edit distance to that part of the text is taken. Items of under SHORT characters take walks of so few steps,
all sampled, that MOST_EDITS edits can't break them all, unweighted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilojoule.llm._shared import key, mix, own_id, pieces, small_batches, spread

#: Steps of a walk and those of them that are sampled, walks, the least share of an item's places by weight to look closer, and diagonals of a band.
STEPS = 16
SAMPLES = (0, 2, 4, 7, 9, 12, 15)
SEARCH_WALKS = 1
LEAST_SHARED = 0.07
BAND = 32
#: Items of fewer characters use shorter walks.
SHORT = 60
#: Characters of text whose walks are followed at once, and those, counters of item and band, and meetings that are counted at once: few
#: enough for a core's own cache, more counters only where segments would be less than SPARE times what they share with the next.
WALKED = 1 << 15
SEGMENT = 1 << 16
COUNTERS = 1 << 17
MOST_COUNTERS = 1 << 22
SPARE = 8
MEETINGS = 1 << 17
#: Bands side by side that are looked at as one part of the text.
TOGETHER = 16
#: Parts of texts, and characters of them, that wait for the exact distance together.
WAITING = 4096
WAITING_CHARS = 4 << 20
#: Characters, those after a shorter text's end included, that the exact distance works on side by side.
SIDE_BY_SIDE = 2 << 20
#: Between two texts; its class is that of the character beyond the last code point.
BETWEEN = "\x11"
#: A-Z in lower case, white space as spaces; characters as classes, for code points below 256.
PLAIN = bytes(0x20 if 9 <= k <= 13 else k + 32 if 65 <= k <= 90 else k for k in range(256))
CLASSES = bytes(1 + k % 255 if k else 0 for k in range(256))
#: Edits, as a share of the item's characters, up to which an item counts as held.
MOST_EDITS = 0.2
#: Samples compared in a repetition, the share of equal steps taken for granted at MOST_EDITS, and the recall to reach.
SAMPLED = 2
EQUAL_STEPS = 0.3
RECALL = 0.995
WALKS = 2
#: Bytes of items that a pass over the documents takes along; more items make more passes.
BLOCK_BYTES = 4 << 20


def repetitions() -> int:
    return math.ceil(math.log(1 - RECALL) / math.log(1 - EQUAL_STEPS**SAMPLED))


def normal(text: str) -> list[str]:
    """The words as words() cuts them, A-Z in lower case."""
    return [w.decode() for w in text.encode().lower().split()]


def plain(text: bytes) -> bytes:
    """The words of normal() with one space between."""
    text = text.translate(PLAIN).strip(b" ")
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def codes_of(strings: list[str], width: int) -> np.ndarray:
    """The code points of each string in a row of its own, zeros beyond its end."""
    sizes = np.array([len(s) for s in strings], np.int64)
    out = np.zeros((len(strings), width), np.uint32)
    row, place = spread(sizes)
    out[row, place] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def classes_of(codes: np.ndarray) -> np.ndarray:
    """Characters as one of 255 classes, 0 where there is none."""
    return np.where(codes > 0, 1 + codes % 255, 0).astype(np.uint8)


def walk_bits(n_steps: int, walk: int) -> np.ndarray:
    """For each step of a walk and class of characters, 1 to go on to the next character and 0 to stay."""
    step = np.arange(n_steps, dtype=np.uint64)[:, None]
    return (mix(np.arange(256, dtype=np.uint64) + np.uint64((walk << 40) + 1) + (step << np.uint64(22))) >> np.uint64(63)).astype(np.int64)


def embed(strings: list[str], n_steps: int, walk: int) -> np.ndarray:
    """What each string writes at every step of a walk, a row a step: its characters as one of 255 classes, 0 beyond its end."""
    codes = codes_of(strings, max(n_steps, max((len(s) for s in strings), default=0)) + 1)
    classes = classes_of(codes)
    bits = walk_bits(n_steps, walk)
    flat, at = classes.ravel(), np.arange(len(strings)) * classes.shape[1]
    out = np.zeros((n_steps, len(strings)), np.uint8)
    for k in range(n_steps):
        out[k] = flat[at]
        at += bits[k][out[k]]
    return out


def _nearest(patterns: list[str], which: np.ndarray, texts: list[str]) -> np.ndarray:
    sizes = np.array([len(p) for p in patterns], np.int64)
    n_words = int(sizes.max() + 63) // 64
    alphabet, code = np.unique(np.frombuffer("".join(patterns).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    # bit k of column (pattern, character): the pattern has the character at k; the last column of a pattern is of all others
    columns = len(alphabet) + 1
    table = np.zeros((n_words, len(patterns) * columns), np.uint64)
    of, place = spread(sizes)
    np.bitwise_or.at(table, (place // 64, of * columns + code), np.uint64(1) << (place % 64).astype(np.uint64))
    codes = codes_of(texts, max(len(t) for t in texts))
    codes[np.arange(codes.shape[1]) >= np.array([len(t) for t in texts])[:, None]] = 0x110000  # no character, NUL neither
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    at = (np.where(alphabet[at] == codes, at, len(alphabet)) + which[:, None] * columns).T.copy()
    one, rows = np.uint64(1), np.arange(len(texts))
    word, bit = (sizes[which] - 1) // 64, ((sizes[which] - 1) % 64).astype(np.uint64)
    pv, mv = np.full((n_words, len(texts)), ~np.uint64(0)), np.zeros((n_words, len(texts)), np.uint64)
    score = sizes[which].copy()
    best, total = score.copy(), np.empty_like(pv)
    for columns_now in at:
        eq = np.take(table, columns_now, axis=1)
        xv = eq | mv
        carry = np.zeros(len(texts), np.uint64)
        both = eq & pv
        for w in range(n_words):
            half = both[w] + pv[w]
            total[w] = half + carry
            carry = ((half < pv[w]) | (total[w] < half)).astype(np.uint64)
        xh = (total ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += (ph[word, rows] >> bit & one).astype(np.int64) - (mh[word, rows] >> bit & one).astype(np.int64)
        np.minimum(best, score, out=best)
        high_p, high_m = ph[:-1] >> np.uint64(63), mh[:-1] >> np.uint64(63)
        ph <<= one
        mh <<= one
        ph[1:] |= high_p
        mh[1:] |= high_m
        pv, mv = mh | ~(xv | ph), ph & xv
    return best


def nearest(patterns: list[str], which: np.ndarray, texts: list[str]) -> np.ndarray:
    """The least edit distance of patterns[which[k]] to any substring of texts[k]: Myers' bit vectors, many texts side by side."""
    out = np.array([len(patterns[i]) for i in which], np.int64)
    todo = np.flatnonzero([bool(len(patterns[i]) and texts[k]) for k, i in enumerate(which)])
    order = todo[np.lexsort((which[todo], out[todo]))]
    at = 0
    while at < len(order):  # a chunk: patterns of like sizes, few enough for a small table, and texts as wide as the widest
        some = order[at : at + 2048]
        changes = np.cumsum(np.diff(which[some], prepend=which[some[0]]) != 0)
        some = some[: int(np.searchsorted(changes, 128))]
        widest = np.maximum.accumulate([len(texts[k]) for k in some])
        some = some[: max(1, int(np.searchsorted(widest * np.arange(1, len(some) + 1), SIDE_BY_SIDE, "right")))]
        used, local = np.unique(which[some], return_inverse=True)
        out[some] = _nearest([patterns[i] for i in used], local, [texts[k] for k in some])
        at += len(some)
    return out


def edits(item: str, text: str, most: int) -> int:
    """The least edit distance of the item to any substring of the text, or most + 1 if it is larger."""
    return min(int(nearest([item], np.zeros(1, np.int64), [text])[0]), most + 1)


class Items:
    """A block of benchmark items, with their seeds and embeddings."""

    def __init__(self, ids: list[int], texts: list[str]):
        split = [normal(t) for t in texts]
        self.ids, self.n_words = ids, np.array([len(x) for x in split], np.int64)
        self.texts = [" ".join(x) for x in split]
        sizes = [len(t) for t in self.texts]
        self.longest = max(sizes, default=0)
        self.steps = np.array([steps_of(n)[0] for n in sizes], np.int64)
        self.least = np.array([steps_of(n)[1] for n in sizes], float)
        #: by steps and walk: the distinct keys, where each one's entries start, the first key by its upper bits, and the entries' items, places and weights
        self.index = {}
        total = np.zeros(len(ids))
        for steps, walk in sorted({(int(n), w) for n in self.steps for w in range(SEARCH_WALKS if n == STEPS else 1)}):
            of = np.flatnonzero(self.steps == steps)
            found = [walk_keys(classes_of(codes(self.texts[i])), steps, walk, inside=True) for i in of]
            g, place = (np.concatenate(x) for x in zip(*found))
            item = np.repeat(of, [len(k) for k, _ in found])
            order = np.argsort(g, kind="stable")
            g, item, place = g[order], item[order], place[order]
            keys, at, often = np.unique(g, return_index=True, return_counts=True)
            weight = np.ones(len(g))
            if steps == STEPS:
                weight /= np.repeat(often, often)
                total += np.bincount(item, weight, minlength=len(ids))
                self.least[of] = LEAST_SHARED * total[of] - 1e-9
            n_bits = min(len(keys).bit_length() + 2, 22)
            upper = (keys >> np.uint64(64 - n_bits)).astype(np.int64)
            first = np.full(1 << n_bits, -1, np.int32)
            first[upper[::-1]] = np.arange(len(keys) - 1, -1, -1)
            self.index[steps, walk] = keys, np.append(at, len(g)), first, int(np.bincount(upper, minlength=1).max()), item, place, weight
        rng = np.random.default_rng(7)
        self.draws = [rng.random((math.ceil(repetitions() / WALKS), SAMPLED)) for _ in range(WALKS)]

    def alike(self, item: int | np.ndarray, windows: list[str]) -> np.ndarray:
        """Which windows agree with the item, one for all or one each, in some repetition."""
        item = np.broadcast_to(np.asarray(item, np.int64), len(windows))
        out = np.zeros(len(windows), bool)
        for at in range(0, len(windows), 4096):
            some = slice(at, at + 4096)
            used, local = np.unique(item[some], return_inverse=True)
            # the steps sampled for items of a size are within the walk's first size * 1.5 steps
            n_steps = np.array([max(1, int(1.5 * len(self.texts[i]))) for i in used], np.int64)
            strings = [*(self.texts[i] for i in used), *windows[some]]
            for walk in range(WALKS):
                wrote = embed(strings, int(n_steps.max()), walk)
                steps = (self.draws[walk].reshape(1, -1) * n_steps[:, None]).astype(np.int64)
                theirs = wrote[steps[local], len(used) + np.arange(len(local))[:, None]]
                same = theirs == wrote[steps, np.arange(len(used))[:, None]][local]
                out[some] |= same.reshape(len(local), -1, SAMPLED).all(2).any(1)
        return out


def steps_of(size: int) -> tuple[int, int]:
    """The steps of the walks of an item of so many characters, and for short items how many walks must be shared."""
    if size >= SHORT:
        return STEPS, 0
    most = int(MOST_EDITS * size)
    left = {q: size - q + 1 - q * most for q in (4, 3, 2, 1)}  # a walk of q steps reads q characters at most, so an edit breaks q walks
    return next(((q, n) for q, n in left.items() if n >= 2), (1, max(left[1], 1)))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_classes(text: str) -> np.ndarray:
    """classes_of the text's code points."""
    try:
        return np.frombuffer(text.encode("latin-1").translate(CLASSES), np.uint8)
    except UnicodeEncodeError:
        return classes_of(codes(text))


def walk_keys(classes: np.ndarray, steps: int, walk: int, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(key, place): what the walk from every place writes at the sampled steps, hashed; inside: only of walks that end before the text does.

    Walks are followed from their last step back: what one writes from a step on is what it writes from the next step on, here or a place
    further. So all places move side by side, without looking up where each one is.
    """
    n = len(classes)
    flat = np.append(classes, np.zeros(steps + 1, np.uint8))
    text = flat.tobytes()
    sampled = SAMPLES if steps == STEPS else range(steps)
    bits = (walk_bits(steps, walk) * 255).astype(np.uint8)
    wrote, live = np.zeros((len(sampled), len(flat)), np.uint8), 0  # by sampled step, the last one first
    for k in range(sampled[-1], -1, -1):
        if live:
            other = wrote[:live, :-1] ^ wrote[:live, 1:]
            other &= np.frombuffer(text.translate(bits[k].tobytes()), np.uint8)[:-1]
            wrote[:live, :-1] ^= other
        if k in sampled:
            wrote[live] = flat
            live += 1
    v = np.zeros((n, 8), np.uint8)
    for k in range(live):
        v[:, k] = wrote[k, :n]
    v = v.view("<u8")[:, 0] * np.uint64(0x9E3779B97F4A7C55)  # one to one, the upper bits well spread
    place = np.arange(n)
    return (v[wrote[0, :n] > 0], place[wrote[0, :n] > 0]) if inside else (v, place)


def _met(items: Items, classes: np.ndarray, steps: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key): the places of the text that are filed like some item's, and the number of the key."""
    keys, _, first, most, *_ = items.index[steps, walk]
    shift = np.uint64(65 - len(first).bit_length())
    out = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(classes), WALKED):
        g = walk_keys(classes[at : at + WALKED + steps], steps, walk)[0][:WALKED]
        nth = first.take((g >> shift).view(np.int64))
        pos = np.flatnonzero(nth >= 0)
        g, nth = g.take(pos), nth.take(pos).astype(np.int64)
        same = keys.take(nth) == g
        for _ in range(1, most):  # keys of the same upper bits lie side by side
            left = np.flatnonzero(~same)
            nth[left] = np.minimum(nth[left] + 1, len(keys) - 1)
            same[left] = keys[nth[left]] == g[left]
        out.append(np.stack([at + pos[same], nth[same]]))
    return tuple(np.concatenate(out, 1))


def _bands(items: Items, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, from, to): between where in the text, give or take a band, an item may start."""
    pad, n_items = items.longest + BAND, len(items.ids)
    reach = math.ceil((1 + MOST_EDITS) * items.longest) + 4 * BAND  # a segment runs on so far into the next
    fits, limit = (c * BAND // max(n_items, 1) for c in (COUNTERS, MOST_COUNTERS))
    step = max(min(SEGMENT, max(fits, min(SPARE * reach, limit))), reach) // BAND * BAND
    n_bands = (min(step + reach, len(classes)) + pad) // BAND + 2
    met = []
    for (steps, walk), (_, starts, _, _, item, place, weight) in items.index.items():
        pos, nth = _met(items, classes, steps, walk)
        low = starts[nth]
        met.append((pos, low, starts[nth + 1] - low, item * (n_bands * BAND) + pad - place, weight))
    out = [np.zeros((3, 0), np.int64)]
    for at in range(0, len(classes), step):
        counts = None
        for pos, low, n, cell, weight in met:
            a, end = np.searchsorted(pos, (at, at + step + reach)).tolist()
            meetings = np.cumsum(n[a:end])
            while a < end:
                done = len(meetings) - (end - a)
                most_now = (meetings[done - 1] if done else 0) + MEETINGS
                b = a + max(1, int(np.searchsorted(meetings[done:], most_now, "right")))
                # entry by entry: the place in the run counts on from where it starts
                many = n[a:b]
                hit = np.repeat(low[a:b] - np.cumsum(many) + many, many)
                hit += np.arange(len(hit))
                cells = np.repeat(pos[a:b] - at, many)
                cells += cell.take(hit)
                cells >>= BAND.bit_length() - 1
                some = np.bincount(cells, weight.take(hit), n_items * n_bands)
                counts = some if counts is None else counts + some
                a = b
        counts = (np.zeros(n_items * n_bands) if counts is None else counts).reshape(n_items, n_bands)
        both = counts[:, :-1] + counts[:, 1:]
        i, band = np.divmod(np.flatnonzero(both >= items.least[:, None]), n_bands - 1)
        # what starts beyond the segment is counted in full by the next one, what starts before it was by the one before
        start = band * BAND - pad
        own = ((start >= 0) | (at == 0)) & (start < step)
        i, start = i[own], at + start[own]
        # bands side by side make one stretch, of TOGETHER at most
        first = (np.diff(i, prepend=-1) != 0) | (np.diff(start, prepend=-1) != BAND)
        nth = np.arange(len(i))
        first |= (nth - np.maximum.accumulate(np.where(first, nth, 0))) % TOGETHER == 0
        first = np.flatnonzero(first)
        out.append(np.stack([i[first], start[first], start[np.append(first[1:], len(i)) - 1] if len(i) else start]))
    return tuple(np.concatenate(out, 1))


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        most = [int(MOST_EDITS * len(t)) for t in items.texts]
        found: dict[tuple[int, int], int] = {}
        which: list[tuple[int, int]] = []
        wide: list[str] = []
        key_of: dict[int, int] = {}
        rows = waiting = 0

        def verify() -> pa.RecordBatch:
            for x, e in zip(which, nearest(items.texts, np.array([i for _, i in which], np.int64), wide).tolist()):
                if e <= most[x[1]]:
                    found[x] = min(e, found.get(x, e))
            out = pa.RecordBatch.from_arrays(
                [pa.array([key_of[d] for d, _ in found], pa.int64()), pa.array([items.ids[i] for _, i in found], pa.int64()), pa.array(list(found.values()), pa.int64()), pa.array([len(items.texts[i]) for _, i in found], pa.int64())],
                names=["key", "item", "edits", "item_chars"],
            )
            for kept in (found, which, wide, key_of):
                kept.clear()
            return out

        for b in pieces(batches, "text", 1 << 20):
            texts = [plain(x or b"").decode() for x in b.column("text").cast(pa.large_binary()).to_pylist()]
            keys = np.asarray(b.column("key"))
            # one after another
            ends = np.cumsum([len(t) + 1 for t in texts])
            begins = np.append(0, ends[:-1])
            for i, start, last in zip(*(x.tolist() for x in _bands(items, text_classes(BETWEEN.join(texts))))):
                size = len(items.texts[i])
                low, high = max(start - BAND - most[i], 0), last + 3 * BAND + size + most[i]
                for d in range(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(begins, high, "left"))):
                    at, row = int(begins[d]), rows + d
                    part = texts[d][max(low - at, 0) : max(high - at, 0)]
                    if len(part) < size - most[i] or found.get((row, i)) == 0:
                        continue
                    key_of[row] = int(keys[d])
                    if items.texts[i] in part:
                        found[row, i] = 0
                        continue
                    which.append((row, i))
                    wide.append(part)
                    waiting += len(part)
                    if len(which) >= WAITING or waiting >= WAITING_CHARS:
                        waiting = 0
                        yield verify()
            rows += len(texts)
            if len(found) >= WAITING:
                waiting = 0
                yield verify()
        yield verify()

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, item_chars): every benchmark item that a document holds, with its edit distance to the nearest place.

    Texts are compared word by word in lower case (A-Z) with one space between words. An item is held where a part of the document is
    within MOST_EDITS edits a character of it. Null, empty and blank texts and items hold nothing and are held by nothing. Of rows
    that repeat an id the nearest place counts; null ids come back null. The items are a stated set: they are taken along in blocks
    of BLOCK_BYTES, each block in a pass of its own. Other columns are ignored.
    """
    small_batches(documents.sparkSession)
    spark = documents.sparkSession
    texts = documents.select(key(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    listed = benchmark.select(key(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("trim(text) <> ''")
    schema = "key long, item long, edits long, item_chars long"
    found, ids, block = None, [], []

    def add(found):
        more = texts.mapInArrow(_search(spark.sparkContext.broadcast(Items(ids, block))), schema)
        return more if found is None else found.union(more)

    size = 0
    for r in listed.orderBy("item", "text").toLocalIterator():
        if not r["text"].encode().split():
            continue
        if size + len(r["text"]) > BLOCK_BYTES and block:
            found, ids, block, size = add(found), [], [], 0
        ids.append(r["item"])
        block.append(r["text"])
        size += len(r["text"])
    found = add(found) if block or found is None else found
    found = found.groupBy("key", "item").agg(F.min("edits").alias("edits"), F.min("item_chars").alias("item_chars"))
    return found.select(own_id().alias("doc_id"), own_id("item").alias("item_id"), "edits", "item_chars")
