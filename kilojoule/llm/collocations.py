"""Phrase collocations: which words stand together more often than their own counts explain, for each language.

Words are counted first; those frequent enough to be in a phrase get an id of 21 bits, and texts become sequences of ids that break
wherever another word or a piece's end is. Two or three ids packed into one long are a phrase's key. Keys are dealt out by ranges,
sorted (a long as the only sort key, which Spark sorts by radix) and counted by run length. A text is never shuffled.

The dictionary is bounded in words and bytes. Where more words are frequent, the most frequent ones that fit are encoded, and phrases
with any other word are counted as text, so none is lost; none of those is hot, since its rarest word isn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilojoule.llm._shared import _LOWER, BROADCAST_ROWS, cut, drop, pieces, text_bytes

#: Bits of a word's id, and by it the most words of the dictionary; the most bytes of their texts.
ID_BITS, DICTIONARY_BYTES = 21, 32 << 20
DICTIONARY_WORDS = (1 << ID_BITS) - 1
#: Bytes of text that a task works on at once.
PIECE = 3 << 20
#: Keys that a task counts together before it hands them on.
TOGETHER = 2 << 20
#: Bits of the map of frequent pairs, by which a triple without a chance isn't counted; the map is 16 MB at every size.
MAP_BITS = 27
#: The bytes . , ; : ! ? and 0x0A to 0x0D end pieces; they, blanks and tabs end words.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x20, 0x09]] = True
_MASK = (1 << ID_BITS) - 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words in lower case, the row of each, whether it follows the one before it in the same piece, and where it starts."""
    data = _LOWER[data]
    inside = ~_GAPS[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    ends = np.cumsum(_ENDS[data], dtype=np.int32)[start] if len(data) else np.zeros(0, np.int32)
    follows = np.zeros(len(start), bool)
    follows[1:] = (ends[1:] == ends[:-1]) & (row[1:] == row[:-1])
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[inside])]), row, follows, start


def _word_end(data: np.ndarray, at: int, end: int) -> int:
    """The last place up to `end`, or else the first one after it, where no word is cut."""
    if end >= len(data):
        return len(data)
    if len(gaps := np.flatnonzero(_GAPS[data[at:end]])):
        return at + int(gaps[-1]) + 1
    for block in range(end, len(data), PIECE):
        if len(gaps := np.flatnonzero(_GAPS[data[block : block + PIECE]])):
            return block + int(gaps[0]) + 1
    return len(data)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, int]]:
    """(languages, words, row, follows, seen) of some texts or of a part of a long one. Parts end between words and begin with the two
    words before them, `seen` of which were in the part before."""
    for b in pieces(batches, "text", PIECE):
        data, offsets = text_bytes(b.column("text"))
        if len(data) <= 2 * PIECE:
            words, row, follows, _ = tokens(data, offsets)
            yield b.column("lang"), words, row, follows, 0
            continue
        lead = at = seen = 0  # one long text, see pieces()
        while at < len(data):
            end = _word_end(data, at, at + PIECE)
            words, _, follows, start = tokens(data[lead:end], np.array([0, end - lead]))
            yield b.column("lang"), words, np.zeros(len(words), np.int64), follows, seen
            seen = min(2, len(words))
            lead, at = (lead + int(start[-seen]) if seen else end), end


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, words, row, _, seen in _slices(batches):
        words, langs = words.slice(seen).dictionary_encode(), lang.dictionary_encode()
        if not len(words):
            continue
        of_row = np.asarray(langs.indices, dtype=np.int64)
        code, n = np.unique(of_row[row[seen:]] * len(words.dictionary) + np.asarray(words.indices, dtype=np.int64), return_counts=True)
        which, word = code // len(words.dictionary), code % len(words.dictionary)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(which)), words.dictionary.take(pa.array(word)), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])


class Dictionary:
    """The ids of words by language, in a worker."""

    def __init__(self, stream: bytes):
        table = pa.ipc.open_stream(stream).read_all().combine_chunks()
        langs = table.column("lang").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], langs[1:] != langs[:-1]])) if len(langs) else np.zeros(0, np.int64)
        words, ids = table.column("word").combine_chunks(), table.column("id").to_numpy()
        self.of_lang = {langs[a]: (words[a:b], ids[a:b]) for a, b in zip(cuts, [*cuts[1:], len(langs)])}

    def ids(self, lang: pa.Array, words: pa.Array, row: np.ndarray) -> np.ndarray:
        """Each word's id, 0 for those without one."""
        langs = lang.dictionary_encode()
        of_row = np.asarray(langs.indices, dtype=np.int64)[row] if len(row) else np.zeros(0, np.int64)
        encoded = words.dictionary_encode()
        index, out = np.asarray(encoded.indices, dtype=np.int64), np.zeros(len(words), np.int64)
        for k, name in enumerate(langs.dictionary.to_pylist()):
            if name in self.of_lang:
                known, ids = self.of_lang[name]
                place = pc.fill_null(pc.index_in(encoded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
                own = np.append(ids, 0)[place]
                mine = of_row == k
                out[mine] = own[index[mine]]
        return out


_opened: dict[int, Dictionary] = {}


def _dictionary(shared) -> Dictionary:
    """Read once a worker."""
    if shared.id not in _opened:
        _opened.clear()
        _opened[shared.id] = Dictionary(shared.value)
    return _opened[shared.id]


class _Shared:
    """A broadcast with a name that workers know it by."""

    def __init__(self, sc, value):
        self.broadcast = sc.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _encode(shared: _Shared):
    """(skip, ids): the ids of a slice as 32-bit numbers, 0 where a piece or a frequent run ends; phrases that end before `skip` were seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, row, follows, seen in _slices(batches):
            if len(words):
                at = np.arange(len(words)) + np.cumsum(~follows)
                ids = np.zeros(at[-1] + 1, "<i4")
                ids[at] = _dictionary(shared).ids(lang, words, row)
                yield pa.RecordBatch.from_arrays([pa.array([int(at[seen - 1]) + 1 if seen else 0], pa.int32()), pa.array([ids.tobytes()], pa.binary())], names=["skip", "ids"])

    return run


def _place(keys: np.ndarray) -> np.ndarray:
    """A key's bit in the map of pairs, from 0."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _phrases(width: int, pairs: _Shared | None = None):
    """(key, n) of the phrases of `width` ids; of three only those whose pairs are in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(pairs.value, np.uint8) if pairs is not None else None
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            for k in range(0, len(key), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 17)]), pa.array(n[k : k + (1 << 17)].astype(np.int32))], names=["key", "n"])

        for b in batches:
            for skip, blob in zip(b.column("skip").to_pylist(), b.column("ids")):
                ids = np.frombuffer(blob.as_buffer(), "<i4").astype(np.int64)
                end = np.arange(1, len(ids))
                key = ids[:-1] << 2 * ID_BITS | ids[1:] << ID_BITS
                whole = (ids[:-1] > 0) & (ids[1:] > 0)
                if width == 3:
                    place = _place(key)
                    whole &= known[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
                    key, whole, end = key[:-1] | ids[2:], whole[:-1] & whole[1:], end[1:]
                held.append(key[whole & (end >= skip)])
                size += len(held[-1])
                if size >= TOGETHER:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return run


def _runs(least: int):
    """(key, f, place) of sorted (key, n): the sum of every run of one key, where it is `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0

        def of(key: list | np.ndarray, f: list | np.ndarray) -> pa.RecordBatch:
            key, f = np.asarray(key, np.int64), np.asarray(f, np.int64)
            key, f = key[f >= least], f[f >= least]
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(f), pa.array(_place(key) + 1)], names=["key", "f", "place"])

        for b in batches:
            key, n = b.column("key").to_numpy(), b.column("n").to_numpy().astype(np.int64)
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            own, sums = key[begin], np.add.reduceat(n, begin)
            if last is not None and own[0] == last:
                sums[0] += total
            elif last is not None:
                yield of([last], [total])
            last, total = own[-1], sums[-1]
            yield of(own[:-1], sums[:-1])
        if last is not None:
            yield of([last], [total])

    return run


def _other_phrases(shared: _Shared):
    """(lang, w1, w2, w3, n) of the phrases that have a word without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, row, follows, seen in _slices(batches):
            missing = _dictionary(shared).ids(lang, words, row) == 0
            some = np.flatnonzero(missing)
            if not len(some):
                continue
            langs, encoded = lang.dictionary_encode(), words.dictionary_encode()
            of_row, index = np.asarray(langs.indices, dtype=np.int64), np.asarray(encoded.indices, dtype=np.int64)
            for width in (2, 3):
                first = np.unique(np.concatenate([some - k for k in range(width)]))
                first = first[(first >= 0) & (first + width <= len(words)) & (first + width > seen)]
                first = first[np.logical_and.reduce([follows[first + k] for k in range(1, width)])] if len(first) else first
                if len(first):
                    parts = [of_row[row[first]], *[index[first + k] for k in range(width)], *([np.full(len(first), -1)] * (3 - width))]
                    unique, n = np.unique(np.stack(parts), axis=1, return_counts=True)
                    word = [encoded.dictionary.take(pa.array(x, mask=x < 0)) for x in unique[1:]]
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(unique[0])), *word, pa.array(n.astype(np.int64))], names=["lang", "w1", "w2", "w3", "n"])

    return run


def _counted(keys: DataFrame, least: int) -> DataFrame:
    """(key, f, place) of the keys that occur often enough, by sorted ranges. The keys are written first, since ranges are sampled."""
    keys = cut(keys)
    runs = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_runs(least), "key long, f long, place long")
    return cut(runs, keys)


def _fitting(words: DataFrame) -> int:
    """The least count, a power of two or 1, from which on all words fit the dictionary."""
    power = F.floor(F.log2("f") + 1e-9).cast("int")
    sizes = words.groupBy(power.alias("power")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word") + F.octet_length("lang") + 16).alias("bytes")).orderBy(F.desc("power")).collect()  # a row for each power of two
    n = size = 0
    for r in sizes:
        n, size = n + r.n, size + r.bytes
        if n > DICTIONARY_WORDS or size > DICTIONARY_BYTES:
            return 2 ** (r.power + 1)
    return 1


def _near(large: DataFrame, small: DataFrame, few: bool, on: list[str]) -> DataFrame:
    return large.join(F.broadcast(small) if few else small.hint("merge"), on)


def frequent_phrases(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, f) of all words and (lang, w1, w2, w3, f) of the phrases of two (w3 null) and three words that occur `least` times or more."""
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = cut(texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")))
    often = words.where(F.col("f") >= least)
    fits = _fitting(often)
    # within DICTIONARY_WORDS and DICTIONARY_BYTES by their count
    known = often.where(F.col("f") >= fits).select("lang", "word").toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    known = known.append_column("id", pa.array(np.arange(1, known.num_rows + 1)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as writer:
        writer.write_table(known)
    sc, spark = documents.sparkSession.sparkContext, documents.sparkSession
    shared = _Shared(sc, sink.getvalue().to_pybytes())
    names = cut(spark.createDataFrame(known, "lang string, word string, id long"))

    encoded = cut(texts.mapInArrow(_encode(shared), "skip int, ids binary"))
    twos = _counted(encoded.mapInArrow(_phrases(2), "key long, n int"), least)
    parts = twos.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()  # 16 MB at most
    bits = bytearray((1 << MAP_BITS) // 8)
    for r in parts:
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    threes = _counted(encoded.mapInArrow(_phrases(3, _Shared(sc, bytes(bits))), "key long, n int"), least)
    drop(encoded)

    few = known.num_rows <= BROADCAST_ROWS
    both = twos.unionByName(threes).select("f", *[F.expr(f"shiftright(key, {(2 - k) * ID_BITS}) & {_MASK}").alias(f"id{k + 1}") for k in range(3)])
    for k in (1, 2):
        both = _near(both, names.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"w{k}"), *(["lang"] if k == 1 else [])), few, [f"id{k}"])
    # pairs have no third word; they stay out of that join, in which they would be one hot key
    third = _near(both.where("id3 > 0"), names.select(F.col("id").alias("id3"), F.col("word").alias("w3")), few, ["id3"])
    columns = ["lang", "w1", "w2", "w3", "f"]
    phrases = third.select(columns).union(both.where("id3 = 0").withColumn("w3", F.lit(None).cast("string")).select(columns))
    if fits > 1 and fits > least:
        others = texts.mapInArrow(_other_phrases(shared), "lang string, w1 string, w2 string, w3 string, n long").groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        phrases = phrases.union(others.select(columns))
    return words, cut(phrases)


def collocations(documents: DataFrame, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` phrases of two or three words that occur `least` times or more.

    Words are lower-cased (A-Z) and cut at blanks and tabs within pieces, which . , ; : ! ? and the bytes 0x0A to 0x0D end. a, l and r
    count the phrase, the part before the cut and the part after it, n all words of the language; of the possible cuts the one with the
    least score, floor(1000000 * a * a / (l * r)), counts, of equals the first. A pair within a frequent triple that has `percent` of
    its occurrences or more is left out. Order: score and a falling, phrase rising by bytes. A null language is `und`; null and empty
    texts have no words; repeated rows count again, ids don't matter; a language without a phrase has no row. Counts are exact up to 10^13.
    """
    words, phrases = frequent_phrases(documents, least)
    often = words.where(F.col("f") >= least).select("lang", F.col("word"), "f")
    size = often.agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes")).first()
    few = size.n <= BROADCAST_ROWS and (size.bytes or 0) <= DICTIONARY_BYTES
    count = lambda name, w: often.select("lang", F.col("word").alias(w), F.col("f").alias(name))
    scored = lambda left, right: F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(13,0)) * cast(a as decimal(13,0))) div (cast({left} as decimal(13,0)) * cast({right} as decimal(13,0)))")

    pairs = phrases.where("w3 is null").select("lang", "w1", "w2", F.col("f").alias("a"))
    triples = phrases.where("w3 is not null").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    longer = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a").groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longest"))
    two = pairs.join(longer.hint("merge"), ["lang", "w1", "w2"], "left").where(f"longest is null or 100 * longest < {percent} * a")
    two = _near(_near(two, count("l", "w1"), few, ["lang", "w1"]), count("r", "w2"), few, ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", scored("l", "r").alias("score"))
    of = lambda name, a, b: pairs.select("lang", F.col("w1").alias(a), F.col("w2").alias(b), F.col("a").alias(name)).hint("merge")
    three = triples.join(of("r1", "w2", "w3"), ["lang", "w2", "w3"]).join(of("l2", "w1", "w2"), ["lang", "w1", "w2"])
    three = _near(_near(three, count("l1", "w1"), few, ["lang", "w1"]), count("r2", "w3"), few, ["lang", "w3"])
    cuts = F.array_min(F.array(*[F.struct(scored(f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]))
    three = three.withColumn("cut", cuts).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")

    # in two steps, so that no task ranks all phrases of a language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = two.union(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    best = best.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("turn") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
