"""BPE encoding and decoding of a corpus with a public word-level BPE vocabulary.

The words of the whole corpus are counted, and the most frequent ones are compiled with their ids into a minimal acyclic transducer:
an automaton that shares the words' common beginnings and ends, and whose transitions add up to a word's number in a table of ids.
Tasks memory-map it. Words outside the lexicon are merged exactly, pair by pair in order of rank. The lexicon's size is a parameter;
what is encoded doesn't depend on it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilojoule.llm._shared import cut, drop, key, own_id, pieces, small_batches, spread

#: Frequent words that the lexicon holds at most; it is read by every task, so this bounds its size (some megabytes).
LEXICON_WORDS = 32_768
#: Words that a worker remembers; beyond it only those stay that another piece of texts had before.
REMEMBER = 200_000
#: Bytes beyond which a word is merged by itself.
LONG = 64
#: The rank of a pair that is never merged.
NEVER = 1 << 30

# White space as the vocabulary's normalizer takes it, without U+001C to U+001F, which Python adds.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Where the vocabulary's library knows another version of Unicode than Python and its `regex` do. Capitals and their
# small letters, as first, last and small first; what isn't a letter to the library, and what isn't a number.
_CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
_NO_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_NO_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
_SMALL = {c: small + c - first for first, last, small in _CAPITALS for c in range(first, last + 1)}
_BEYOND = regex.compile("[\u0558-\U0010ffff]")
_MAY_BE_CAPITAL = re.compile("[\u1c89\ua7cb-\U0010ffff]")
_IS_CAPITAL = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")


def _ranges(chars: list[int]) -> str:
    """Ascending code points as what stands in a character class."""
    starts = [c for k, c in enumerate(chars) if not k or chars[k - 1] != c - 1]
    ends = [c for k, c in enumerate(chars) if k + 1 == len(chars) or chars[k + 1] != c + 1]
    return "".join(rf"\u{a:04x}-\u{z:04x}" for a, z in zip(starts, ends))


@lru_cache(maxsize=2)
def plain_word(pattern: str) -> re.Pattern | None:
    """The word pattern for Python's own engine, which is faster, with letters and numbers up to U+FFFF as the library knows them; None if
    the pattern has other properties than these."""
    bmp = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for name, less in (("L", _NO_LETTERS), ("N", _NO_NUMBERS)):
        pattern = pattern.replace(rf"\p{{{name}}}", _ranges([ord(c) for c in regex.findall(rf"[\p{{{name}}}--[{less}]]", bmp, regex.V1)]))
    return None if r"\p" in pattern else re.compile(pattern)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Transducer:
    """A minimal acyclic automaton over words in UTF-8 with a number for each word, as flat arrays."""

    names = ("first", "final", "byte", "target", "skip", "id_at", "ids")

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> bytes:
        """The arrays of a lexicon, built from sorted words; equal ends become one state as soon as no later word can change them."""
        known: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        counts: list[int] = []

        def settle(node: list) -> int:
            shape = (node[0], tuple(node[1]))
            if shape not in known:
                known[shape] = len(states)
                states.append(shape)
                counts.append(node[0] + sum(counts[t] for _, t in node[1]))
            return known[shape]

        path: list[list] = [[False, []]]
        before = b""
        for word in sorted(entries):
            shared = len(os.path.commonprefix([before, word]))
            while len(path) > shared + 1:
                node = path.pop()
                path[-1][1].append((before[len(path) - 1], settle(node)))
            path += [[False, []] for _ in word[shared:]]
            path[-1][0] = True
            before = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(node)))
        root = settle(path[0])
        order = [root, *(s for s in range(len(states)) if s != root)]
        place = {s: i for i, s in enumerate(order)}
        first, byte, target, skip = [0], [], [], []
        for s in order:
            n = int(states[s][0])
            for b, t in states[s][1]:
                byte.append(b)
                target.append(place[t])
                skip.append(n)
                n += counts[t]
            first.append(len(byte))
        ids = [entries[w] for w in sorted(entries)]
        arrays = (first, [states[s][0] for s in order], byte, target, skip, np.cumsum([0, *map(len, ids)]), [i for x in ids for i in x])
        arrays = [np.asarray(a, np.int32) for a in arrays]
        return np.asarray([len(a) for a in arrays], np.int32).tobytes() + b"".join(a.tobytes() for a in arrays)

    def __init__(self, compiled: bytes):
        with tempfile.NamedTemporaryFile(suffix=".fst") as f:  # the mapping outlives the name
            f.write(compiled)
            f.flush()
            whole = np.memmap(f.name, np.int32, "r")
        at = len(self.names)
        for name, n in zip(self.names, whole[:at]):
            setattr(self, name, whole[at : at + int(n)])
            at += int(n)

        self.arcs = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first)) << 8 | self.byte

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word of the lexicon, None for others: all words take a transition at a time."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        arcs = self.arcs
        at, number, alive = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        for k in range(int(sizes.max())):
            if not len(arcs):
                at[:] = -1
                break
            alive = alive[(sizes[alive] > k) & (at[alive] >= 0)]
            asked = at[alive] << 8 | text[begin[alive] + k]
            arc = np.minimum(np.searchsorted(arcs, asked), len(arcs) - 1)
            ok = arcs[arc] == asked
            at[alive] = np.where(ok, self.target[arc], -1)
            number[alive] += np.where(ok, self.skip[arc], 0)
        ends = (at >= 0) & (self.final[np.maximum(at, 0)] > 0)
        low, high = self.id_at[np.where(ends, number, 0)], self.id_at[np.where(ends, number + 1, 0)]
        return [self.ids[a:z].tolist() if e else None for e, a, z in zip(ends, low, high)]


class Codec:
    """Encoding and decoding with one vocabulary file of the tokenizers library (BPE with word ends, byte-level, lower case)."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab, chars = self.vocab, _byte_chars()
        pairs = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.rank_of = pairs[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.first_ids = np.array([vocab[c] for c in chars], np.int32)
        self.last_ids = np.array([vocab[c + self.end] for c in chars], np.int32)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.plain_word = plain_word(pattern)
        self.word = regex.compile(pattern)
        #: for texts with characters of which Python knows another version; slower
        self.odd = regex.compile(f"[{_NO_LETTERS}{_NO_NUMBERS}]")
        self.odd_word = regex.compile(pattern.replace(r"\p{L}", rf"[\p{{L}}--[{_NO_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{_NO_NUMBERS}]]"), regex.V1)
        self.lexicon = Transducer(lexicon) if lexicon else None
        top = max(self.tokens) + 1
        self.names, self.shown = np.empty(top, object), np.empty(top, object)
        for i, t in self.tokens.items():
            self.names[i], self.shown[i] = str(i), t
        self.forget({})

    def forget(self, kept: dict[str, np.ndarray]) -> None:
        """Leaves only these words, with their ids, in the table: rows of ids, one after another."""
        kept = kept | {x: np.array([i], np.int32) for x, i in self.added.items()}
        self.row = {w: k for k, w in enumerate(kept)}
        self.sizes = np.array([len(x) for x in kept.values()], np.int64)
        self.flat = np.concatenate([*kept.values(), np.zeros(0, np.int32)])

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # one character at a time: no final sigma
        return text.translate(_SMALL) if _MAY_BE_CAPITAL.search(text) and _IS_CAPITAL.search(text) else text

    def words(self, text: str) -> list[str]:
        """The words of a normalized text; white space is in none."""
        if self.plain_word and (text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)):
            return self.plain_word.findall(text)
        odd = _BEYOND.search(text) and self.odd.search(text)
        return (self.odd_word if odd else self.word).findall(text)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by merging its pairs in order of rank, the leftmost first: many words of like sizes a step."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted((i for i, w in enumerate(words) if 0 < len(w) <= LONG), key=lambda i: len(words[i]))
        for k in range(0, len(order), 20_000):
            self._merge_rows([words[i] for i in order[k : k + 20_000]], order[k : k + 20_000], out)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._merge_long(w)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) << 20 | b
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[k] == pair) & (a >= 0) & (b >= 0), self.rank_of[k], NEVER)

    def _merge_rows(self, words: list[bytes], where: list[int], out: list[list[int]]) -> None:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        inside = np.arange(width + 1) < sizes[:, None]
        sym = np.full((len(words), width + 1), -1, np.int32)
        sym[inside] = self.first_ids[np.frombuffer(b"".join(words), np.uint8)]
        rows = np.arange(len(words))
        sym[rows, sizes - 1] = self.last_ids[[w[-1] for w in words]]
        rank = self._ranks(sym[:, :-1], sym[:, 1:]).astype(np.int32)
        place = np.arange(width + 1)
        left = rows
        while len(left):
            k = rank.argmin(1)
            best = rank[np.arange(len(left)), k]
            go = best < NEVER
            if not go.all():
                for i in np.flatnonzero(~go):
                    out[where[left[i]]] = sym[i][sym[i] >= 0].tolist()
                left, k, best, sym, rank = left[go], k[go], best[go], sym[go], rank[go]
                if not len(left):
                    break
            n = np.arange(len(left))
            shift = np.minimum(place + (place > k[:, None]), width)
            sym[:, :] = np.take_along_axis(sym, shift, 1)
            sym[:, width] = -1
            sym[n, k] = self.made[best]
            rank[:, :] = np.take_along_axis(rank, np.minimum(shift[:, :-1], width - 1), 1)
            rank[:, width - 1] = NEVER
            rank[n, k] = self._ranks(sym[n, k], sym[n, np.minimum(k + 1, width)])
            prev = np.maximum(k - 1, 0)
            rank[n, prev] = np.where(k > 0, self._ranks(sym[n, prev], sym[n, k]), rank[n, prev])

    def _merge_long(self, word: bytes) -> list[int]:
        """One long word: the pairs in a heap, their symbols in a linked list."""
        sym = self.first_ids[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last_ids[word[-1]])
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = {p: (int(r), int(self.made[r])) for p, r in zip(self.pairs.tolist(), self.rank_of.tolist())}
        heap = [(rank[p][0], i, p) for i in range(n - 1) if (p := sym[i] << 20 | sym[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j < 0 or sym[i] << 20 | sym[j] != pair:
                continue
            sym[i], sym[j] = rank[pair][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := sym[a] << 20 | sym[b]) in rank:
                    heapq.heappush(heap, (rank[p][0], a, p))
        return [s for s in sym if s >= 0]

    def learn(self, words: set[str]) -> None:
        """Takes the words of a piece of texts into the table."""
        new = list(words.difference(self.row))
        raw = [w.encode() for w in new]
        ids = self.lexicon.find(raw) if self.lexicon else [None] * len(new)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.merge([raw[i] for i in rest])):
            ids[i] = x
        if len(self.row) + len(new) > REMEMBER:
            end = np.cumsum(self.sizes)
            self.forget({w: self.flat[end[k] - self.sizes[k] : end[k]] for w, k in self.row.items() if w in words})
        begin = len(self.row)
        self.row.update(zip(new, range(begin, begin + len(new))))
        self.sizes = np.append(self.sizes, np.fromiter(map(len, ids), np.int64, len(ids)))
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.int32))

    def parts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids, decoded) of each text."""
        split: list[list[str]] = []
        for text in texts:
            if "<|" in text and self.special.search(text):
                own, at = [], 0
                for m in self.special.finditer(text):
                    own += [*self.words(self.normal(text[at : m.start()])), m[0]]
                    at = m.end()
                split.append([*own, *self.words(self.normal(text[at:]))])
            else:
                split.append(self.words(self.normal(text)))
        self.learn(set().union(*split))
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(split)), np.int64)
        of, place = spread(self.sizes[rows])
        ids = self.flat[(np.cumsum(self.sizes) - self.sizes)[rows][of] + place]
        ends = np.append(0, np.cumsum(self.sizes[rows]))[np.append(0, np.cumsum([len(x) for x in split])).astype(np.int64)]
        names, shown = self.names[ids].tolist(), self.shown[ids].tolist()
        return [(z - a, " ".join(names[a:z]), " ".join(shown[a:z])) for a, z in pairwise(ends.tolist())]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.parts([text])[0][1].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """As a vocabulary without a decoder is decoded: the tokens joined by one space."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=1)
def codec_of(path: str, lexicon: bytes | None = None) -> Codec:
    """One codec a worker process, for all the tasks that it runs."""
    return Codec(path, lexicon)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in pieces(batches, "text", 8 << 20):
            found: Counter = Counter()
            for text in b.column("text"):
                found.update(codec.words(codec.normal(text.as_py() or "")))
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return run


def frequent_words(texts: DataFrame, path: str, size: int) -> list[str]:
    """The corpus's `size` most frequent words (ties: the smaller word).

    How many words occur how often tells which count is the last to be kept, so that the tasks send only words that are; only words
    of that very count, which tie, are sorted.
    """
    counts = cut(texts.mapInArrow(_count(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    # a row for each power of two, then for each count at which the words run out
    often = F.floor(F.log2("n")).cast("int")
    levels = sorted(((r["k"], r["words"]) for r in counts.groupBy(often.alias("k")).agg(F.count("*").alias("words")).collect()), reverse=True)
    above, low, high = 0, 2, None
    for k, words in levels:
        if above + words > size:
            low, high = 2**k, 2 ** (k + 1)
            break
        above += words
    while high is not None and high - low > 1:  # halve what is left
        middle = (low + high) // 2
        words = counts.where(F.col("n").between(middle, high - 1)).count()
        low, high, above = (middle, high, above) if above + words > size else (low, middle, above + words)
    kept = [r["word"] for r in counts.where(F.col("n") >= (high or 2)).select("word").collect()]
    if high is not None:
        kept += [r["word"] for r in counts.where(F.col("n") == low).orderBy("word").limit(size - above).collect()]
    drop(counts)
    return kept


def compile_lexicon(texts: DataFrame, path: str, size: int = LEXICON_WORDS) -> bytes:
    """The transducer of the corpus's most frequent words."""
    words = [w.encode() for w in frequent_words(texts, path, size)]
    return Transducer.compile(dict(zip(words, codec_of(path).merge(words))))


def _encode(path: str, lexicon, digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, lexicon.value)
        for b in pieces(batches, "text"):
            n, ids, decoded = zip(*codec.parts([t.as_py() or "" for t in b.column("text")]))
            if digest_only:
                sha = lambda texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
                columns = [sha(ids), sha(decoded)]
            else:
                columns = [pa.array([np.fromstring(x, np.int32, sep=" ") for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            names = ["key", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest_only else ("ids", "decoded"))]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), *columns], names=names)

    return run


def bpe(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS, digest_only: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or with digest_only (doc_id, n_tokens, ids_sha256, decoded_sha256), of every whole text.

    Encoded without special tokens added; the strings of special tokens in a text become those tokens, as in the library. Null and
    empty texts have no tokens; their ids and decoded text are empty. Row by row: null and repeated ids stay as they are, and other
    columns are ignored.
    """
    small_batches(documents.sparkSession)
    texts = documents.select(key(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    lexicon = documents.sparkSession.sparkContext.broadcast(compile_lexicon(texts, path, lexicon_words))
    columns = "ids_sha256 string, decoded_sha256 string" if digest_only else "ids array<int>, decoded string"
    out = texts.mapInArrow(_encode(path, lexicon, digest_only), f"key long, n_tokens long, {columns}")
    return out.select(own_id().alias("doc_id"), *out.columns[1:])
