"""N-gram Jaccard join: which documents share most of their word shingles, by universe partitioning.

Two sets of sizes a and b with a Jaccard similarity of t or more differ in at most H = (1-t)/(1+t) * (a+b) members. Hash the universe
of shingles into segments, by a scheme of each size band: among any H+1+k segments, two sets that differ in at most H members agree on
k+1 whole segments at least. Every set indexes its segments, and sets that meet in no bucket can't link.

Costs are allocated per segment, by the sizes of the buckets that the corpus gives: each set leaves out its costliest segments, as many
as half of k, and two sets are compared if they still agree on more than the other half. Of what two sets that link agree on the
smaller half is left out by neither, so no link is lost. Small sets, whose segments would be mostly empty, are a segment each, with
the deletion neighbourhood that reaches what a set of the size may have besides its partner.

Buckets don't make all their pairs. In each round every set is verified against one other, the head that its buckets elect, and linked
sets are one from then on. Only what is still apart after the rounds is paired, where sizes and bitmaps of the sets allow a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilojoule.llm._shared import cut, drop, join_checked, key, mix, own_id, pieces, signed, spread, words

SHINGLE = 5
#: Bytes of text that a task works on at once.
PIECE = 1 << 19
#: Segments beyond H+1, as a share of them and at least; half of them are left out.
SLACK, LEAST_SLACK = 0.1, 2
#: Sets up to this size are one segment, if a partner lacks no more than so many of their members.
SMALL, DELETIONS = 17, 3
#: Rounds in which sets are verified against an elected head.
ROUNDS = 2
#: 64-bit words of a set's bitmap.
BITMAP = 16


def shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every row as sorted 64-bit hashes, and where each row's start (one entry more than rows)."""
    word, at = words(column)
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row, place = spread(count)
    start = at[row] + place
    length = np.minimum(n[row], width)
    h = mix(length.astype(np.uint64))
    for k in range(width):
        has = k < length
        h = np.where(has, mix(h * np.uint64(0x100000001B3) + word[np.minimum(start + k, max(len(word) - 1, 0))]), h) if len(word) else h
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(column) + 1))


def set_hash(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes for each whole set; 128 bits tell any number of documents' sets apart."""
    out = []
    for salt in (0x5BF03635, 0x1D8E4E27C47D124F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
        out.append(mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.diff(at).astype(np.uint64))))
    return out[0], out[1]


class Scheme:
    """How sets of sizes low..high are cut: `segments` in all."""

    def __init__(self, number: int, low: int, high: int, t: float):
        self.number, self.low, self.high = number, low, high
        self.rate = (1 - t) / (1 + t)
        self.slack = max(LEAST_SLACK, math.ceil(SLACK * (self.differ(high, t) + 1))) if number else 0
        # sets without members in more segments than this index those, too
        self.empties = 1 + math.ceil(0.012 * high)
        self.segments = self.first(high, t)

    def differ(self, size: int, t: float) -> int:
        partner = min(self.high, math.floor(size / t + 1e-9))
        return math.floor(self.rate * (size + partner) + 1e-9)

    def first(self, size: int, t: float) -> int:
        """Segments that a set of this size indexes."""
        return self.differ(size, t) + 1 + self.empties + self.slack


def slacks(t: float) -> list[int]:
    """Of every scheme there can be, by number."""
    return [s.slack for s in schemes(t, 1 << 30)]


def schemes(t: float, most: int) -> list[Scheme]:
    """The small sizes, number 0; from there on bands by a factor of 1 / t, of which each scheme takes two that follow one another.

    Two sets that link are of one band or of neighbours, so they have a scheme in common; the first one crosses into the small sizes.
    """
    high = max(n for n in range(SMALL + 1) if lacking(n, t) <= DELETIONS)
    out, low, middle = [Scheme(0, 1, high, t)], math.ceil(t * (high + 1) - 1e-9), high + 1
    while middle <= most:
        next_ = max(middle + 1, math.ceil(middle / t - 1e-9))
        out.append(Scheme(len(out), low, next_ - 1, t))
        low, middle = middle, next_
    return out


def lacking(n: int, t: float) -> int:
    """Members of a set of n that one which links may lack."""
    return math.floor((1 - t) * n + 1e-9)


def _named(sig: np.ndarray, s: Scheme) -> np.ndarray:
    """With the scheme's number in the lowest seven bits."""
    return sig >> np.uint64(7) << np.uint64(7) | np.uint64(s.number)


def signatures(h: np.ndarray, at: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every segment subset that a set indexes."""
    n = np.diff(at)
    rows, sigs = [], []
    row_of = np.repeat(np.arange(len(n)), n)
    small, *others = schemes(t, int(n.max(initial=0)))
    for k in np.unique(n[(n > 0) & (n <= small.high)]).tolist():
        some = np.flatnonzero(n == k)
        v = mix(h[at[:-1][some][:, None] + np.arange(k)])
        for gone in range(lacking(k, t) + 1):
            without = np.array(list(combinations(range(k), gone)), np.int64)
            left = v.sum(1)[:, None] - (v[:, without].sum(2) if gone else np.zeros((len(some), 1), np.uint64))
            rows.append(np.repeat(some, left.shape[1]))
            sigs.append(_named(mix(left + mix(np.full(1, k - gone, np.uint64))).ravel(), small))
    for s in others:
        members = (n >= s.low) & (n <= s.high)
        if not members.any():
            continue
        first = np.zeros(len(n), np.int64)
        sizes = np.unique(n[members])
        table = {int(k): s.first(int(k), t) for k in sizes}
        first[members] = [table[int(k)] for k in n[members]]
        pick = members[row_of]
        r, x = row_of[pick], h[pick]
        salt = np.uint64((s.number + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        seg = ((mix(x ^ salt) >> np.uint64(20)) % np.uint64(s.segments)).astype(np.int64)
        keep = seg < first[r]
        r, x, seg = r[keep], x[keep], seg[keep]
        cell = r * s.segments + seg
        order = np.argsort(cell, kind="stable")
        cell, x = cell[order], x[order]
        begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        sums = np.add.reduceat(mix(x + salt), begins) if len(begins) else np.zeros(0, np.uint64)
        own = cell[begins]
        who, which = own // s.segments, own % s.segments
        rows.append(who)
        sigs.append(_named(mix(sums + mix(salt + which.astype(np.uint64))), s))
        empty = np.where(members, first - np.bincount(who, minlength=len(n)), 0)
        many = np.flatnonzero(empty > s.empties)
        if len(many):  # keeps its empty segments: their agreement may be all that such a pair has
            has = np.zeros((len(many), s.segments), bool)
            place = np.full(len(n), -1)
            place[many] = np.arange(len(many))
            sel = place[who] >= 0
            has[place[who[sel]], which[sel]] = True
            a, b = np.nonzero(~has & (np.arange(s.segments) < first[many][:, None]))
            rows.append(many[a])
            sigs.append(_named(mix(mix(salt + b.astype(np.uint64)) + np.uint64(1)), s))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(sigs)


def bitmaps(h: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """A bitmap for each set: every member turns one bit over, so the bitmaps of two sets differ in no more bits than the sets in members."""
    n, row = len(at) - 1, np.repeat(np.arange(len(at) - 1), np.diff(at))
    bit = (mix(h ^ np.uint64(0x6B69746D)) >> np.uint64(40)).astype(np.int64) % (64 * BITMAP)
    odd = (np.bincount(row * (64 * BITMAP) + bit, minlength=n * 64 * BITMAP) & 1).astype(np.uint8).reshape(n, BITMAP, 64)
    return [signed(np.packbits(odd[:, k], axis=1, bitorder="little").view(np.uint64).ravel()) for k in range(BITMAP)]


_BITS = [f"bits{k}" for k in range(BITMAP)]
#: What of a set tells that it can't link with another.
_SHAPE = ["n", "many", *_BITS]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", PIECE):
        h, at = shingles(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.diff(at)), *map(signed, set_hash(h, at)), *bitmaps(h, at)], names=["key", "n", "h", "h2", *_BITS])


def _index(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            h, at = shingles(b.column("text"))
            (whole, more), ids = set_hash(h, at), np.asarray(b.column("key"))
            # equal sets of a piece count once: the smallest id stands for them
            order = np.lexsort((ids, more, whole))
            once = order[np.concatenate([[True], (whole[order][1:] != whole[order][:-1]) | (more[order][1:] != more[order][:-1])])] if len(order) else order
            once.sort()
            row, place = spread(np.diff(at)[once])
            sub = np.concatenate([[0], np.cumsum(np.diff(at)[once])])
            who, sig = signatures(h[at[once][row] + place], sub, t)
            who = once[who]
            for k in range(0, len(who), 1 << 18):
                yield pa.RecordBatch.from_arrays([signed(sig[k : k + (1 << 18)]), pa.array(ids[who[k : k + (1 << 18)]])], names=["sig", "id"])

    return run


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", PIECE):
        h, at = shingles(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), signed(h))], names=["key", "members"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b), by alternating large and small stars.

    Each round is two aggregations by node; the rounds grow with the logarithm of a component's length.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = cut(large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        same = [d.agg(F.count("*"), F.sum(F.hash("u", "v")), F.bit_xor(F.xxhash64("u", "v"))).first() for d in (edges, new)]
        drop(edges)
        edges = new
        if same[0] == same[1]:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _allowed(percent: int) -> str:
    """Whether sets a and b may link, by their sizes and bitmaps: |A ^ B| <= (100 - percent) / (100 + percent) * (|A| + |B|)."""
    differ = " + ".join(f"bit_count(a{c} ^ b{c})" for c in _BITS)
    return f"(amany or bmany or 100 * least(an, bn) >= {percent} * greatest(an, bn) and {100 + percent} * ({differ}) <= {100 - percent} * (an + bn))"


def _linked(pairs: DataFrame, per_id: DataFrame, texts: DataFrame, percent: int, *spent: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids that link, by their whole sets; sizes and bitmaps alone rule many out."""
    of = lambda c: per_id.select(F.col("id").alias(c), *[F.col(x).alias(c + x) for x in _SHAPE]).hint("merge")
    pairs = cut(pairs.join(of("a"), "a").join(of("b"), "b").where(_allowed(percent)).select("a", "b"), *spent)
    ends = cut(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
    sets = cut(join_checked(texts, ends, "key", "left_semi").mapInArrow(_whole_sets, "key long, members array<long>"), ends)
    side = lambda c: sets.select(F.col("key").alias(c), F.col("members").alias(f"members_{c}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    common, total = F.size(F.array_intersect("members_a", "members_b")), F.size("members_a") + F.size("members_b")
    return cut(both.where((100 * common.cast("long") >= percent * (total - common)) & (common > 0)).select("a", "b"), pairs, sets)


def _apart(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """The buckets with their members' components, where there are several in a bucket.

    A set stays only where it has as many rows left of a scheme as two sets that link must share, `need`; what goes for that leaves
    other buckets with one component, so this is done twice.
    """
    rows = buckets.join(comp.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_sig = Window.partitionBy("sig")
    for _ in range(2):
        rows = rows.withColumn("low", F.min("component").over(by_sig)).withColumn("high", F.max("component").over(by_sig)).where("low <> high").drop("low", "high")
        rows = rows.withColumn("own", F.count("*").over(Window.partitionBy("id", F.expr("sig & 127")))).where("own >= need").drop("own")
    return rows


def _merged(kept: DataFrame) -> DataFrame:
    """Buckets of a scheme with the same members as one: (bucket, scheme, id, component, need, weight), weight counting them.

    Members are told apart by sums over hashes of their ids; buckets taken for the same by mistake would only bring more pairs.
    """
    by_sig = Window.partitionBy("sig")
    named = kept.withColumn("bucket", F.xxhash64(F.expr("sig & 127"), F.bit_xor(F.xxhash64("id")).over(by_sig), F.sum(F.hash("id").cast("long")).over(by_sig), F.count("*").over(by_sig)))
    return named.groupBy("bucket", F.expr("sig & 127").alias("scheme"), "id", "component").agg(F.count("*").alias("weight"), F.max("need").alias("need"))


def _met(kept: DataFrame, percent: int) -> DataFrame:
    """A row for every two sets (aid, bid) of different components that may link and each merged bucket that both are in."""
    side = lambda c, *more: kept.select("bucket", *more, *[F.col(x).alias(c + x) for x in ("id", "component", *_SHAPE)])
    both = side("a", "scheme", "need", "weight").join(side("b").hint("merge"), "bucket").where(f"aid < bid and acomponent <> bcomponent and {_allowed(percent)}")
    return both.select("aid", "bid", "scheme", "need", "weight")


def jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies): the near-duplicate group of every document.

    Documents link when 100 * |A & B| >= percent * |A | B| for their sets of distinct five-word shingles (lower-cased A-Z, words cut
    at ASCII white space; a shorter text is one shingle). component_id is the smallest id reachable by links, n_copies how many
    documents have the very same set. Null, empty and blank texts have no shingles and stand alone. A null id takes part as the
    smallest id and comes back null. Repeated rows are copies of each other; rows that repeat an id with other texts each keep
    their own set but share what is reached. Other columns are ignored.
    """
    t = percent / 100
    texts = documents.select(key(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    sets = cut(texts.mapInArrow(_sets, f"key long, n long, h long, h2 long, {', '.join(c + ' long' for c in _BITS)}"))
    classes = sets.where("n > 0").groupBy("h", "h2", "n").agg(F.min("key").alias("rep"), F.count("*").alias("n_copies"))
    to_rep = cut(sets.where("n > 0").distinct().join(classes, ["h", "h2", "n"]))
    # of equal sets only the smallest id's is indexed
    copies = cut(to_rep.groupBy("key").agg(F.bool_or(F.col("key") == F.col("rep")).alias("stands")).where("not stands").select("key"))
    texts = join_checked(texts, copies, "key", "left_anti")

    by_sig = Window.partitionBy("sig")
    found = texts.mapInArrow(_index(t), "sig long, id long").withColumn("head", F.min("id").over(by_sig)).withColumn("most", F.max("id").over(by_sig))
    buckets = cut(found.withColumn("size", F.count("*").over(by_sig).cast("int")).where("head <> most").select("sig", "id", "head", "size"))
    # rows that repeat an id may have several sets, of which no one shape says anything
    per_id = cut(to_rep.where("key = rep").groupBy(F.col("rep").alias("id")).agg((F.count("*") > 1).alias("many"), *[F.min(c).alias(c) for c in ("n", *_BITS)]))
    heads = buckets.where("id <> head").groupBy(F.col("id").alias("b")).agg(F.min("head").alias("a"))
    links = _linked(heads, per_id, texts, percent)
    comp = components(links)

    # each set leaves out its costliest signatures: the largest buckets, up to half of its scheme's slack
    slack = F.element_at(F.array(*map(F.lit, slacks(t))), F.expr("cast(sig & 127 as int) + 1"))
    costly = F.row_number().over(Window.partitionBy("id", F.expr("sig & 127")).orderBy(F.desc("size"), "sig"))
    kept = buckets.withColumn("left_out", F.floor(slack / 2)).withColumn("costly", costly).where("costly > left_out").withColumn("need", slack - F.col("left_out") + 1).drop("left_out", "costly", "head")
    kept = cut(_apart(kept, comp), buckets)
    for _ in range(ROUNDS - 1):
        # of a bucket that member which is in the largest ones: what many texts were edited from. A set takes the head that it meets most
        score = kept.groupBy("id").agg(F.sum("size").alias("score"))
        ranked = kept.join(score.hint("merge"), "id").withColumn("head", F.max(F.struct("score", "id", "component")).over(by_sig)).where("component <> head.component")
        met = ranked.groupBy(F.col("id").alias("b"), F.col("head.id").alias("a")).agg(F.struct(F.count("*").alias("often"), F.max("head.score").alias("score")).alias("met"))
        pairs = met.groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a"))
        more = _linked(pairs, per_id, texts, percent)
        links = cut(links.union(more), links, more)
        comp = components(links)
        kept = cut(_apart(kept.select("sig", "id", "size", "need"), comp), kept)
    kept = cut(_merged(kept).join(per_id.hint("merge"), "id"), kept)
    rest = _met(kept, percent).groupBy(F.col("aid").alias("a"), F.col("bid").alias("b"), "scheme").agg(F.sum("weight").alias("shared"), F.min("need").alias("need"))
    rest = rest.where("shared >= need").select("a", "b").distinct()
    more = _linked(rest, per_id, texts, percent)
    comp = components(links.union(more))

    reached = to_rep.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    reached = reached.groupBy("key", "h", "h2", "n").agg(F.min(F.coalesce("component", "rep")).alias("component"), F.max("n_copies").alias("n_copies"))
    out = sets.join(reached, ["key", "h", "h2", "n"], "left")
    return out.select(own_id().alias("doc_id"), F.col("n").alias("n_shingles"), own_id(F.coalesce("component", "key")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
