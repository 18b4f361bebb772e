"""MinHash near-duplicates by an LSH forest: TREES sorted orders of signatures, neighbours in them as candidates, depth by region.

A document's set of word shingles has TREES labels of DEPTH minimum hashes each. Two sets share the first d hashes of a label with a
probability of J ** d, so alike sets stand close together in some of the sorted orders. Candidates are looked for in two steps, and
each of them is confirmed on the whole sets:

1. every set against its neighbours in all orders that share LEAST hashes or more with it, and against the head of its regions, the
   sets whose labels begin with the same LEAST hashes; a head is the set that is in the largest regions. That joins most groups, also
   those whose members are alike by one original only.
2. of what is still apart, the sets of a region that are in different groups. A region's depth adapts: where its pairs outnumber its
   rows PAIRS times, it is split by the next hash, and so on until DEPTH.

Equal sets are one from the start. Sizes, a bitmap and a sketch of two bits a hash rule most pairs out before sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilojoule.llm._shared import cut, join_checked, key, own_id, pieces, signed
from kilojoule.llm.jaccard_join import BITMAP, PIECE, bitmaps, components, set_hash, shingles

SHINGLE = 4
#: Orders, hashes of a label, and how many of them two sets must share at least to meet.
TREES, DEPTH, LEAST = 16, 8, 3
#: A region is split further where more pairs than so many times its rows are apart.
PAIRS = 16
#: Standard deviations by which a pair's sketch may be off; a link is lost by that once in three million times.
DEVIATIONS = 5
#: 64-bit words of a sketch, with two bits of each hash.
SKETCH = TREES * DEPTH // 32
#: A head with more candidates than this is hot: its set is sent to them, as long as the hot sets are within so many bytes.
HOT, HOT_BYTES = 1_000, 32 << 20
_HASHES = np.random.default_rng(20).integers(0, 2**64, (2, TREES * DEPTH), np.uint64)
_HASHES[1] |= np.uint64(1)
_SKETCH = [f"sketch{k}" for k in range(SKETCH)]
#: A set's bitmap, whose bits differ from another's in no more places than the sets in members.
_BITS = [f"bits{k}" for k in range(BITMAP)]
_SHAPE = [*_SKETCH, *_BITS]


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The TREES * DEPTH least 32-bit hashes of every set; those of empty sets are all ones."""
    some = np.flatnonzero(np.diff(at))
    out = np.full((len(at) - 1, TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    if len(some):
        begin = at[:-1][some]
        for k, (salt, factor) in enumerate(_HASHES.T):
            out[some, k] = np.minimum.reduceat(((h ^ salt) * factor >> np.uint64(32)).astype(np.uint32), begin)
    return out


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            h, at = shingles(b.column("text"), width)
            sig = signatures(h, at)
            two = np.stack([sig & 1, sig >> 1 & 1], axis=2).astype(np.uint8).reshape(len(sig), SKETCH, 64)
            sketch = [signed(np.packbits(two[:, k], axis=1, bitorder="little").view(np.uint64).ravel()) for k in range(SKETCH)]
            labels = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * TREES * DEPTH), len(sig), [None, pa.py_buffer(sig.astype(">u4").tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.diff(at)), *map(signed, set_hash(h, at)), labels, *sketch, *bitmaps(h, at)], names=["key", "n", "h", "h2", "labels", *_SHAPE])

    return run


def _whole_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            h, at = shingles(b.column("text"), width)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), signed(h))], names=["key", "members"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, label, id) to those rows that share LEAST hashes with the row before or after, with the one before (prev) and how
    many hashes are shared with it (common). A task's first and last rows have edge true, since what is beyond them isn't known here."""

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.logical_and.accumulate(a == b, axis=1).sum(1)

    def out(tree, label, ids, prev, common, after, edge) -> pa.RecordBatch:
        keep = (common >= LEAST) | (after >= LEAST) | edge
        kept = pa.array(label[keep].astype(">u4").view(f"V{4 * DEPTH}").ravel().tolist() if keep.any() else [], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(tree[keep]), kept, pa.array(ids[keep]), pa.array(prev[keep], mask=common[keep] < LEAST), pa.array(common[keep].astype(np.int32)), pa.array(edge[keep])], names=["tree", "label", "id", "prev", "common", "edge"])

    held = None  # the last row, which waits for the one after it
    first = True
    for b in batches:
        if not b.num_rows:
            continue
        tree, ids = b.column("tree").to_numpy(), b.column("id").to_numpy()
        label = np.frombuffer(b"".join(b.column("label").to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint32)
        if held is not None:
            tree, label, ids = (np.concatenate([x, y]) for x, y in zip(held[:3], (tree, label, ids)))
        common = np.zeros(len(ids), np.int64)
        common[1:] = np.where(tree[1:] == tree[:-1], shared(label[1:], label[:-1]), 0)
        prev = np.concatenate([[0], ids[:-1]])
        if held is not None:
            common[0], prev[0] = held[3], held[4]
        edge = np.zeros(len(ids), bool)
        edge[0], first = first, False
        if held is not None:
            edge[0] = held[5]
        yield out(tree[:-1], label[:-1], ids[:-1], prev[:-1], common[:-1], common[1:], edge[:-1])
        held = (tree[-1:], label[-1:], ids[-1:], common[-1], prev[-1], bool(edge[-1]))
    if held is not None:
        yield out(held[0], held[1], held[2], np.array([held[4]]), np.array([held[3]]), np.zeros(1, np.int64), np.ones(1, bool))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b), a table of cut(), that link, by their whole sets."""
    ends = cut(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
    sets = cut(join_checked(texts, ends, "key", "left_semi").mapInArrow(_whole_sets(width), "key long, members array<long>"), ends)
    side = lambda c: sets.select(F.col("key").alias(c), F.col("members").alias(f"members_{c}"))
    often = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("a"))
    hot_sets = cut(side("a").join(often.hint("merge"), "a", "left_semi"))
    few = (hot_sets.agg(F.sum(F.size("members_a") * 8 + 64)).first()[0] or 0) <= HOT_BYTES
    with_b = lambda rows: rows.join(side("b").hint("merge"), "b")
    if few and hot_sets.limit(1).count():
        # of a hot head the one set goes to its many candidates, not their sets to the head's task
        to_hot = with_b(join_checked(pairs, often, "a", "left_semi")).join(F.broadcast(hot_sets), "a")
        both = to_hot.unionByName(with_b(join_checked(pairs, often, "a", "left_anti")).join(side("a").hint("merge"), "a"))
    else:
        both = with_b(pairs).join(side("a").hint("merge"), "a")
    common, total = F.size(F.array_intersect("members_a", "members_b")), F.size("members_a") + F.size("members_b")
    return cut(both.where((100 * common.cast("long") >= percent * (total - common)) & (common > 0)).select("a", "b"), pairs, sets, often, hot_sets)


def _alike(percent: int) -> str:
    """Whether sets a and b may link by their sizes and bitmaps, which rule out no link, and by their sketches: the two bits differ in as
    many hashes as is expected at the least likeness and DEVIATIONS, at most."""
    p = 0.75 * (1 - percent / 100)
    most = math.ceil(TREES * DEPTH * p + DEVIATIONS * math.sqrt(TREES * DEPTH * p * (1 - p)))
    differ = " + ".join(f"bit_count((a{c} ^ b{c} | shiftrightunsigned(a{c} ^ b{c}, 1)) & {0x5555555555555555})" for c in _SKETCH)
    apart = " + ".join(f"bit_count(a{c} ^ b{c})" for c in _BITS)
    return f"100 * least(an, bn) >= {percent} * greatest(an, bn) and {100 + percent} * ({apart}) <= {100 - percent} * (an + bn) and {differ} <= {most}"


def _candidates(near: DataFrame, per_id: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with its neighbours in all orders and with the head that most of its regions have, as far as they may link."""
    inside = near.where("not edge")
    # what stands beside a task's edge: two rows a task
    w = Window.orderBy("tree", "label", "id")
    edges = near.where("edge").withColumns({"tree0": F.lag("tree").over(w), "label0": F.lag("label").over(w), "id0": F.lag("id").over(w)})
    depths = [F.when(F.substring("label", 1, 4 * d) == F.substring("label0", 1, 4 * d), d) for d in range(DEPTH, LEAST - 1, -1)]
    over = edges.where("tree = tree0").select("id", F.col("id0").alias("prev"), F.coalesce(*depths).alias("common"))
    met = inside.select("id", "prev", "common").union(near.where("edge").select("id", "prev", "common")).union(over).where("prev is not null and common is not null and id <> prev")
    beside = met.select(F.least("id", "prev").alias("a"), F.greatest("id", "prev").alias("b")).distinct()

    region = near.select("tree", F.substring("label", 1, 4 * LEAST).alias("prefix"), "id")
    sizes = region.groupBy("tree", "prefix").agg(F.count("*").alias("size")).where("size > 1")
    sized = cut(region.join(sizes.hint("merge"), ["tree", "prefix"]))
    score = sized.groupBy("id").agg(F.sum("size").alias("score"))
    scored = cut(sized.join(score.hint("merge"), "id"), sized)
    heads = scored.groupBy("tree", "prefix").agg(F.max(F.struct("score", "id")).alias("head"))
    to_head = scored.join(heads.hint("merge"), ["tree", "prefix"]).where("id <> head.id").groupBy(F.col("id").alias("b"), F.col("head.id").alias("a")).agg(F.count("*").alias("often"), F.max("head.score").alias("score"))
    to_head = to_head.groupBy("b").agg(F.max(F.struct("often", "score", "a")).alias("best")).select("b", F.col("best.a").alias("a"))
    # a pair once, its head, if there is one, as a
    once = beside.withColumn("head", F.lit(False)).union(to_head.select("a", "b", F.lit(True))).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max(F.struct("head", "a", "b")).alias("p")).select("p.a", "p.b")
    of = lambda c: per_id.select(F.col("id").alias(c), *[F.col(x).alias(c + x) for x in ("n", *_SHAPE)]).hint("merge")
    return cut(once.join(of("a"), "a").join(of("b"), "b").where(_alike(percent)).select("a", "b").distinct(), scored)


def _regions(near: DataFrame, comp: DataFrame) -> DataFrame:
    """(tree, prefix, id, component) of the regions in which several groups meet, each at the depth that its pairs ask for."""
    named = comp.select(F.col("node").alias("id"), "component")
    rows = cut(near.select("tree", "label", "id").join(named.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    out = []
    for depth in range(LEAST, DEPTH + 1):
        at = rows.withColumn("prefix", F.substring("label", 1, 4 * depth))
        parts = at.groupBy("tree", "prefix", "component").agg(F.count("*").cast("double").alias("n"))
        several = parts.groupBy("tree", "prefix").agg(F.sum("n").alias("rows"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("apart")).where("apart > 0")
        fits = F.lit(depth == DEPTH) | (F.col("apart") <= PAIRS * F.col("rows"))
        left = cut(at.join(several.select("tree", "prefix", fits.alias("fits")).hint("merge"), ["tree", "prefix"]))
        out.append(left.where("fits").select("tree", "prefix", "id", "component"))
        rows = left.where("not fits").select("tree", "label", "id", "component")
        if not rows.limit(1).count():
            break
    return reduce(DataFrame.union, out)


def _apart(regions: DataFrame, per_id: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different groups in a region that sizes and sketches don't rule out."""
    rows = cut(regions.join(per_id.hint("merge"), "id"))
    side = lambda c: rows.select("tree", "prefix", *[F.col(x).alias(c + x) for x in ("id", "component", "n", *_SHAPE)])
    may = f"aid < bid and acomponent <> bcomponent and {_alike(percent)}"
    return cut(side("a").join(side("b").hint("merge"), ["tree", "prefix"]).where(may).select(F.col("aid").alias("a"), F.col("bid").alias("b")).distinct(), rows)


def minhash_forest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_copies): the near-duplicate group of every document and whether it is the one to keep.

    Documents link when 100 * |A & B| >= percent * |A | B| for their sets of distinct shingles of `width` words (lower-cased A-Z, words
    cut at ASCII white space; a shorter text is one shingle). component_id is the smallest id reachable by links, which is kept;
    n_copies is how many documents have the very same set. Every link is confirmed on whole sets; that one is missed takes two sets
    that are neither joined by others nor ever meet, see the module. Null, empty and blank texts have no shingles and stand alone. A
    null id takes part as the smallest one and comes back null. Repeated rows are copies of each other; rows that repeat an id with
    other texts keep their own sets and share what is reached. Other columns are ignored.
    """
    texts = documents.select(key(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    sets = cut(texts.mapInArrow(_sets(width), f"key long, n long, h long, h2 long, labels binary, {', '.join(c + ' long' for c in _SHAPE)}"))
    same = ["h", "h2", "n"]
    some = sets.where("n > 0").select("key", *same)
    classes = some.groupBy(*same).agg(F.min("key").alias("rep"), F.count("*").alias("n_copies"))
    to_rep = cut(some.distinct().join(classes.hint("merge"), same))

    # of equal sets one; sets too small to be like any other have their class only
    reps = cut(to_rep.where(f"key = rep and 100 * n >= {percent} * (n + 1)").select("key").distinct())
    signed_sets = cut(join_checked(sets.where("n > 0").select("key", *same, "labels", *_SHAPE), reps, "key", "left_semi").groupBy("key", *same).agg(*[F.first(c).alias(c) for c in ("labels", *_SHAPE)]))
    rows = signed_sets.select("labels", F.col("key").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    orders = cut(rows.select("tree", F.expr(f"substring(labels, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("label"), "id"))
    sorted_orders = orders.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    near = cut(sorted_orders.mapInArrow(_neighbours, "tree int, label binary, id long, prev long, common int, edge boolean"), orders)
    per_id = cut(signed_sets.select(F.col("key").alias("id"), "n", *_SHAPE))
    links = _confirmed(_candidates(near, per_id, percent), texts, percent, width)
    more = _confirmed(_apart(_regions(near, components(links)), per_id, percent), texts, percent, width)
    comp = components(links.union(more))

    reached = to_rep.join(comp.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
    reached = reached.groupBy("key", *same).agg(F.min(F.coalesce("component", "rep")).alias("component"), F.max("n_copies").alias("n_copies"))
    out = sets.select("key", *same).join(reached.hint("merge"), ["key", *same], "left")
    component = F.coalesce("component", "key")
    return out.select(own_id().alias("doc_id"), F.col("n").alias("n_shingles"), own_id(component).alias("component_id"), (component == F.col("key")).alias("kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
