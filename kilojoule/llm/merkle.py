"""Merkle dataset manifest: a hash tree over each group's records and one over the groups, and a proof for every record.

Records are dealt to tasks in runs of the order, so a task holds consecutive leaves. It combines by key, the key being a parent: each
arriving node goes to its parent's partial list, and as soon as a list has the arity that the level's size gives, the parent's digest
is made and arrives at the next level in the same way. What a run's ends leave unresolved is shuffled by the ancestor that closes it,
some levels at a time, so every round moves a few nodes a task and no task holds more than ARITY ** LEVELS of them. The links from
nodes to what they ended in are kept; followed backwards they give each record the siblings on its way to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoule.llm._shared import cut, join_checked

#: Children of a node, but for the last one of a level.
ARITY = 3
#: Levels that one round closes.
LEVELS = 8
#: Most proofs of inner nodes, of some 2 KB at most, that a join may broadcast.
PROOFS = 20_000


def record_text(*columns: Column) -> Column:
    """The columns one after another, each as its UTF-8 length, a colon and its value, or `-` if it is null."""
    as_text = [c.cast("string") for c in columns]
    return F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in as_text])


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests, which count as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def _width(n: int, level: int) -> int:
    return -(-n // ARITY**level)


def _climb(cap: int, carried: list[str]):
    """Nodes (g, n, level, idx, digest) to a row each with the siblings up to the highest node made of them here (path), at most at
    level `cap`; that node's digest is on one of its rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int, int], list] = {}
        schema, rows = None, []

        def let_go(node: tuple, g: int, n: int) -> None:
            level, idx, digest, _, _ = node
            below, first = [(node, b"")], digest
            while below:
                (at, own, _, children, row), path = below.pop()
                if children is None:
                    rows.append((g, n, at, own, path, level, idx, first, *row))
                    first = None
                else:
                    below += [(c, b"".join(x[2] for x in children if x is not c) + path) for c in children]

        def arrive(node: tuple, g: int, n: int) -> None:
            while node[0] < cap and _width(n, node[0]) > 1:
                level, parent = node[0], node[1] // ARITY
                children = waiting.setdefault((g, n, level + 1, parent), [])
                children.append(node)
                if len(children) < min(ARITY, _width(n, level) - ARITY * parent):
                    return
                del waiting[g, n, level + 1, parent]
                children.sort(key=lambda x: x[1])
                node = (level + 1, parent, joined([x[2] for x in children]), children, ())
            let_go(node, g, n)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.binary(), pa.int64(), pa.int64(), pa.binary(), *[schema.field(c).type for c in carried]])], names=[*_LINK, *carried])
                rows = []

        for b in batches:
            schema = b.schema
            for g, n, level, idx, digest, *row in zip(*(b.column(c).to_pylist() for c in ("g", "n", "level", "idx", "digest", *carried))):
                arrive((level, idx, digest, None, row), g, n)
            if len(rows) > 4_000:
                yield from out()
        for (g, n, *_), children in waiting.items():
            for node in children:
                let_go(node, g, n)
            if len(rows) > 4_000:
                yield from out()
        yield from out()

    return run


_LINK = ["g", "n", "level", "idx", "path", "top_level", "top_idx", "top_digest"]
_LINK_SCHEMA = "g long, n long, level long, idx long, path binary, top_level long, top_idx long, top_digest binary"


def _tops(links: DataFrame) -> DataFrame:
    return links.where("top_digest is not null").select("g", "n", F.col("top_level").alias("level"), F.col("top_idx").alias("idx"), F.col("top_digest").alias("digest"))


def climb(leaves: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The links of every round, the first one's from leaves (g, n, idx, digest and more, which is carried along), and (g, digest) of
    the roots. Leaves in order of (g, idx) leave least for the later rounds; any order is right. `levels` is the highest tree's."""
    carried = [c for c in leaves.columns if c not in ("g", "n", "idx", "digest")]
    kinds = "".join(f", `{c}` {dict(leaves.dtypes)[c]}" for c in carried)
    nodes = leaves.withColumn("level", F.lit(0).cast("long")).sortWithinPartitions("g", "idx")
    rounds, cap = [cut(nodes.mapInArrow(_climb(LEVELS, carried), _LINK_SCHEMA + kinds))], LEVELS
    open_nodes = tops = _tops(rounds[0])
    while True:
        open_nodes = open_nodes.where(F.col("level") < cap)
        nodes = open_nodes.where(f"n > pow({ARITY}.0D, level)").withColumn("ancestor", F.expr(f"idx div cast(pow({ARITY}.0D, {cap} - level) as bigint)"))
        nodes = nodes.repartition("g", "ancestor").sortWithinPartitions("g", "level", "idx").drop("ancestor")
        rounds.append(cut(nodes.mapInArrow(_climb(cap, []), _LINK_SCHEMA)))
        tops = tops.union(_tops(rounds[-1]))
        if cap >= levels:
            break
        open_nodes, cap = tops.where(F.col("level") == cap), cap + LEVELS
    return rounds, tops.where(f"n <= pow({ARITY}.0D, level)").select("g", "level", "idx", "digest")


def descend(rounds: list[DataFrame], known: DataFrame) -> DataFrame:
    """The first round's rows with `proof`, their siblings up to the root and what `known` (g, level, idx, proof, ..) adds to a root's,
    and the other columns of `known`."""
    more = [c for c in known.columns if c not in ("g", "level", "idx", "proof")]

    def below(links: DataFrame, extra: list[str]) -> DataFrame:
        ends = known.select(F.struct("g", F.col("level").alias("l"), F.col("idx").alias("i")).alias("end"), F.col("proof").alias("rest"), *more)
        rows = links.withColumn("end", F.struct("g", F.col("top_level").alias("l"), F.col("top_idx").alias("i")))
        return join_checked(rows, ends, "end", "inner", PROOFS).select("g", "n", "level", "idx", F.concat("path", "rest").alias("proof"), *more, *extra)

    for links in reversed(rounds[1:]):
        known = cut(known.unionByName(below(links, []).drop("n")))
    return below(rounds[0], [c for c in rounds[0].columns if c not in _LINK])


def placed(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with `part`, and the runs (part, group, first, before, size): of each group in each part where it begins, how many of its
    rows stand in earlier parts, and how many it has. `at` - first + before is a row's place in its group.

    The order is dealt out by ranges, so a group of any size is spread; counts by part are all that one group's window sees.
    """
    ordered = cut(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.expr("shiftright(at, 33)")))
    runs = ordered.groupBy("part", *group).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered, cut(runs.select("part", *group, "first", before.alias("before"), F.sum("here").over(w).alias("size")))


def _with_runs(ordered: DataFrame, runs: DataFrame, group: list[str]) -> DataFrame:
    """Each row's group has one run in its part, so no key is larger than a part."""
    on = lambda df: df.withColumn("run", F.struct("part", *group))
    return join_checked(on(ordered).drop("part", *group), on(runs).drop("part"), "run", "inner", PROOFS).drop("run")


def manifest(records: DataFrame, group: str, order: str, digest: str, carry: list[str]) -> DataFrame:
    """(order, digest, carry.., place, n, group_place, n_groups, subroot, root, proof) of every record.

    Within a group records stand by `order` (null first), of equal ones by digest; `digest` is the record's SHA-256 in hex. While a
    level has several nodes, every ARITY consecutive ones become the digest of theirs, the last ones if they are fewer, too. The last
    digest is the group's subroot (a lone record's own digest), and subroots by group (null first, by bytes) become the root in the same
    way. proof is the siblings' digests, level by level, 32 bytes each. Equal records are leaves of their own. Without records there are no rows.
    """
    name = F.col(group).cast("string")
    rows = records.select(name.isNotNull().alias("known"), F.coalesce(name, F.lit("")).alias("name"), F.col(order).alias("ord"), F.unhex(digest).alias("digest"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = cut(rows)  # so that what the ranges are sampled from isn't hashed again
    ordered, runs = placed(rows, ["known", "name"], ["ord", "digest"])
    groups, group_runs = placed(runs.groupBy("known", "name").agg(F.max("size").alias("size")).withColumn("all", F.lit(0)), ["all"], ["known", "name"])
    groups = cut(_with_runs(groups, group_runs.withColumnRenamed("size", "n_groups"), ["all"]).select("known", "name", "size", (F.col("at") - F.col("first") + F.col("before")).alias("g"), "n_groups"))
    most = groups.agg(F.max("size"), F.max("n_groups")).first()
    sizes = groups.select(F.struct("known", "name").alias("group"), "g", "n_groups")
    runs = cut(join_checked(runs.withColumn("group", F.struct("known", "name")), sizes, "group", "inner", PROOFS).drop("group"))

    leaves = _with_runs(ordered, runs, ["known", "name"]).select("g", F.col("size").alias("n"), (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "digest", "n_groups", "ord", F.col("digest").alias("leaf"), *[f"carry_{c}" for c in carry])
    rounds, subroots = climb(leaves, height(most[0] or 0))
    subroots = cut(subroots)
    above, top = climb(subroots.select(F.lit(0).cast("long").alias("g"), F.lit(most[1] or 0).cast("long").alias("n"), F.col("g").alias("idx"), "digest"), height(most[1] or 0))
    top = top.select("g", "level", "idx", F.lit(b"").alias("proof"), F.col("digest").alias("root"))
    upper = cut(descend(above, top).select(F.col("idx").alias("g"), "proof", "root"))
    known = join_checked(subroots.select("g", "level", "idx", F.col("digest").alias("subroot")), upper, "g", "inner", PROOFS)
    out = descend(rounds, known.select("g", "level", "idx", "proof", "subroot", "root"))
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("subroot", "root")]
    return out.select(F.col("ord").alias(order), F.lower(F.hex("leaf")).alias(digest), *[F.col(f"carry_{c}").alias(c) for c in carry], F.col("idx").alias("place"), "n", F.col("g").alias("group_place"), "n_groups", *hexed, "proof")


def fold(leaf: str, place: int, n: int, group_place: int, n_groups: int, proof: bytes) -> str:
    """The root that a record's digest (hex) and its proof give."""
    node, at = bytes.fromhex(leaf), 0
    for idx, width in ((place, n), (group_place, n_groups)):
        while width > 1:
            others = min(ARITY, width - idx // ARITY * ARITY) - 1
            siblings = [proof[at + 32 * k : at + 32 * (k + 1)] for k in range(others)]
            at += 32 * others
            siblings.insert(idx % ARITY, node)
            node, idx, width = joined(siblings), idx // ARITY, -(-width // ARITY)
    return node.hex()


def folded(rows: DataFrame, leaf: str, out: str = "folded_root") -> DataFrame:
    """rows of manifest() with the root that the digests in column `leaf` and the rows' own proofs give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = (b.column(c).to_pylist() for c in (leaf, "place", "n", "group_place", "n_groups", "proof"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fold(*x) for x in zip(*parts)], pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out}` string")


def merkle_manifest(documents: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """A row of manifest() for each document, its leaf being the digest of `columns` as record_text() puts them, with folded_root: what
    its proof and its digest give after the columns in `changed` have changed (none: the root itself), and verified.

    Null, empty and very long texts are hashed as they are; null ids stand first in their group; repeated rows are leaves of their own.
    Columns that the documents lack count as null, others are ignored. Of no documents there is no row.
    """
    own = {c: F.col(c) if c in documents.columns else F.lit(None).cast("string") for c in {*columns, id_col, group_col}}
    digest = lambda now: F.sha2(record_text(*[now[c] for c in columns]), 256)
    records = documents.select(own[id_col].alias("id"), own[group_col].cast("string").alias("grp"), digest(own).alias("leaf"), digest(own | (changed or {})).alias("now"))
    out = folded(manifest(records, "grp", "id", "leaf", ["now"]), "now")
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col).drop("now")
