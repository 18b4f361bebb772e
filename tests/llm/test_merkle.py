"""The Merkle manifest against trees built by hand, in one round and in several."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from kilojoule.llm import merkle, queries
from tests.llm.test_operators import SF, cases, empty, small  # noqa: F401

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """The root, and of every leaf its place among and its siblings at each level."""
    proofs, own, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, o in enumerate(own):
            run = range(o // 3 * 3, min(o // 3 * 3 + 3, len(level)))
            proofs[i].append((o % 3, [level[j] for j in run if j != o]))
            own[i] = o // 3
        level = [digest("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], proofs


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: tree([leaf_of(r) for r in by[s]]) for s in names}
    root, tops = tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops):
        for r, proof in zip(by[s], trees[s][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf_of((*r[:4], r[4].replace("\n", "")) if hit else r)
            for place, siblings in proof + top:
                node = digest("".join([*siblings[:place], node, *siblings[place:]]))
            out.append((r[0], leaf_of(r), trees[s][0], root, digest("".join(x for _, y in proof + top for x in y)), node, node == root))
    return sorted(out, key=repr)


def op(df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.merkle_manifest(df, changed={"text": tampered})


def result(out):
    digests = F.sha2(F.lower(F.hex("proof")), 256).alias("p")
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", digests, "folded_root", "verified").collect()), key=repr)


def source(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_hard_cases(cases, empty):  # noqa: F811
    lines = cases.withColumn("text", F.concat("text", F.lit("\nmore\n")))
    assert result(op(lines)) == plain(source(lines))
    assert op(empty).collect() == []


def test_query_over_the_whole_table(spark, small):  # noqa: F811
    got = sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, SF).collect()), key=repr)
    assert got == plain(source(small)) and {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("levels, parts", [(1, 7), (2, 40)])
def test_rounds_and_parts(spark, monkeypatch, levels, parts):
    """A hot source, lone records, a null source, repeated rows and null ids; the frontier passes through several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "PROOFS", 3)
    rows = [(i, "hot" if i % 2 else f"s{i % 37}", None, i, f"t{i}\n") for i in range(600)] + [(None, None, "en", None, None), (None, "hot", "en", 1, "x"), (7, "hot", None, 7, "t7\n"), (9000, "lone", "en", 3, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(op(df)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_record(spark):
    df = spark.createDataFrame([(3, "a", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    row = op(df).first()
    assert row.root == row.leaf == row.subroot and bytes(row.proof) == b"" and row.verified


def test_missing_and_clashing_columns(spark):
    df = spark.createDataFrame([(3, "x", 1, 2), (4, "y", 1, 2)], "doc_id long, text string, g int, digest int")
    out = merkle.merkle_manifest(df).collect()
    assert all(r.verified for r in out) and len({r.root for r in out}) == 1
