"""MinHash near-duplicates against all pairs, and word hashes that no structure of a word can break."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from kilojoule.llm import _shared, jaccard_join, minhash_forest, queries
from tests.llm.test_operators import SF, cases, empty, near, prose, small, texts_of  # noqa: F401


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def plain(rows, width=4):
    sets, low = [shingle_set(t, width) for _, t in rows], [-(2**63) if d is None else d for d, _ in rows]
    comp, holders = list(range(len(rows))), {}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, s in enumerate(sets):
        met = {j for x in s for j in holders.get(x, ())}
        for j in met:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                comp[root(i)] = root(j)
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), 2**63), low[i])
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[root(i)] if sets[i] else low[i]
        out.append((d, len(sets[i]), None if c == -(2**63) else c, c == low[i]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_hard_cases(cases, empty):  # noqa: F811
    assert got(minhash_forest.minhash_forest(cases)) == plain(texts_of(cases))
    assert got(minhash_forest.minhash_forest(empty)) == []


def test_query_over_the_whole_table(spark, small):  # noqa: F811
    assert got(queries.op12_minhash_neardup(spark, SF)) == plain(texts_of(small))


@pytest.mark.parametrize("pairs, hot", [(16, 1000), (1, 5)])
def test_large_groups_and_shared_passages(spark, monkeypatch, pairs, hot):
    """Copies alike by one original only, texts that share half of their words, a chain, and regions that are split to the end."""
    monkeypatch.setattr(minhash_forest, "PAIRS", pairs)
    monkeypatch.setattr(minhash_forest, "HOT", hot)
    base, passage, chain = prose(1, 400), prose(2, 200), [f"c{i}" for i in range(500)]
    rows = [(i, near(base, 42 + i % 7)) for i in range(10, 150)] + [(5, base)]
    rows += [(200 + i, passage + " " + prose(300 + i, 150)) for i in range(60)] + [(900, prose(310, 150))]
    rows += [(400 + i, " ".join(chain[20 * i : 20 * i + 240])) for i in range(12)] + [(600 + i, f"a b c d e{i % 3}") for i in range(9)] + [(700, "a b c d"), (701, "a b c d e0 f"), (702, "q r s t u v w x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(minhash_forest.minhash_forest(df)) == plain(rows)


def test_signatures_collide_as_the_sets_are_alike():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**64, 2000, np.uint64)
        n = round(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**64, 2000 - n, np.uint64)])
        s = minhash_forest.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 2000, 4000]))
        assert abs((s[0] == s[1]).mean() - share) < 0.12


def test_words_apart(spark):
    """Words that sums of powers modulo 2**64 can't tell apart, for any base; words that differ in a byte or in length only."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rng = random.Random(2)
    some = [a, b, a[:512], b[:512], "x" * 256, "x" * 257, "x" * 255, "ab", "ba", "a", "", *["".join(rng.choices("ab", k=rng.choice([7, 8, 9, 16, 17]))) for _ in range(3000)]]
    data, at = _shared.text_bytes(pa.array(some))
    h = _shared.slice_hashes(data, at[:-1], at[1:])
    assert len(set(h.tolist())) == len(set(some)) and dict(zip(some, h.tolist())) == {w: x for w, x in zip(some, h.tolist())}
    df = spark.createDataFrame([(1, a), (2, b), (3, "differs")], "doc_id long, text string")
    for op in (jaccard_join.jaccard_join, minhash_forest.minhash_forest):
        assert sorted((r.doc_id, r.component_id, r.n_copies) for r in op(df).collect()) == [(1, 1, 1), (2, 2, 1), (3, 3, 1)]


def test_sources_apart_and_training_rows_bounded(spark, monkeypatch):
    """Sources that begin alike count as different ones; an id of any number of rows stays within the bounds of the fit."""
    from kilojoule.llm import quality

    names = [f"https://{c}.com" for c in ("aaa", "bbb")] + [f"news_site{c}" for c in ("yyy", "zzz", "abcdef")] + [f"s{i}" for i in range(200)]
    assert len({quality.hash_of(n) for n in names[:5]}) == 5 and len({quality.hash_of(n) for n in names}) > 110
    monkeypatch.setattr(quality, "LABELLED", 40)
    monkeypatch.setattr(quality, "UNLABELLED", 30)
    sizes = []
    plain = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda text, *a: sizes.append(text.n) or plain(text, *a))
    docs = spark.range(3000).select(F.expr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id"), F.expr("concat('text ', id) as text"))
    labels = spark.createDataFrame([(7, 1, 0), (None, 0, 0)] + [(i, i % 2, 0) for i in range(100, 400)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, labels).count() == 3000 and set(sizes) <= set(range(71))
