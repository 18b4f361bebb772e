"""Phrase collocations against plain counting, with the dictionary whole, cut short and empty, and in long texts cut in parts."""

import random
import re
from collections import Counter

import pytest

from kilojoule.llm import collocations, queries
from tests.llm.test_operators import SF, cases, empty, small  # noqa: F401


def plain(rows, least=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {p for t, a in often.items() if len(t) == 4 for p in (t[:3], (t[0], *t[2:])) if 100 * a >= percent * often[p]}
    by = {}
    for p, a in often.items():
        if p not in gone:
            score, k = min((1000000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
            by.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return [(lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score) for lang, own in sorted(by.items()) for i, (score, a, phrase, left, right) in enumerate(sorted(own)[:top])]


def got(df):
    return sorted(map(tuple, df.collect()))


def source(df):
    return [tuple(r) for r in df.select("lang", "text").collect()]


def wordy(spark):
    """Few words, so that phrases repeat; a null language, a hot one, other scripts, every end of a piece, a long text."""
    rng = random.Random(4)
    words = ["new", "York", "state", "of", "the", "été", "日本", "a-b", "x" * 90, "Rare%d"]
    text = lambda k, n: "".join((w % rng.randrange(90) if "%" in w else w) + rng.choice([" ", " ", " ", "  \t", ", ", ".", "\n", "\x0b", "; "]) for w in rng.choices(words, [5, 5, 3, 4, 6, 2, 2, 1, 2, 3], k=n))
    rows = [(rng.choice(["en", "en", "en", "fr", None, "und"]), text(i, rng.randrange(60))) for i in range(300)] + [("en", text(0, 4000)), ("en", None), (None, ""), ("de", "only once"), ("en", "same same same same " * 30), ("en", "no_end" * 500)]
    return spark.createDataFrame([(lang, t, 1, "k") for lang, t in rows], "lang string, text string, word int, key string")


def test_hard_cases(spark, cases, small, empty):  # noqa: F811
    for df in (cases, small, wordy(spark)):
        assert got(collocations.collocations(df)) == sorted(plain(source(df)))
    assert got(collocations.collocations(empty)) == []
    assert got(collocations.collocations(small.select("text"))) == sorted(plain([(None, t) for _, t in source(small)]))


@pytest.mark.parametrize("words, piece", [(8, 1000), (0, 50), (10**6, 300)])
def test_short_dictionary_and_long_texts(spark, monkeypatch, words, piece):
    """Phrases that the dictionary lacks are counted as text; texts longer than a task's share are cut without losing a phrase."""
    monkeypatch.setattr(collocations, "DICTIONARY_WORDS", words)
    df = wordy(spark)
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 5)
    assert got(collocations.collocations(df, 5, 60, 40)) == sorted(plain(source(df), 5, 60, 40))
    import pyarrow as pa

    monkeypatch.setattr(collocations, "PIECE", piece)
    text = next(t for lang, t in source(df) if lang == "en" and t and len(t) > 9000 and "the" in t)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    parts = list(collocations._slices(iter([batch])))
    assert len(parts) > 3
    counts = Counter()
    for part in collocations._count_words(iter([batch])):
        counts.update(dict(zip(part.column("word").to_pylist(), part.column("n").to_pylist())))
    assert counts == Counter(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    pairs = Counter()
    for _, w, _, follows, seen in parts:
        w = w.to_pylist()
        pairs.update((w[i - 1], w[i]) for i in range(1, len(w)) if follows[i] and i >= seen)
    whole = Counter()
    for x in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
        w = re.findall(r"[^\x20\x09]+", x)
        whole.update(zip(w, w[1:]))
    assert pairs == whole


def test_query_over_the_whole_table(spark, small):  # noqa: F811
    assert got(queries.op13_phrase_collocations(spark, SF)) == sorted(plain(source(small)))
