"""The queries of the training-data operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilojoule.llm import bpe, collocations, decontaminate, fingerprint, html_text, jaccard_join, language_id, merkle, minhash_forest, quality, secrets, sentence_spans, substring_array


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file: WORD_BPE_PATH, or the installed package's."""
    if path := os.environ.get("WORD_BPE_PATH"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(table(spark, sf_dir, "documents"), tokenizer_path(), digest_only=True)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_array.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(table(spark, sf_dir, "pages"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(table(spark, sf_dir, "documents"))


def op7_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.sentence_span_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "kept_sha256", "removed")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    n = [F.expr(f"cast(size(filter(found, x -> x.number = {i})) as bigint)").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE_RULES)]
    return found.select("doc_id", *n, F.sha2(secrets.listed("found", len(secrets.BASE_RULES)), 256).alias("base_sha256"), secrets.listed("found").alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.merkle_manifest(table(spark, sf_dir, "documents"), changed={"text": tampered})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.minhash_forest(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_bpe, op3_suffix_array_dedup, op4_benchmark_decontamination, op5_html_extraction, op6_document_fingerprints, op7_sentence_span_dedup, op8_quality_classifier, op9_secret_scan, op10_language_id, op11_merkle_manifest, op12_minhash_neardup, op13_phrase_collocations)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _linked_sets(width: int) -> str:
    """The sets c (doc_id, n, rep, n_copies) of shingles and the components m (node, component): all pairs that share a shingle, then reachability."""
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS BIGINT[]) WHEN len(w) < {width} THEN [CAST(hash(array_to_string(w, ' ')) % 4611686018427387904 AS BIGINT)]
              ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: CAST(hash(array_to_string(w[i:i + {width} - 1], ' ')) % 4611686018427387904 AS BIGINT)) END) AS h FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        g AS (SELECT doc_id, n, list_sort(list(h)) AS hs FROM s JOIN n USING (doc_id) GROUP BY 1, 2),
        c AS (SELECT *, min(doc_id) OVER (PARTITION BY hs) AS rep, count(*) OVER (PARTITION BY hs) AS n_copies FROM g),
        r AS (SELECT s.doc_id, s.h, c.n FROM s JOIN c ON s.doc_id = c.doc_id AND c.rep = c.doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.h = b.h AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        t AS (SELECT rep AS node, rep AS reached FROM c WHERE rep = doc_id UNION SELECT t.node, e.b FROM t JOIN e ON t.reached = e.a),
        m AS (SELECT node, min(reached) AS component FROM t GROUP BY 1)"""


_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT)),
    lambda crc, x: list_reduce(list_transform(range(8), lambda k: CAST(k AS UBIGINT)), lambda y, k: xor(y >> 1, (y & 1) * 3988292384), xor(crc, x)), CAST(4294967295 AS UBIGINT)), 4294967295)"""
#: Of a tree's levels t (g, l, i, n, h): each node's siblings to its left and right, where a level has several nodes.
_SIBLINGS = lambda t: f"""SELECT a.g, a.l, a.i, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i) AS lo, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i) AS hi
    FROM {t} a JOIN {t} b ON a.g = b.g AND a.l = b.l AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY 1, 2, 3"""  # noqa: E731
_UP = lambda t, first: f"{t} AS ({first} UNION ALL SELECT g, l + 1, i // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY g, l, i // 3)"
_FOLD = lambda f, first, s: f"{f} AS ({first} UNION ALL SELECT doc_id, g, {s}.l + 1, {s}.i // 3, sha256(coalesce(lo, '') || h || coalesce(hi, '')), path || coalesce(lo, '') || coalesce(hi, '') FROM {f} JOIN {s} USING (g, l, i))"
ORACLE_SQL: dict[str, str] = {
    # every phrase as text, all counts by grouping
    "op13_phrase_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        u AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY 1, 2), t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM u GROUP BY 1),
        g2 AS (SELECT lang, x, y, count(*) AS a FROM (SELECT lang, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM w WHERE len(w) >= 2) GROUP BY ALL HAVING count(*) >= 10),
        g3 AS (SELECT lang, x, y, z, count(*) AS a FROM (SELECT lang, unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM w WHERE len(w) >= 3) GROUP BY ALL HAVING count(*) >= 10),
        longer AS (SELECT lang, x, y, max(a) AS longest FROM (SELECT lang, x, y, a FROM g3 UNION ALL SELECT lang, y, z, a FROM g3) GROUP BY ALL),
        c AS (SELECT lang, x || ' ' || y AS phrase, a, b.f AS l, e.f AS r, 1 AS k FROM g2 LEFT JOIN longer USING (lang, x, y) JOIN (SELECT lang, x, f FROM u) b USING (lang, x) JOIN (SELECT lang, x AS y, f FROM u) e USING (lang, y) WHERE longest IS NULL OR 100 * longest < 50 * a
          UNION ALL SELECT g3.lang, g3.x || ' ' || g3.y || ' ' || z, g3.a, u.f, g2.a, 1 FROM g3 JOIN u ON u.lang = g3.lang AND u.x = g3.x JOIN g2 ON g2.lang = g3.lang AND g2.x = g3.y AND g2.y = z
          UNION ALL SELECT g3.lang, g3.x || ' ' || g3.y || ' ' || z, g3.a, g2.a, u.f, 2 FROM g3 JOIN u ON u.lang = g3.lang AND u.x = z JOIN g2 ON g2.lang = g3.lang AND g2.x = g3.x AND g2.y = g3.y),
        s AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM c), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM q JOIN t USING (lang) WHERE rank <= 2000""",
    # levels by recursion, each node's siblings by a join, and every record folded upwards
    "op11_merkle_manifest": f"""
        WITH RECURSIVE c AS (SELECT *, {_CRC} % 2 = 0 AS hit, coalesce('s' || source, '') AS name FROM documents),
        d AS (SELECT doc_id, name, {_LEAF("text")} AS leaf, CASE WHEN hit THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS now FROM c),
        e AS (SELECT *, dense_rank() OVER (ORDER BY name) - 1 AS g, row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM d),
        {_UP("t", "SELECT g, 0 AS l, i, n, leaf AS h FROM e")}, r AS (SELECT g, h FROM t WHERE n = 1),
        {_UP("u", "SELECT 0 AS g, 0 AS l, g AS i, count(*) OVER () AS n, h FROM r")}, q AS (SELECT h FROM u WHERE n = 1),
        s AS ({_SIBLINGS("t")}), v AS ({_SIBLINGS("u")}),
        {_FOLD("f", "SELECT doc_id, g, 0 AS l, i, now AS h, '' AS path FROM e", "s")}, o AS (SELECT doc_id, arg_max(g, l) AS g, arg_max(h, l) AS h, arg_max(path, l) AS path FROM f GROUP BY 1),
        {_FOLD("w", "SELECT doc_id, 0 AS g, 0 AS l, g AS i, h, path FROM o", "v")}, x AS (SELECT doc_id, arg_max(h, l) AS h, arg_max(path, l) AS path FROM w GROUP BY 1)
        SELECT e.doc_id, e.leaf, r.h AS subroot, q.h AS root, sha256(x.path) AS proof_sha256, x.h AS folded_root, x.h = q.h AS verified FROM e JOIN r USING (g) JOIN x USING (doc_id) CROSS JOIN q""",
    "op1_ngram_jaccard_join": _linked_sets(5)
    + " SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(c.n_copies, 1) AS n_copies FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.node = c.rep",
    "op12_minhash_neardup": _linked_sets(4)
    + " SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(m.component, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.node = c.rep",
}
