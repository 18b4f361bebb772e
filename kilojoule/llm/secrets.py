"""Secret scans: regular-expression rules over a trigram inverted index, with SQL functions only.

Each rule is a regular expression together with what is mandatory in it: an alternation of sets of literals, of which one set occurs
whole in every match. Their trigrams make the rule's Boolean query, (a AND b ...) OR (...). The index has a posting for each document
and trigram of any query; postings are intersected per document, and only documents whose query holds are verified with the rule's
expression. Rules without a mandatory literal of three characters scan all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilojoule.llm._shared import cut, join_checked, key, own_id


@dataclass(frozen=True)
class Rule:
    """kind; a Java regular expression; the literals one of which every match contains (none: scan); the group to measure and the
    least length it must have for a match to count."""

    kind: str
    pattern: str
    literals: tuple[str, ...] = ()
    group: int = 0
    least: int = 1


# The base kinds, in the order in which spans at the same place are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "api_key", "apikey"), 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", ("AKIA",), 0, 20),
    Rule("hex", r"[0-9a-f]+", (), 0, 24),
)
# Further kinds, by the public formats of widespread credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", ("AIza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
)


def trigram_query(rule: Rule) -> list[list[str]]:
    """The rule's query: of each literal all trigrams, lower-cased; one literal's must all occur. Empty: no query, scan."""
    if any(len(x) < 3 for x in rule.literals):
        return []
    return [sorted({x.lower()[i : i + 3] for i in range(len(x) - 2)}) for x in rule.literals]


def trigram_index(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, key, th): a posting for each text and trigram that a query asks for; letters of A-Z count as a-z."""
    asked = sorted({t for r in rules for q in trigram_query(r) for t in q})
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = F.array_compact(F.array([F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in asked]))
    return texts.select("key", "th", low.alias("low")).select("key", "th", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, th, rules): texts for which some rule's query holds, and the numbers of those rules."""
    asked = sorted({t for r in rules for q in trigram_query(r) for t in q})
    words = [asked[i : i + 62] for i in range(0, len(asked), 62)]
    bit = lambda part: F.coalesce(*[F.when(F.col("trigram") == t, F.lit(1 << i).cast("long")) for i, t in enumerate(part)], F.lit(0).cast("long"))
    met = index.groupBy("key", "th").agg(*[F.bit_or(bit(part)).alias(f"w{k}") for k, part in enumerate(words)])

    def holds(q: list[str]) -> Column:
        out = F.lit(True)
        for k, part in enumerate(words):
            mask = sum(1 << i for i, t in enumerate(part) if t in q)
            if mask:
                out = out & (F.col(f"w{k}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        return out

    numbers = []
    for n, r in enumerate(rules):
        query = trigram_query(r)
        if query:
            any_of = holds(query[0])
            for q in query[1:]:
                any_of = any_of | holds(q)
            numbers.append(F.when(any_of, F.lit(n)))
    return met.select("key", "th", F.array_compact(F.array(numbers)).alias("rules")).where("size(rules) > 0")


def spans_of(rule: Rule, number: int, text: str = "text") -> Column:
    """An array of (start, end, number) of the rule's matches that count, in code points, leftmost and not overlapping.

    split() gives what lies between matches and regexp_extract_all() the matches, so their lengths add up to the places.
    """
    p = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    gaps, found = f"transform(split({text}, '{p}', -1), x -> length(x))", f"transform(regexp_extract_all({text}, '{p}', 0), x -> length(x))"
    measured = found if rule.group == 0 else f"transform(regexp_extract_all({text}, '{p}', {rule.group}), x -> length(x))"
    pairs = f"zip_with(zip_with(slice({gaps}, 1, size({found})), {found}, (g, m) -> struct(g, m)), {measured}, (x, w) -> struct(x.g as g, x.m as m, w))"
    walked = (
        f"aggregate({pairs}, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,number:int>>)), "
        f"(acc, x) -> named_struct('at', acc.at + x.g + x.m, 'out', if(x.w >= {rule.least}, array_append(acc.out, named_struct('start', acc.at + x.g, 'end', acc.at + x.g + x.m, 'number', {number})), acc.out)), acc -> acc.out)"
    )
    return F.expr(walked)


def _scan(rule: Rule) -> Column:
    """Whether a rule without a query can have a match that counts; a run of the least length at least."""
    return F.col("text").rlike(f"{rule.pattern.removesuffix('+')}{{{rule.least}}}" if rule.pattern.endswith("]+") else rule.pattern)


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(key(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def secret_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(key, th, found): the spans of each id and text (th: its hash) that has any, as a table; see secret_scan()."""
    texts = _rows(documents, id_col, text_col)
    asked = cut(candidates(trigram_index(texts, rules), rules))
    full = [(n, r) for n, r in enumerate(rules) if not trigram_query(r)]
    scan = F.array_compact(F.array([F.when(_scan(r), F.lit(n)) for n, r in full])) if full else F.array().cast("array<int>")
    scanned = texts.select("key", "th", scan.alias("rules")).where("size(rules) > 0")
    due = cut(asked.union(scanned).groupBy("key", "th").agg(F.flatten(F.collect_list("rules")).alias("rules")), asked)
    verified = join_checked(texts.withColumn("row", F.struct("key", "th")), due.select(F.struct("key", "th").alias("row"), "rules"), "row", "inner")
    spans = F.concat(*[F.when(F.array_contains("rules", n), spans_of(r, n)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,number:int>>)")) for n, r in enumerate(rules)])
    kinds = F.array([F.lit(r.kind) for r in rules])
    spans = verified.select("key", "th", spans.alias("s")).where("size(s) > 0").dropDuplicates(["key", "th"])
    spans = spans.withColumn("kinds", kinds).select("key", "th", F.expr("transform(array_sort(s, (x, y) -> if(x.start <> y.start, x.start - y.start, x.number - y.number)), x -> named_struct('start', x.start, 'end', x.end, 'number', x.number, 'kind', element_at(kinds, x.number + 1)))").alias("found"))
    return cut(spans, due)


def secret_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(doc_id, found): for every document the spans found, an array of (start, end, number, kind) by start, then rule.

    Places are code points, ends exclusive. Null counts as empty and has none. Null and repeated ids keep their rows (rows with one
    id are told apart by their texts, equal rows share their spans); other columns are ignored.
    """
    spans = secret_spans(documents, id_col, text_col, rules)
    ids = _rows(documents, id_col, text_col).select(F.struct("key", "th").alias("row"))
    out = join_checked(ids, spans.select(F.struct("key", "th").alias("row"), "found"), "row", "left", 100_000)
    none = F.expr("cast(array() as array<struct<start:int,end:int,number:int,kind:string>>)")
    return out.select(own_id("row.key").alias("doc_id"), F.coalesce("found", none).alias("found"))


def listed(found: str, most: int | None = None) -> Column:
    """The spans as kind:start:end, comma-joined; only rules with a number below `most` if it is given."""
    kept = found if most is None else f"filter({found}, x -> x.number < {most})"
    return F.expr(f"array_join(transform({kept}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
