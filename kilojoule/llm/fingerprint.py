"""Document fingerprints by consistent weighted sampling, with SQL functions only.

A text's terms are its lower-cased words, weighted by how often they occur. For a term with weight w and a random function, draw
r and c from Gamma(2, 1) and b from U(0, 1), all fixed by the term and the function; with t = floor(ln w / r + b), the term's cost is
c / (exp(r * (t - b)) * exp(r)). The sample of the function is the (term, t) of least cost: two texts have the same sample with a
probability equal to their generalised Jaccard similarity, the sum of smaller weights over the sum of larger weights.

The terms are stratified by hash into BINS, and each of ROUNDS functions samples every bin, so that a term is drawn ROUNDS times for
ROUNDS * BINS samples. The fingerprint also has each bin's total weight: with a collision rate j and totals u and v, a bin's larger
weights add up to (u + v) / (1 + j), u and v at least, and its smaller ones to j times that. The likeness is the sum of the one over
all bins by the sum of the other; for the larger weights alone, j is drawn to the mean of all bins by PRIOR of its rounds, since so few
rounds say little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoule.llm._shared import cut, key, own_id

ROUNDS = 4
BINS = 16
PRIOR = 2
#: Bits of a sample that a fingerprint keeps.
SAMPLE_BITS = 24


def _draw(term: str, weight: str, round_: int) -> Column:
    """Packed into one long that orders by cost, the cost and the sample of a term in a round."""
    two = lambda salt: (  # noqa: E731  two uniforms from one hash
        f"((shiftrightunsigned(xxhash64({term}, {round_}, {salt}), 32) + 0.5D) / 4294967296D)",
        f"(((xxhash64({term}, {round_}, {salt}) & 4294967295) + 0.5D) / 4294967296D)",
    )
    (u1, u2), (u3, u4), (u5, _) = two(1), two(2), two(3)
    r = f"(-ln({u1} * {u2}))"
    t = f"floor(ln(cast({weight} as double)) / {r} + {u5})"
    cost = f"(ln(-ln({u3} * {u4})) - {r} * ({t} - {u5}) - {r})"
    # costs lie well within -128..128
    order = f"cast(floor((greatest(least({cost}, 127D), -127D) + 128D) * 268435456D) as bigint)"
    return F.expr(f"(shiftleft({order}, {SAMPLE_BITS}) | (xxhash64({term}, {round_}, {t}) & {2**SAMPLE_BITS - 1}))")


def samples(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, bin, samples, total): what every round draws from each bin of a text, and the bin's weight; `by` names its row. A text without
    words has none."""
    words = texts.select(*by, F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("word")).where("word <> ''")
    weighted = words.select(*by, F.xxhash64("word").alias("term")).groupBy(*by, "term").agg(F.count("*").alias("weight"))
    # all rounds side by side: a term is one row, which its bin takes in once
    drawn = weighted.select(*by, F.expr(f"cast(pmod(xxhash64(term, 77), {BINS}) as int)").alias("bin"), *[_draw("term", "weight", k).alias(f"packed{k}") for k in range(ROUNDS)], "weight")
    least = drawn.groupBy(*by, "bin").agg(*[F.min(f"packed{k}").alias(f"packed{k}") for k in range(ROUNDS)], F.sum("weight").alias("total"))
    sample = F.array(*[F.expr(f"cast(packed{k} & {2**SAMPLE_BITS - 1} as int)") for k in range(ROUNDS)])
    return least.select(*by, "bin", sample.alias("samples"), F.expr(f"cast(least(total, {2**SAMPLE_BITS - 1}) as int)").alias("total"))


def _codes(kind: int | None) -> Column:
    """Aggregate over samples(): the sample of each bin, round by round, then each bin's total; -1 where there is none."""
    row = F.struct("bin", F.struct(*[F.element_at("samples", k + 1).alias(f"s{k}") for k in range(ROUNDS)], "total").alias("x"))
    found = F.map_from_entries(F.collect_list(row if kind is None else F.when(F.col("kind") == kind, row)))
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.try_element_at(found, i))
    of = lambda name: F.transform(bins, lambda x: F.coalesce(x[name], F.lit(-1)))
    return F.flatten(F.array(*[of(f"s{k}") for k in range(ROUNDS)], of("total")))


def likeness(a: str, b: str) -> Column:
    """The estimated generalised Jaccard similarity of two arrays of codes; 1 if neither text has any word."""
    equal = " + ".join(f"if({a}[i + {k * BINS}] = {b}[i + {k * BINS}], 1, 0)" for k in range(ROUNDS))
    u, v = (f"cast(greatest({x}[i + {ROUNDS * BINS}], 0) as double)" for x in (a, b))
    # an empty bin's samples are equal, but it weighs nothing
    bins = f"transform(sequence(0, {BINS - 1}), i -> named_struct('n', {equal}, 'u', {u}, 'v', {v}))"
    mean = "aggregate(bins, named_struct('low', 0D, 'high', 0D), (s, x) -> named_struct('low', s.low + x.n * (x.u + x.v), 'high', s.high + x.u + x.v), s -> if(s.high = 0, 0D, s.low / s.high))"
    most = f"greatest((x.u + x.v) / (1 + (x.n + {PRIOR / ROUNDS} * m) / {ROUNDS + PRIOR}), x.u, x.v)"
    sums = f"aggregate(bins, named_struct('low', 0D, 'high', 0D), (s, x) -> named_struct('low', s.low + x.n * {most} / {ROUNDS}, 'high', s.high + {most}), s -> if(s.high = 0, 1D, s.low / s.high))"
    # each value is worked out once, by way of an array of one
    return F.expr(f"transform(array({bins}), bins -> transform(array({mean}), m -> {sums})[0])[0]")


def hex_of(codes: str) -> Column:
    """A fingerprint as text: place and code of each filled place in hexadecimal, by place."""
    return F.expr(f"array_join(filter(transform({codes}, (c, i) -> if(c < 0, '', concat(lpad(lower(hex(i)), 2, '0'), lpad(lower(hex(c)), {SAMPLE_BITS // 4}, '0')))), x -> x <> ''), '')")


def _nothing() -> Column:
    return F.expr(f"array_repeat(-1, {(ROUNDS + 1) * BINS})")


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, next_key) for a column of distinct keys, ascending, the last one's next being the first: by ranges, each in a task."""
    ranged = cut(ids.repartitionByRange("key").select("key", F.spark_partition_id().alias("part")))
    led = ranged.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    # one row for each range
    starts = ranged.groupBy("part").agg(F.min("key").alias("start"))
    least = ranged.agg(F.min("key")).first()[0]
    after = starts.select("part", F.coalesce(F.lead("start").over(Window.orderBy("part")), F.lit(least).cast("long")).alias("after"))
    return led.join(F.broadcast(after), "part").select("key", F.coalesce("next_key", "after").alias("next_key"))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, fingerprint, codes): the fingerprint of every text; codes are what likeness() compares.

    Null counts as the empty text, whose fingerprint is empty. Equal texts have equal fingerprints, whatever their ids. Null and
    repeated ids keep their rows; other columns are ignored.
    """
    texts = documents.select(key(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.repartition("key").groupBy("key", "text").agg(F.count("*").alias("copies")).withColumn("th", F.xxhash64("text"))
    found = samples(texts, ["key", "th"]).groupBy("key", "th").agg(_codes(None).alias("codes"))
    out = texts.join(found, ["key", "th"], "left").withColumn("codes", F.coalesce("codes", _nothing()))
    out = out.select("*", F.explode(F.expr("sequence(1, copies)")))
    return out.select(own_id().alias("doc_id"), F.sha2("text", 256).alias("text_sha256"), hex_of("codes").alias("fingerprint"), "codes")


def edit_likeness(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, by ascending id, the last one's next being the first. Null counts as empty and a null id as the smallest. Among rows
    that repeat an id the smallest text is the one that others have as their next. Other columns are ignored.
    """
    texts = documents.select(key(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # without the texts: who is next, and how much of it is needed
    sizes = documents.select(key(id_col).alias("key"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("n")).groupBy("key").agg(F.max(F.expr("n div 2")).alias("need"))
    need = cut(next_ids(sizes.select("key")).join(sizes.hint("merge"), "key").select(F.col("next_key").alias("key"), F.col("key").alias("before"), "need"))
    texts = texts.repartition("key").groupBy("key", "text").agg(F.count("*").alias("copies"))
    nexts = texts.groupBy("key").agg(F.min("text").alias("text")).join(need.hint("merge"), "key")
    nexts = nexts.select(F.col("before").alias("key"), F.col("key").alias("next_key"), F.xxhash64("text").alias("next_th"), F.expr("left(text, cast(need as int))").alias("head"))
    both = texts.join(nexts.hint("merge"), "key").withColumn("n", F.length("text")).withColumn("th", F.xxhash64("text"))
    both = both.withColumn("edited", F.expr("concat(left(text, cast(n - n div 2 as int)), left(head, cast(n div 2 as int)))"))
    # both branches read the same columns, so that the shuffles of texts and heads are made once
    by = ["key", "th", "next_key", "next_th", "n", "copies"]
    kinds = both.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x")).select(*by, "x.kind", "x.text")
    drawn = samples(kinds, [*by, "kind"]).groupBy(*by).agg(_codes(0).alias("codes"), _codes(1).alias("edited_codes")).select("key", "th", "codes", "edited_codes")
    rows = both.select(*by, F.sha2("edited", 256).alias("edited_sha256"))  # texts without words have no samples
    done = cut(rows.join(drawn.hint("merge"), ["key", "th"], "left").select(*by, "edited_sha256", F.coalesce("codes", _nothing()).alias("codes"), F.coalesce("edited_codes", _nothing()).alias("edited_codes")), need)
    following = done.select(F.col("key").alias("next_key"), F.col("th").alias("next_th"), F.col("codes").alias("next_codes"))
    out = done.join(following.hint("merge"), ["next_key", "next_th"]).select("*", F.explode(F.expr("sequence(1, cast(copies as int))")))
    return out.select(
        own_id().alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", hex_of("codes").alias("fingerprint"), hex_of("edited_codes").alias("edited_fingerprint"),
        likeness("codes", "edited_codes").alias("near_edited"), likeness("codes", "next_codes").alias("near_next"),
    )
