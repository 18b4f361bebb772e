"""A corpus from raw documents to tokens: quality, near duplicates, benchmark items, secrets, tokens.

Each stage works on all that its predecessor kept; run() writes what a stage returns as Parquet and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilojoule.llm._shared import cut, join_checked, key, shared_folder
from kilojoule.llm.bpe import bpe
from kilojoule.llm.decontaminate import decontaminate
from kilojoule.llm.jaccard_join import jaccard_join
from kilojoule.llm.quality import quality_scores
from kilojoule.llm.queries import table, tokenizer_path
from kilojoule.llm.secrets import secret_spans


def _keyed(docs: DataFrame, *also: str) -> DataFrame:
    """(_row, _doc, doc_id, text) and `also`: each row whole in _doc, so that no column of its can clash, under a key for its id and text.

    Ids may be null or repeated; `also` names columns that tell rows apart, too. Missing ones are null.
    """
    rows = docs.select(F.struct("*").alias("_doc"))
    column = lambda c: (F.col(f"_doc.{c}") if c in docs.columns else F.lit(None).cast("string")).alias(c)
    named = rows.select("_doc", *map(column, ("doc_id", "text", *also)))
    return named.withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in also]))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The keyed rows whose _row isn't in `gone`; that is written first, since its size decides how it is joined."""
    return join_checked(rows, cut(gone.select("_row").distinct()), "_row", "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier keeps; each row by its own score, null ids and texts, repeated ids and repeated rows included.

    An empty table stays empty.
    """
    rows = _keyed(docs, "lang", "source")
    scored = quality_scores(rows.drop("_doc"), table(spark, sf_dir, "labels"), row_col="_row")
    return _without(rows, scored.where("not keep")).select("_doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row of the smallest id stays, whatever other texts have that id.

    Null ids count as one id, the smallest. Texts without words have no group; each stays, rows of one id and text once (any one of
    them, if other columns differ). An empty table stays empty.
    """
    rows = _keyed(docs)
    groups = jaccard_join(rows, "_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).groupBy("_row", "_group").agg(F.count("*").alias("_n"))
    groups = cut(groups.join(rows.select("_row", key("doc_id").alias("_id")).distinct().hint("merge"), "_row"))
    heads = groups.groupBy("_group").agg(F.min(F.struct("_id", "_row")).alias("_head"), F.count("*").alias("_size")).where("_size > 1")
    gone = groups.join(heads.hint("merge"), "_group").where("_row <> _head._row").select("_row")
    kept = _without(rows, gone)
    # rows of one id and text are one document
    repeated = cut(groups.where("_n > 1").select("_row"))
    once = _without(kept, repeated)
    again = join_checked(kept, repeated, "_row", "left_semi").groupBy("_row").agg(F.first("_doc").alias("_doc"))
    return once.select("_doc.*").unionByName(again.select("_doc.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item, each by its own text; null and empty texts hold none. An empty table stays empty."""
    rows = _keyed(docs)
    held = decontaminate(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, held.select(F.col("doc_id").alias("_row"))).select("_doc.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [kind] in the place of every secret found; n_chars follows, if it is there. Rows that share an id keep their own texts.

    Null and empty texts stay as they are, as does an empty table.
    """
    rows = _keyed(docs)
    found = secret_spans(rows, "_row").select(F.col("key").alias("_row"), "found")
    walked = (
        "aggregate(found, named_struct('at', 0, 'out', ''), (a, x) -> if(x.start < a.at, named_struct('at', greatest(a.at, x.end), 'out', a.out), "
        "named_struct('at', x.end, 'out', concat(a.out, substring(text, a.at + 1, x.start - a.at), '[', x.kind, ']'))), a -> concat(a.out, substring(text, a.at + 1)))"
    )
    both = join_checked(rows, found, "_row", "left", 100_000).select("_doc", F.when(F.col("found").isNotNull(), F.expr(walked)).alias("_text"))
    own = {"text": F.coalesce("_text", F.col("_doc.text"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.coalesce(F.length("_text").cast(docs.schema["n_chars"].dataType), F.col("_doc.n_chars"))
    return both.select(*[(own[c] if c in own else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row that is left; null and empty texts have no tokens."""
    return bpe(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", bpe_stage),
]
#: A trained classifier, an edit distance over windows and a tokenizer: beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
