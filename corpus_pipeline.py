"""The corpus pipeline: stages over `documents`, each reading what the one before it wrote.

Language identification rejects documents without a letter or near no codeword; line
deduplication drops lines that many documents share, and documents of which nothing is
left; near-deduplication keeps one document of each group; secrets are replaced in the
texts; packing lays the rest out in training sequences.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrack.llm import langid, line_dedup, neardup, packing, secrets
from gridtrack.llm.common import read, staged, unused
from gridtrack.llm.queries import pack_params


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = unused(docs, "ecoc")
    out = langid.predict(docs, langid.train(docs), into)
    return out.where((F.col(into)["lang_pred"] != "und") & ~F.col(into)["ambiguous"]).select(*docs.columns)


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that was changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Six occurrences, and lines of 20 code points: what a few documents share, and brackets or one-word answers, stay in clean documents.
    into = unused(docs, "line_dedup")
    out = line_dedup.dedup_lines(docs, line_dedup.LineParams(repeats=6, least_exact=20), into)
    emptied = (F.col(into)["n_dropped"] > 0) & ~F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    return _sized(out.where(~emptied).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, rest, one = unused(docs, "kept_id"), unused(docs, "rest"), unused(docs, "one")
    keep = staged(neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(own)).distinct(), "kept")
    # Both ways deal the texts once, by id: the join and the grouping share it.
    some = docs.where("doc_id is not null").join(keep.hint("merge"), F.col("doc_id") == F.col(own), "left_semi")
    bare = docs.where("doc_id is null" if not keep.where(F.col(own).isNull()).isEmpty() else "false")
    # Rows of one id and text are one document, and so are copies without an id.
    other = F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(1).alias(one))
    parts = (rows.groupBy("doc_id", "text").agg(F.min(other).alias(rest)) for rows in (some, bare))
    return reduce(DataFrame.union, parts).select(*(c if c in ("doc_id", "text") else F.col(rest)[c].alias(c) for c in docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, pack_params())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: A model's verdict and tokenizer ids are not SQL; tests/llm checks ids and some rows of stages, not every stage's rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
