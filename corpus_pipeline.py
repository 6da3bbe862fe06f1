"""Corpus pipeline: from raw documents to a weighted mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on every document that the
stage before kept, and returns the columns of ``documents``; only the last
adds columns. Between stages the documents are written as Parquet in the
shared checkpoint folder and read again, so a lost executor costs one stage's
tasks and never an earlier stage.

1. ``language`` learns from the labelled rows that are not held out and drops
   documents without a letter, those whose best language has a posterior
   under 0.5, and those whose n-grams are on average more than 1.75 standard
   deviations less likely than that language's own (other languages, random
   letters). If no row is labelled it drops nothing.
2. ``lines`` rewrites texts without the lines that a smaller doc_id holds
   (n_chars follows the text) and drops documents that lose all their lines.
   Documents that were empty before stay.
3. ``near_duplicates`` keeps the least doc_id of each class of 5-word
   shingle sets at a similarity of 0.8; empty documents link with nothing.
4. ``decontaminate`` drops documents that hold a benchmark window.
5. ``mix`` allots copies per source and returns documents with at least one.

Rows without a doc_id pass the stages that compare documents. Extra columns
pass through all stages, whatever their names; only the columns that the last
stage adds replace columns so named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startlens.llm import langid, line_dedup, minhash, mixing, suffix_decon
from startlens.llm.text import doc_bucket
from startlens.session import materialize

MIN_POSTERIOR = 0.5
MIN_FIT = -1.75


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one with which no column of ``docs`` begins."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(doc_bucket("doc_id", 5) != 0))
    if not model.labels:
        return docs
    r = unused(docs, "__language")
    found = docs.withColumn(r, langid.predict(spark, model, F.col("text")))
    likely = (F.col(f"{r}.score") >= MIN_POSTERIOR) & (F.col(f"{r}.fit") >= MIN_FIT)
    kept = found.where((F.col(f"{r}.lang_pred") != "und") & likely)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = unused(docs, "__")
    out = line_dedup.dedup_lines(docs, prefix=p)
    out = out.where(F.col(f"{p}n_dropped") < F.col(f"{p}n_lines"))
    changed = F.col(f"{p}n_dropped") > 0
    new = {
        "text": F.col(f"{p}kept_text"),
        "n_chars": F.when(changed, F.length(f"{p}kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs.select("doc_id", "text"), width=5)
    name = unused(docs, "__gone")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct().hint("shuffle_hash")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = unused(docs, "__matches")
    found = suffix_decon.find_matches(spark, docs, benchmark, name)
    return found.where(F.col(f"{name}.n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, keep_rows=True).where("copies > 0")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Stage 1 is a trained classifier, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
