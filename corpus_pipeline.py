"""A corpus in five stages, each written and read again before the next."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_batches, table
from tallyframe.llm.decontaminate import drop_contaminated
from tallyframe.llm.language_id import UND, fit_language_model, language_udf
from tallyframe.llm.mixing import mix_sources
from tallyframe.llm.near_copies import one_of_each
from tallyframe.llm.secret_scan import learn_formats, redact_secrets

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told: those without a letter, null texts included."""
    bounded_batches(spark)
    found = language_udf(docs, fit_language_model(docs))(F.col("text"))
    judged = docs.select(*DOCUMENT_COLUMNS, found.alias("_found"))
    return judged.where(F.col("_found.lang_pred") != UND).select(*DOCUMENT_COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id, or without an id if none has one.

    Classes link by SimHash fingerprints as op6's do, and by similar sets of shingles between those.
    """
    return one_of_each(docs.select(*DOCUMENT_COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark passage."""
    return drop_contaminated(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; the documents stay."""
    clean = redact_secrets(docs.select(*DOCUMENT_COLUMNS), learn_formats(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document that the mix takes, once, with its size and the words taken (repeats counted)."""
    return mix_sources(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
]

#: SQL has no fingerprints, alignment or automata; the stages are tested against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage, wherever Spark keeps it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the cluster's shared folder, and removed once it is used.

    The last stage reads its input while it is made (it stores sizes by document), so nothing of the folder is left after it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    folder = os.path.join(shared, f"corpus-{uuid.uuid4().hex}")
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}_{name}")
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    remove(spark, folder)
    return docs
