"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import lines, near, packing, pii, quality
from quern.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text, null for a null one."""
    return df.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose log-likelihood ratio reaches the threshold; null and token-free texts go. Extra columns are dropped, nulls elsewhere stay."""
    return _documents(quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of lines; a document all of whose lines were said before goes, one empty from the start stays."""
    out = lines.dedup(docs)
    return _documents(out.where(~F.coalesce(lines.emptied(F.col("text"), F.col("lines_removed")), F.lit(False))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least doc_id; null ids, null and empty texts stay."""
    return _documents(near.kept(docs))


def private_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with private spans replaced by their kind; no document goes."""
    return _documents(pii.redact(docs))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies, in tokens of the BPE; null and empty texts take no place."""
    return packing.packed(packing.tokenised(docs), F.col("n_tokens"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("pii", private_spans), ("packing", windows)]

#: Hashed features, signatures and trained classifiers aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark, 'pipeline')}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
