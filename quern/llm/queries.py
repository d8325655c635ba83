"""The queries of this subpackage, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, bpe, lines, lm, near, packing, pii, quality, sharding, toxic


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they decode to its text."""
    ranks = bpe.RankMap(bpe.load_ranks())
    coded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    return coded.select("doc_id", "ids", F.size("ids").alias("n_tokens"), (bpe.decode(F.col("ids"), ranks) == F.col("text")).alias("round_trip"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "quality_score", "quality_keep")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "toxic_score", "toxic")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all rows to every row whose id is divisible by 50."""
    return ann.neighbours(read(spark, sf_dir, "embeddings"), every=50)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), lm.ORDER).select("doc_id", "lm_words", "perplexity")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document, and how many different signatures it is linked with."""
    return near.classes(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents")).select("doc_id", "shard")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.tokenised(read(spark, sf_dir, "documents")), F.col("n_tokens"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_toxicity, op4_ann, op5_lm_scoring, op6_pii, op7_line_dedup, op8_near_dedup, op9_sharding, op10_packing)}

SQL = {
    "op7_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY trim(line, ' ' || chr(9) || chr(13)) ORDER BY doc_id NULLS LAST, pos) AS k FROM lines),
        kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k = 1 OR trim(line, ' ' || chr(9) || chr(13)) = '') AS text,
                   count(*) FILTER (WHERE k > 1 AND trim(line, ' ' || chr(9) || chr(13)) <> '') AS n
            FROM ranked GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(k.n, 0) AS INTEGER) AS lines_removed
        FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
}
