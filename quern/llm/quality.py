"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text, thresholded for every document."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, let, number_list, put, words

BUCKETS = 1 << 16
#: At most so many labelled documents, those of least hash, are the trusted sample and set the threshold.
LABELLED = 20_000
TOKENS = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
REPEAT = -7_046_029_254_386_353_131


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all unigrams and bigrams; a token equal to the one before it counts as a repeat, whatever it is."""
    hashes = F.transform(words(text, TOKENS), lambda t: F.xxhash64(t))
    marked = let(hashes, lambda a: F.zip_with(a, F.slice(F.concat(F.array(F.lit(0).cast("long")), a), F.lit(1), F.size(a)), lambda x, p: F.when(x == p, F.lit(REPEAT)).otherwise(x)))
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    pairs = lambda a: F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: bucket(F.xxhash64(x, y)))
    return let(marked, lambda a: F.concat(F.transform(a, bucket), pairs(a)))


def labelled_sample(labels: DataFrame, column: str, most: int, docs: DataFrame) -> DataFrame:
    """(id, label) of at most ``most`` labelled documents, those of least hash; the lower label holds where rows disagree."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy(F.col("doc_id").alias("__id")).agg(F.min(column).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(most)
    )


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED) -> tuple[np.ndarray, float]:
    """Log-ratio by bucket, and the threshold.

    Raw counts are of all documents; target counts of the labelled sample's good ones. Add-one smoothing in
    each multinomial. The threshold is the score that best parts the sample's good and bad documents (true
    positive less false positive rate, the lowest such score); without bad ones it is below all good ones'
    scores, without good ones nothing is rejected. Of several rows of a labelled id the least score counts."""
    sample = labelled_sample(labels, "quality", labelled, docs).collect()  # bounded by `labelled`
    spark = docs.sparkSession
    known = spark.createDataFrame([(r[0], r[1]) for r in sample], "__id long, __label int")
    marked = docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text")).join(F.broadcast(known), F.col("__doc") == F.col("__id"), "left")
    counts = (
        marked.select("__label", F.explode(features(F.col("__text"), buckets)).alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("__label") == 1, 1)).alias("target"))
        .collect()  # one row a bucket
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in counts:
        raw[b], target[b] = r, t
    weights = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    weights = np.round(weights, 6)
    if not any(r[1] == 1 for r in sample):
        return np.zeros(buckets), float("-inf")
    scored = marked.where(F.col("__label").isNotNull()).select("__doc", "__label", score(F.col("__text"), weights).alias("s"))
    scored = scored.groupBy("__doc", "__label").agg(F.min("s").alias("s")).toPandas().dropna()  # a row a labelled id; a filter on scores would go below the join and score every document
    good, bad = np.sort(scored.s[scored["__label"] == 1].to_numpy()), np.sort(scored.s[scored["__label"] == 0].to_numpy())
    if not len(good):
        return weights, float("-inf")
    if not len(bad):
        return weights, float(good[0])
    at = np.unique(good)
    gain = (1 - np.searchsorted(good, at, "left") / len(good)) - (1 - np.searchsorted(bad, at, "left") / len(bad))
    best = at[int(np.argmax(gain))]
    below = bad[: np.searchsorted(bad, best, "left")]
    return weights, float((best + below[-1]) / 2 if len(below) else best)


def score(text: Column, weights: np.ndarray) -> Column:
    """Mean log-ratio of the features; null for a text without any."""
    table = number_list((f"{w:.6f}" for w in weights), "float")
    return let(features(text, len(weights)), lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.size(a)))


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED) -> DataFrame:
    """``docs`` with ``quality_score`` (double) and ``quality_keep`` (boolean).

    A row is judged by its text alone, so repeated rows agree and ties at the threshold are kept. A null text,
    or one without any token, has a null score and isn't kept. An id is only needed to find labels: rows of a
    null id are scored too. Columns named as the two results are replaced; all others stay. Without documents
    the result is empty; without labels everything with a token is kept, at score 0."""
    weights, threshold = fit(docs, labels, buckets, labelled)
    s, k = fresh(docs, "quality_score_", "quality_keep_")
    value = F.col(f"`{s}`")
    keep = value.isNotNull() if threshold == float("-inf") else F.coalesce(value >= F.lit(threshold), F.lit(False))
    with_score = docs.withColumn(s, score(F.col("text"), weights))
    return put(with_score, {"quality_score": value, "quality_keep": keep}).drop(s, k)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they are."""
    weights, threshold = fit(docs, labels)
    value = F.coalesce(score(F.col("text"), weights), F.lit(float("-inf")))
    return docs.where((value >= F.lit(threshold)) & (value > F.lit(float("-inf"))))
