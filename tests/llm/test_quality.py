import numpy as np
import xxhash
from pyspark.sql import functions as F

from quern.llm import quality


def corpus(docs_of, labels_of):
    good = [(i, f"clear prose about rivers and hills number {i % 7} flows on") for i in range(40)]
    bad = [(100 + i, "buy now buy now click here win win " + "x" * (i % 5)) for i in range(20)]
    return docs_of(good + bad), labels_of([(i, 1, 0) for i, _ in good[:20]] + [(i, 0, 0) for i, _ in bad[:10]])


def test_parts_good_from_bad(docs_of, labels_of):
    docs, labels = corpus(docs_of, labels_of)
    kept = {r.doc_id for r in quality.kept(docs, labels).collect()}
    assert kept == set(range(40))


def test_brute_force(spark, docs_of, labels_of):
    docs, labels = corpus(docs_of, labels_of)
    weights, threshold = quality.fit(docs, labels)
    h = lambda *xs: xs  # noqa: E731,F841
    rows = docs.select("doc_id", quality.features(F.col("text")).alias("f")).collect()
    n = quality.BUCKETS
    raw, target = np.zeros(n), np.zeros(n)
    label = {r.doc_id: r.quality for r in labels.collect()}
    for r in rows:
        for b in r.f:
            raw[b] += 1
            target[b] += label.get(r.doc_id) == 1
    want = np.round(np.log((target + 1) / (target.sum() + n)) - np.log((raw + 1) / (raw.sum() + n)), 6)
    assert np.abs(weights - want).max() < 2e-6
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    for r in rows:
        s = float(np.mean(want[r.f]))
        assert abs(got[r.doc_id].quality_score - s) < 1e-4 and got[r.doc_id].quality_keep == (got[r.doc_id].quality_score >= threshold)


def test_threshold_against_brute_force(docs_of, labels_of):
    """Of all cuts between the labelled scores the lowest good document that parts best, midway to the bad one below it."""
    rng = np.random.default_rng(8)
    words = ["river", "hill", "stone", "light", "buy", "now", "click", "win"]
    rows = [(i, " ".join(rng.choice(words, 12, p=[0.15] * 4 + [0.1] * 4 if i % 3 else [0.12] * 4 + [0.13] * 4))) for i in range(120)]
    docs, labels = docs_of(rows), labels_of([(i, int(i % 3 > 0), 0) for i in range(60)])
    scores = {r.doc_id: r.quality_score for r in quality.quality(docs, labels).collect()}
    good, bad = [scores[i] for i in range(60) if i % 3], [scores[i] for i in range(60) if not i % 3]
    gain = lambda t: sum(s >= t for s in good) / len(good) - sum(s >= t for s in bad) / len(bad)
    best = min(good, key=lambda t: (-round(gain(t), 12), t))
    below = [s for s in bad if s < best]
    want = (best + max(below)) / 2 if below else best
    assert abs(quality.fit(docs, labels)[1] - want) < 1e-9 and 0 < len(below) < len(bad)
    # rows of a labelled id count once, however many there are
    again = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 3"))
    weights, threshold = quality.fit(again, labels)
    assert threshold != float("-inf") and len(weights) == quality.BUCKETS


def test_features(spark):
    row = spark.createDataFrame([("ab cd cd",)], "text string").select(quality.features(F.col("text")).alias("f")).first().f
    token = lambda w: (xxhash.xxh64_intdigest(w.encode(), seed=42) + 2**63) % 2**64 - 2**63
    assert row[:2] == [token("ab") % quality.BUCKETS, token("cd") % quality.BUCKETS] and row[2] == quality.REPEAT % quality.BUCKETS and len(row) == 5


def test_odd_rows(odd, docs_of, labels_of):
    df = odd.withColumn("quality_score", F.lit("x")).withColumn("QUALITY_KEEP", F.lit(1))
    labels = labels_of([(1, 1, 0), (1, 0, 0), (6, 1, None), (5, 0, 0), (None, 1, 1), (99, 1, 0)])
    out = quality.quality(df, labels).collect()
    assert len(out) == 10 and out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "quality_score", "quality_keep"}
    for r in out:
        assert (r.quality_score is None) == (r.text in (None, "")) and (r.quality_keep is False or r.quality_score is not None)
    same = {(r.quality_score, r.quality_keep) for r in out if r.text and r.text.startswith("the cat")}
    assert len(same) == 1
    assert quality.quality(docs_of([]), labels).collect() == []
    free = quality.quality(odd, labels_of([])).collect()
    assert all(r.quality_keep == bool(r.text) for r in free) and quality.kept(odd, labels_of([])).count() == 7
    assert quality.quality(odd, labels_of([(1, 1, 0)])).count() == 10  # good ones alone
