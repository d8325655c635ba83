import itertools

import numpy as np
from pyspark.sql import functions as F

from quern.llm import ann


def test_recall_and_exact_distances(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16)).astype(np.float32) + rng.normal(size=(6, 16)).astype(np.float32)[rng.integers(0, 6, 600)] * 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.neighbours(df, k=10).toPandas()
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :10]
    hits = sum(len(set(want[i]) & set(g.neighbour_id)) for i, g in got.groupby("vec_id"))
    assert hits / 6000 >= 0.9
    assert all(abs(r.distance - d[r.vec_id, r.neighbour_id]) < 1e-6 for r in got.itertuples()) and set(got["rank"]) == set(range(1, 11))


def test_perturbations_ascend():
    sets = ann.perturbations(4, 40)
    assert sets[0] == () and len(set(sets)) == len(sets) and sets[1] == (0,)
    assert all(not any(7 - p in s for p in s) for s in sets)
    k = 4  # expected squared distances of the nearest borders, in order
    z = [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, 2 * k + 1)]
    costs = [sum(z[p] for p in s) for s in sets]
    every = sorted(sum(z[p] for p in s) for n in range(2 * k + 1) for s in itertools.combinations(range(2 * k), n) if not any(7 - p in s for p in s))
    assert (np.diff(costs) > -1e-12).all() and np.allclose(costs, every[:40])


def brute(rows, k, every):
    """(vec_id, neighbour_id, rank, distance) by all distances; nulls first in ties."""
    out = []
    for a, (i, x) in enumerate(rows):
        if i is None or i % every:
            continue
        near = sorted((float(np.sqrt(((x.astype(float) - y.astype(float)) ** 2).sum())), -1 if j is None else j, j) for b, (j, y) in enumerate(rows) if a != b)
        out += [(i, j, r, d) for r, (d, _, j) in enumerate(near[:k], 1)]
    return out


def test_queries_copies_and_large_components(spark):
    """A vector that a third of the rows share, repeated rows, null ids and components of 1e18, against all distances."""
    rng = np.random.default_rng(9)
    copy = np.array([0.5, -0.5, 1.0, 0.0], np.float32)
    rows = [(i, copy if i % 3 == 0 else rng.normal(size=4).astype(np.float32)) for i in range(600)]
    rows += [(50, copy), (50, copy), (None, copy), (None, rows[1][1]), (1000, np.array([1e18, 0, 0, 0], np.float32)), (1050, np.array([1e18, 1, 0, 0], np.float32))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.neighbours(df, k=5, every=50, width=1e3).collect()]
    far = [g for g in got if g[0] in (1000, 1050)]
    near = sorted([g for g in got if g[0] < 1000], key=str)
    want = sorted([w for w in brute(rows, 5, 50) if w[0] < 1000], key=str)
    assert [(g[0], g[1], g[2]) for g in near] == [(w[0], w[1], w[2]) for w in want] and np.allclose([g[3] for g in near], [w[3] for w in want])
    assert {(g[0], g[1]) for g in far if g[2] == 1} == {(1000, 1050), (1050, 1000)}
    # with fitted widths
    fitted = [tuple(r) for r in ann.neighbours(df.where("vec_id < 1000"), k=5, every=50).collect()]
    exact = {w[:2] for w in brute([r for r in rows if r[0] is not None and r[0] < 1000], 5, 50)}
    assert len({g[:2] for g in fitted} & exact) >= 0.9 * len(exact)


def test_odd_rows(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [0.0, 0.9]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).withColumn("label", F.lit(0))
    got = [tuple(r) for r in ann.neighbours(df, k=2, width=50.0).orderBy("vec_id", "rank").collect()]
    assert {g[0] for g in got} == {None, 1, 2, 9} and len(got) == 10
    assert [g for g in got if g[0] == 2] == [(2, 1, 1, 0.0), (2, 1, 2, 0.0)]  # ties by id
    assert ann.neighbours(df.where("false")).collect() == [] and ann.neighbours(df.where("vec_id = 9")).collect() == []


def test_parts_and_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 50)
    monkeypatch.setattr(ann, "SHARD", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.neighbours(df, k=5).toPandas()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :5]
    assert sum(len(set(want[i]) & set(g.neighbour_id)) for i, g in got.groupby("vec_id")) / 1000 >= 0.9


def test_hot_buckets_have_shards_of_their_own(spark, monkeypatch):
    """All vectors in one bucket, which is spread over several shards; nothing is lost."""
    monkeypatch.setattr(ann, "SHARD", 40)
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 6)).astype(np.float32))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.neighbours(df, k=4, every=50, tables=3, projections=4, width=1e4, probes=3).collect()]
    want = brute(rows, 4, 50)
    assert {g[:3] for g in got} == {w[:3] for w in want} and len(got) == len(want)
