import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import near
from quern.llm.components import components


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def signatures_near(rng, n, spread):
    """Signatures around a few centres, of 0 to ``spread`` bits' distance."""
    centres = rng.integers(0, 2**63, (8, 2), dtype=np.uint64)
    out = centres[rng.integers(0, 8, n)].copy()
    for row in out:
        for bit in rng.choice(128, rng.integers(0, spread), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return np.unique(out, axis=0)


@pytest.mark.parametrize("run", [64, 3])
def test_all_pairs_within_the_distance(spark, monkeypatch, run):
    """The join connects what all pairs within the distance connect, with runs listed and with runs joined in place."""
    monkeypatch.setattr(near, "RUN", run)
    sig = signatures_near(np.random.default_rng(run), 250, 14)
    rows = [(i, *(int(x) for x in s.view(np.int64))) for i, s in enumerate(sig)]
    edges = near.near_edges(spark.createDataFrame(rows, "node long, hi long, lo long")).collect()
    d = near.distance(sig[:, None], sig[None])
    want = {(i, j) for i, j in itertools.combinations(range(len(sig)), 2) if d[i, j] <= near.DISTANCE}
    got = [(min(e.u, e.v), max(e.u, e.v)) for e in edges]
    assert groups(got) == groups(want)
    links = dict.fromkeys(range(len(sig)), 0)
    for e in edges:
        links[e.u] += e.mine
        links[e.v] += e.theirs
    assert links == {i: int((d[i] <= near.DISTANCE).sum()) - 1 for i in range(len(sig))}
    if run == 64:
        assert len(got) == len(set(got)) and set(got) == want  # each pair once


def test_larger_distances_are_refused(spark):
    with pytest.raises(ValueError):
        near.near_edges(spark.createDataFrame([], "node long, hi long, lo long"), 12)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: v for k, v in groups([p for p in pairs if p[0] != p[1]]).items() if k != v}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_copies_found_and_others_left(docs_of):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows, family = [], {}
    for g in range(30):
        base = [rng.choice(words) for _ in range(150)]
        for c in range(rng.choice([1, 2, 5])):
            text = list(base)
            for _ in range(min(c, 3)):
                text[rng.randrange(150)] = rng.choice(words)
            family[len(rows)] = g
            rows.append((len(rows), " ".join(text)))
    got = {r.doc_id: r.kept_id for r in near.duplicates(docs_of(rows)).collect()}
    first = {}
    for i, g in family.items():
        first.setdefault(g, i)
    assert got == {i: first[g] for i, g in family.items() if i != first[g]}
    assert near.kept(docs_of(rows)).count() == 30


def test_one_row_a_document(docs_of):
    """Classes, links between different signatures, and copies; exact copies are no links."""
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    texts = {5: " ".join(base), 6: " ".join(base), 7: " ".join(base[:-8] + [f"other{i}" for i in range(8)]), 8: "quite another text", 9: None, 10: ""}
    rows = {r.doc_id: r for r in near.classes(docs_of([*texts.items(), (None, "x")])).collect()}
    assert {i: (r.class_id, r.is_copy) for i, r in rows.items()} == {5: (5, False), 6: (5, True), 7: (5, True), 8: (8, False), 9: (9, False), 10: (10, False)}
    assert [rows[i].links for i in (8, 9, 10)] == [0, 0, 0] and rows[5].links == rows[6].links == rows[7].links == 1


def test_signature_is_minhash(spark):
    texts = ["a b c d e f", "f e d c b a", "a b c d e f g", "", None, "!!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.hi, r.lo) for r in near.signed_documents(df).collect()}
    assert {i for i, x in got.items() if x[0] is not None} == {0, 1, 2, 5} and got[0] == got[1]
    hashes = df.select("doc_id", near.shingles(F.col("text")).alias("h")).collect()
    for r in hashes:
        if got[r.doc_id][0] is not None:
            x = (np.array(r.h, np.int64).view(np.uint64) >> np.uint64(16)).astype(np.uint32)
            low = np.array([min((int(v) * int(a) + int(b)) % 2**32 for v in x) for a, b in zip(near._A, near._B)], np.uint64)
            bits = (near.mix(low, 77) >> np.uint64(63)).astype(np.uint8)
            assert tuple(int(v) for v in np.packbits(bits).view(np.int64)) == got[r.doc_id]


def test_odd_rows(odd, docs_of):
    df = odd.withColumn("kept_id", F.lit("x")).withColumn("hi", F.lit("y")).withColumn("node", F.lit(0)).withColumn("__gone", F.lit(5)).withColumn("gone_", F.lit(5))
    assert {(r.doc_id, r.kept_id) for r in near.duplicates(df).collect()} == {(6, 1)}
    assert near.kept(df).count() == 9 and near.kept(df).columns == df.columns
    assert near.duplicates(docs_of([])).collect() == [] and near.kept(docs_of([])).collect() == []
