import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import sharding


def least_capacity(sizes, k):
    """By trying every way to cut."""
    best = sum(sizes)
    for n in range(min(k, len(sizes))):
        for cuts in itertools.combinations(range(1, len(sizes)), n):
            edges = [0, *cuts, len(sizes)]
            best = min(best, max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])))
    return best


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_brute_force(docs_of, k):
    rng = random.Random(k)
    sizes = [rng.choice([0, 1, 3, 7, 7, 20, 40]) for _ in range(11)]
    rows = [(i, "x" * n) for i, n in enumerate(sizes)]
    rng.shuffle(rows)
    got = sorted((r.doc_id, r.shard, len(r.text)) for r in sharding.shard(docs_of(rows), shards=k).collect())
    shards = [s for _, s, _ in got]
    assert shards == sorted(shards) and shards[0] == 0 and max(shards) < k and set(shards) == set(range(max(shards) + 1))
    load = [sum(n for _, s, n in got if s == x) for x in range(k)]
    assert max(load) == least_capacity(sizes, k)


def test_odd_rows(odd, docs_of):
    df = odd.withColumn("shard", F.lit("x")).withColumn("shard_", F.lit(1))
    out = sharding.shard(df, shards=3).collect()
    assert len(out) == 10 and {r.shard for r in out if r.doc_id is None} == {max(r.shard for r in out)} and len({r.shard for r in out if r.doc_id == 1}) == 1
    assert sharding.shard(docs_of([])).collect() == []
    assert {r.shard for r in sharding.shard(docs_of([(1, None), (2, "")])).collect()} == {0}
    assert {r.shard for r in sharding.shard(docs_of([(None, "abc"), (None, "d")]), shards=2).collect()} == {0}
    assert [r.shard for r in sharding.shard(docs_of([(-5, "a"), (5, "b"), (None, "c")]), shards=3).orderBy(F.asc_nulls_last("doc_id")).collect()] == [0, 1, 2]


def test_ties_and_given_sizes(docs_of):
    out = sharding.shard(docs_of([(i, "x") for i in range(12)]), size=F.lit(5), shards=4).collect()
    assert sorted(r.shard for r in out) == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 3
