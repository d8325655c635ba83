from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import packing
from tests.llm.test_packing import TIERS, check


@pytest.mark.parametrize("together, more", [(20, 1.02), (1, 1.05)])
def test_buckets_share_gaps_and_steps(spark, monkeypatch, together, more):
    """Several buckets fill windows and steps as well as one."""
    monkeypatch.setattr(packing, "TOGETHER", together)
    rng = np.random.default_rng(0)
    lengths = {i: int(n) for i, n in enumerate(rng.integers(1, 300, 200))}
    df = spark.createDataFrame(list(lengths.items()), "doc_id long, n long")
    windows = check(packing.packed(df, F.col("n"), TIERS, step_tokens=256, bucket=20).collect(), lengths)
    one = check(packing.packed(df, F.col("n"), TIERS, step_tokens=256).collect(), lengths)
    room = lambda ws: sum(p[0][2] for p in ws.values())
    assert sum(lengths.values()) / room(windows) > 0.95 and room(windows) <= more * room(one)
    steps = defaultdict(lambda: defaultdict(list))
    for parts in windows.values():
        steps[parts[0][2]][parts[0][3]].append(sum(p[1] for p in parts))
    for t, of in steps.items():
        sizes = [len(x) for x in of.values()]
        n, most = sum(sizes), max(1, 256 // t)
        assert len(of) == -(-n // most) and max(sizes) - min(sizes) <= 1 and max(sizes) <= most
    assert len({s for of in steps.values() for s in of}) == sum(map(len, steps.values()))
