import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import lines


def brute(rows):
    """The first occurrence by (doc_id, line) stays; rows of one id are one document."""
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r"):
                first.setdefault(line.strip(" \t\r"), i)
    out = []
    for i, t in rows:
        kept, seen, gone = [], set(), 0
        for line in (t or "").split("\n"):
            key = line.strip(" \t\r")
            if key and (first[key] != i or key in seen):
                gone += 1
            else:
                kept.append(line)
            seen.add(key)
        out.append((i, None if t is None else "\n".join(kept), gone))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_lines", [500_000, 20])
def test_brute_force(docs_of, shard_lines):
    rng = np.random.default_rng(1)
    rows = [(int(i), "\n".join(f"line {rng.integers(0, 60)}" + rng.choice(["", " ", "\r", "\t\r"]) if rng.random() < 0.8 else "" for _ in range(rng.integers(0, 12)))) for i in range(80)]
    got = sorted(((r.doc_id, r.text, r.lines_removed) for r in lines.dedup(docs_of(rows), shard_lines).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(odd, docs_of):
    df = odd.withColumn("lines_removed", F.lit("x")).withColumn("keep_", F.lit(1))
    got = sorted(((r.doc_id, r.text, r.lines_removed) for r in lines.dedup(df).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert lines.dedup(docs_of([])).collect() == [] and lines.dedup(docs_of([(1, None)])).first().lines_removed == 0


@pytest.mark.parametrize("n", [0, 1, 2, 100, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    h = lines.PerfectHash.build(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    if n == 50_000:
        assert 64 * len(h.bits) < 6 * n  # bits a key
        assert (lines.PerfectHash(h.bits, h.ranks, h.levels, h.rest).index(keys) == h.index(keys)).all()


def test_rest_of_the_levels(monkeypatch):
    monkeypatch.setattr(lines, "LEVELS", 1)
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 1000, dtype=np.uint64))
    h = lines.PerfectHash.build(keys)
    assert len(h.rest) and sorted(h.index(keys).tolist()) == list(range(len(keys)))
    assert (h.index(keys + np.uint64(1))[np.isin(keys + np.uint64(1), keys, invert=True)] < len(keys)).all()


def test_lines_that_share_a_hash(docs_of, monkeypatch):
    """Fingerprints come from another function, so that such lines are told apart."""
    monkeypatch.setattr(lines, "line_hash", lambda x: F.pmod(F.xxhash64(x), F.lit(7)))
    rows = [(i, "\n".join(f"line {(i * k) % 23}" for k in range(1, 6))) for i in range(30)]
    got = sorted(((r.doc_id, r.text, r.lines_removed) for r in lines.dedup(docs_of(rows), 20).collect()), key=str)
    assert got == brute(rows)
