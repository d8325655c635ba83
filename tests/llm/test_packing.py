from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import packing

TIERS = (8, 32, 128)


def check(rows, lengths, tiers=TIERS):
    """Every token of every document once, windows without overlap, tiers as small as may be or in a gap of a longer window."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.n_tokens))
    for i, n in lengths.items():
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at
            at += size
        assert at == n
    windows = defaultdict(list)
    for r in rows:
        windows[r.window].append((r.offset, r.n_tokens, r.tier, r.step))
    for parts in windows.values():
        at = 0
        assert len({p[2] for p in parts}) == 1 and len({p[3] for p in parts}) == 1
        for offset, n, _, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= parts[0][2]
    return windows


@pytest.mark.parametrize("bucket", [50_000, 40])
def test_whole_and_tight(spark, docs_of, bucket):
    rng = np.random.default_rng(0)
    lengths = {i: int(n) for i, n in enumerate(rng.integers(1, 300, 200))}
    df = spark.createDataFrame(list(lengths.items()), "doc_id long, n long").withColumn("text", F.lit("x"))
    rows = packing.packed(df, F.col("n"), TIERS, step_tokens=256, bucket=bucket).collect()
    windows = check(rows, lengths)
    used, room = sum(r.n_tokens for r in rows), sum(p[0][2] for p in windows.values())
    assert used / room > (0.95 if bucket > 1000 else 0.85)
    steps = defaultdict(lambda: defaultdict(int))
    for parts in windows.values():
        steps[parts[0][2], parts[0][3]]["n"] += 1
        steps[parts[0][2], parts[0][3]]["tokens"] += sum(p[1] for p in parts)
    if bucket > 1000:
        for t in TIERS:
            held = [s["n"] for (tier, _), s in steps.items() if tier == t]
            assert not held or max(held) - min(held) <= 1 and max(held) <= max(1, 256 // t)
            tokens = [s["tokens"] for (tier, _), s in steps.items() if tier == t]
            assert len({s for tier, s in steps if tier == t}) < 2 or max(tokens) - min(tokens) <= max(sum(p[1] for p in w) for w in windows.values() if w[0][2] == t)


def test_gaps_take_shorter_pieces():
    got = packing.pack(np.arange(3), np.zeros(3, int), np.array([100, 20, 6]), TIERS, 256)
    assert got["tier"].tolist() == [128, 128, 128] and len(set(got["window"])) == 1 and got["offset"].tolist() == [0, 100, 120]


def test_best_fit_by_hand():
    where, room = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert where.tolist() == [0, 1, 0, 1, 1] and room == [0, 0]


def test_odd_rows(odd, docs_of):
    df = odd.withColumn("window", F.lit("x")).withColumn("__n", F.lit(1))
    rows = packing.packed(df, tiers=TIERS).collect()
    assert {r.doc_id for r in rows} == {1, None, 4, 5, 6, 7} and len([r for r in rows if r.doc_id == 1]) == 2
    text = len("alpha beta gamma delta " * 20_000)
    check([r for r in rows if r.doc_id == 4], {4: text // 4 + 1})
    assert packing.packed(docs_of([])).collect() == [] and packing.packed(docs_of([(1, None), (2, "")])).collect() == []


def fewest(lengths, capacity):
    """The least number of windows, by trying all ways."""
    best = len(lengths)

    def go(k, room):
        nonlocal best
        if len(room) >= best and k < len(lengths):
            return
        if k == len(lengths):
            best = min(best, len(room))
            return
        for i in sorted(set(room)):
            if i >= lengths[k]:
                rest = list(room)
                rest.remove(i)
                go(k + 1, [*rest, i - lengths[k]])
        go(k + 1, [*room, capacity - lengths[k]])

    go(0, [])
    return best


def test_windows_against_the_optimum():
    """Best fit of descending lengths needs at most 11/9 of the fewest windows and 6/9 of one."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 33, rng.integers(1, 10)))[::-1]
        where, room = packing.best_fit(lengths, 32)
        assert len(room) <= (11 * fewest(lengths.tolist(), 32) + 6) / 9 and all(lengths[where == w].sum() == 32 - r for w, r in enumerate(room))


def test_many_rows_of_one_id_and_length_are_spread(spark):
    """Each bucket gets its share of them, so no task gets them all."""
    df = spark.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(16).alias("n"))
    rows = packing.packed(df, F.col("n"), TIERS, step_tokens=256, bucket=100).collect()
    assert len(rows) == 5_000 and len({(r.window, r.offset) for r in rows}) == 5_000
    sizes = np.unique([r.window >> 32 for r in rows], return_counts=True)[1]
    assert len(sizes) >= 3 and sizes.max() < 2_500  # those packed again go to tasks of 20 buckets' pieces
    assert sum(r.n_tokens for r in rows) / sum({r.window: r.tier for r in rows}.values()) > 0.9


def test_windows_hold_the_documents_tokens(docs_of):
    """What filled gives, cut at the places that packed gave, is each document's tokens and the end."""
    from quern.llm import bpe

    ranks = bpe.RankMap(bpe.load_ranks())
    docs = docs_of([(i, f"document {i} " + "says this and that 12 " * (i * i % 90)) for i in range(40)] + [(100, ""), (101, None)])
    coded = bpe.encode(docs, ranks)
    ids = {r.doc_id: r.ids for r in coded.collect() if r.ids}
    pieces = packing.packed(packing.tokenised(docs), F.col("n_tokens"), TIERS, step_tokens=256)
    windows = {r.window: r for r in packing.filled(pieces, coded, -1).collect()}
    got = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: (r.doc_id, r.start)):
        w = windows[r.window]
        assert (w.tier, w.step) == (r.tier, r.step) and len(w.ids) <= w.tier
        got[r.doc_id] += w.ids[r.offset : r.offset + r.n_tokens]
    assert got == {i: [*x, -1] for i, x in ids.items()}
    assert sum(len(w.ids) for w in windows.values()) == sum(len(x) + 1 for x in ids.values())
