"""Packing: documents into context windows of several lengths, and windows into balanced step groups."""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.llm import bpe
from quern.llm.common import table

#: Window lengths in tokens, and the windows' tokens that one step takes.
TIERS = (1024, 4096, 16384)
STEP_TOKENS = 1 << 19
#: Documents that one task packs together at first.
BUCKET = 50_000
#: Windows that hold this share aren't packed again; a task that packs again takes so many times BUCKET pieces.
FULL, TOGETHER = 63 / 64, 20
BYTES_PER_TOKEN = 4


def tokens(text: Column) -> Column:
    """Tokens by bytes, and one that ends the document; none for a null or empty text."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return F.when(size > 0, F.ceil(size / F.lit(BYTES_PER_TOKEN)).cast("long") + 1).otherwise(F.lit(0).cast("long"))


def tokenised(docs: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """doc_id and n_tokens: the byte-level BPE's tokens of the text and one that ends the document; 0 for a null or empty text.

    Written once, so that packing doesn't tokenise again each time it looks at lengths."""
    n = bpe.n_tokens(F.col("text"), ranks or bpe.load_ranks())
    counted = docs.select("doc_id", "text").withColumn("n_tokens", n)
    return table(counted.select("doc_id", F.when(F.col("n_tokens") > 0, F.col("n_tokens") + 1).otherwise(F.lit(0).cast("long")).alias("n_tokens")), "lengths")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Windows of descending ``lengths`` by best fit, and what stays free in each."""
    free: list[tuple[int, int]] = []
    room: list[int] = []
    where = np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        i = bisect_left(free, (n, -1))
        if i < len(free):
            left, w = free.pop(i)
        else:
            left, w = capacity, len(room)
            room.append(capacity)
        where[k], room[w] = w, left - n
        if left > n:
            insort(free, (left - n, w))
    return where, room


def pack(ids: np.ndarray, pieces: np.ndarray, lengths: np.ndarray, tiers: tuple[int, ...], step_tokens: int) -> dict[str, np.ndarray]:
    """Every piece's tier, window, offset in it, and step group."""
    order = np.lexsort((pieces, ids, -lengths))
    length = lengths[order]
    tier = np.asarray(tiers)[np.searchsorted(tiers, length)]
    placed = np.full(len(order), -1, np.int64)
    kind, first, used = np.zeros(len(order), np.int64), 0, []
    step, steps = np.zeros(len(order), np.int64), 0
    for t in sorted(tiers, reverse=True):
        own = np.flatnonzero((tier == t) & (placed < 0))
        where, room = best_fit(length[own], t)
        placed[own], kind[own] = where + first, t
        pool: dict[int, list[int]] = {}
        for k in np.flatnonzero((tier < t) & (placed < 0))[::-1].tolist():
            pool.setdefault(int(length[k]), []).append(k)
        sizes = sorted(pool)
        for w in np.argsort(-np.asarray(room, np.int64), kind="stable").tolist():  # the widest gaps first
            while sizes and sizes[0] <= room[w]:
                n = sizes[bisect_left(sizes, room[w] + 1) - 1]
                k = pool[n].pop()
                if not pool[n]:
                    sizes.pop(bisect_left(sizes, n))
                placed[k], kind[k] = w + first, t
                room[w] -= n
        # steps: windows by tokens held, dealt there and back
        per_step = max(1, step_tokens // t)
        n_windows = len(room)
        groups = max(1, -(-n_windows // per_step))
        held = np.argsort(np.asarray(room, np.int64), kind="stable")
        turn = np.arange(n_windows)
        to = turn % (2 * groups)
        group = np.empty(n_windows, np.int64)
        group[held] = np.where(to < groups, to, 2 * groups - 1 - to) + steps
        inside = np.flatnonzero(kind == t)
        step[inside] = group[placed[inside] - first]
        first, steps = first + n_windows, steps + (groups if n_windows else 0)
        used.append(n_windows)
    by_window = np.lexsort((np.arange(len(order)), placed))
    sorted_length, sorted_window = length[by_window], placed[by_window]
    ends = np.cumsum(sorted_length)
    starts = ends - sorted_length
    new = np.concatenate([[True], sorted_window[1:] != sorted_window[:-1]]) if len(order) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(new, starts, 0)) if len(order) else starts
    offset = np.empty(len(order), np.int64)
    offset[by_window] = starts - base
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return {"tier": kind[back], "window": placed[back], "offset": offset[back], "step": step[back]}


def packed(docs: DataFrame, length: Column | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, bucket: int = BUCKET) -> DataFrame:
    """One row a piece: doc_id, piece, start, n_tokens, tier, window, offset, step.

    A document goes to the shortest tier that holds it; one longer than the longest tier is cut into pieces of
    that length and a rest. Tiers are packed from the longest down, largest pieces first, each where it fits
    best; the gaps of longer windows then take the largest pieces of shorter tiers that fit. Windows of a tier
    are dealt to step groups by the tokens they hold, there and back, so that groups hold nearly as much.

    Pieces are packed in buckets by hash of id, length and the number of the row among those of this id and length, of
    about ``bucket`` documents each. Pieces of windows
    that are less than FULL are then packed again, TOGETHER times ``bucket`` of them in a task, which is all of them
    unless there are more; that goes on while it takes fewer tasks than before. Steps are dealt over all windows of
    a tier. Window numbers carry the bucket and are unique. ``length`` defaults to ``tokens(text)``. Null, empty or
    nonpositive lengths give no row; repeated rows and rows of a null id are packed each for itself; other columns
    don't matter and don't appear. No rows give no rows."""
    tiers = tuple(sorted(tiers))
    long = tiers[-1]
    size = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (length if length is not None else tokens(F.col("text"))).cast("long").alias("__n")).where("__n > 0")
    buckets = max(1, -(-docs.select(F.lit(1)).count() // bucket))
    if buckets > 1:  # rows of one id and length are counted, numbered and spread, however many there are
        same = size.groupBy("doc_id", "__n").agg(F.count(F.lit(1)).alias("__copies"))
        some = same.select("doc_id", "__n", "__copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(bucket).cast("long"))).alias("__first"))
        size = some.select("doc_id", "__n", F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + bucket, F.col("__copies")) - 1)).alias("__copy"))
    else:
        size = size.withColumn("__copy", F.lit(0).cast("long"))
    pieces = size.select(
        "doc_id", "__n", F.pmod(F.xxhash64("doc_id", "__n", "__copy"), F.lit(buckets)).cast("int").alias("__bucket"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / long).cast("int"))).alias("piece"),
    )
    # a document of one piece has its length, others are full but for the last
    pieces = pieces.select("__bucket", "doc_id", "piece", (F.col("piece").cast("long") * long).alias("start"), F.least(F.lit(long).cast("long"), F.col("__n") - F.col("piece").cast("long") * long).alias("n_tokens"))

    def run(base):
        def one(key, pdf):
            got = pack(pdf.doc_id.fillna(-1).to_numpy(np.int64), pdf.piece.to_numpy(np.int64), pdf.n_tokens.to_numpy(np.int64), tiers, step_tokens)
            high = np.int64(key[0] + base) << 32
            held = pdf.n_tokens.groupby(got["window"]).transform("sum")
            return pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "piece": pdf.piece, "start": pdf.start, "n_tokens": pdf.n_tokens, "tier": got["tier"].astype(np.int32), "window": got["window"] + high, "offset": got["offset"], "step": got["step"] + high, "held": held})

        return one

    def windows(pieces, base=0):
        return pieces.groupBy("__bucket").applyInPandas(run(base), "doc_id long, piece int, start long, n_tokens long, tier int, window long, offset long, step long, held long")

    if buckets == 1:
        return windows(pieces).drop("held")
    parts, base = [], 0
    while True:
        got, base = table(windows(pieces, base), "packed"), base + buckets
        loose = got.where(F.col("held") < F.col("tier") * FULL)
        fewer = -(-loose.count() // (TOGETHER * bucket))
        if not 0 < fewer < buckets:
            parts.append(got)
            break
        parts.append(got.where(F.col("held") >= F.col("tier") * FULL))
        pieces, buckets = loose.select("doc_id", "piece", "start", "n_tokens", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "window", "offset"), F.lit(fewer)).cast("int").alias("__bucket")), fewer
    return stepped(reduce(DataFrame.unionByName, parts).drop("step"), tiers, step_tokens)


def stepped(pieces: DataFrame, tiers: tuple[int, ...], step_tokens: int) -> DataFrame:
    """``pieces`` with step instead of held: all windows of a tier by tokens held, dealt to its steps there and back."""
    each = pieces.select("tier", "window", "held").distinct()
    n = {r.tier: r["count"] for r in each.groupBy("tier").count().collect()}
    groups = {t: -(-n.get(t, 0) // max(1, step_tokens // t)) for t in tiers}
    step, before = F.lit(None).cast("long"), 0
    turn = F.row_number().over(W.Window.partitionBy("tier").orderBy(F.desc("held"), "window")).cast("long") - 1
    for t in sorted(tiers, reverse=True):
        g = groups[t]
        if g:
            to = F.col("turn") % (2 * g)
            step = F.when(F.col("tier") == t, F.when(to < g, to).otherwise(2 * g - 1 - to) + before).otherwise(step)
        before += g
    steps = each.withColumn("turn", turn).select("window", step.alias("step"))
    return pieces.drop("held").join(steps, "window").select("doc_id", "piece", "start", "n_tokens", "tier", "window", "offset", "step")


def filled(pieces: DataFrame, coded: DataFrame, end: int) -> DataFrame:
    """(tier, window, step, ids) of every window: its pieces' tokens one after another, each document's followed by ``end``.

    ``pieces`` come from ``packed`` by lengths that count the end, ``coded`` (doc_id, ids) from bpe.encode, a row a doc_id. Only
    the tokens that a window holds come together, so no group is larger than a tier."""
    tokens_ = F.slice(F.concat("ids", F.array(F.lit(end))), F.col("start").cast("int") + 1, F.col("n_tokens").cast("int"))
    parts = pieces.join(coded.select("doc_id", "ids"), "doc_id").select("tier", "window", "step", F.struct("offset", tokens_.alias("ids")).alias("part"))
    return parts.groupBy("tier", "window", "step").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["ids"])).alias("ids"))
