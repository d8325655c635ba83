"""Sharding: contiguous shards of least largest size over ordered atomic groups."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, load_array, posix, put, save_array, shared_folder

SHARDS = 128


class Prefix:
    """Running sizes of ordered groups in files of the shared folder: part after part, each mapped when looked at."""

    def __init__(self, folder: str, parts: list[tuple[int, int, int, int]]):
        self.folder = folder
        self.parts = [p for p in sorted(parts) if p[1]]
        self.sums = np.cumsum([0] + [p[2] for p in self.parts])
        self.total, self.largest = int(self.sums[-1]), max([p[3] for p in self.parts], default=0)
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.maps:
            n = self.parts[k][0]
            self.maps[k] = load_array(f"{self.folder}/{n}.ids.npy"), load_array(f"{self.folder}/{n}.ends.npy")
        return self.maps[k]

    def reach(self, most: int) -> tuple[int, int]:
        """The furthest group whose running size is at most ``most``: that size, and the next group's place (part, row) packed."""
        k = int(np.searchsorted(self.sums, most, "right")) - 1
        if k >= len(self.parts):
            return self.total, -1
        _, ends = self.part(k)
        at = int(np.searchsorted(ends, most - self.sums[k], "right"))
        size = int(self.sums[k] + (ends[at - 1] if at else 0))
        while at == len(ends):
            k, at = k + 1, 0
            if k == len(self.parts):
                return size, -1
            ends = self.part(k)[1]
        return size, k << 40 | at

    def cuts(self, capacity: int, shards: int) -> list[int] | None:
        """First group of each shard after the first, cut as late as the capacity allows; None if the shards don't suffice."""
        done, out = 0, []
        while True:
            done, place = self.reach(done + capacity)
            if place < 0:
                return out
            out.append(place)
            if len(out) >= shards:
                return None

    def least(self, shards: int) -> int:
        """The smallest capacity for which so many shards suffice."""
        low = max(self.largest, -(-self.total // shards))
        high = max(low, self.largest + self.total // shards)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.cuts(mid, shards) is not None else (mid + 1, high)
        return low

    def group(self, place: int) -> int:
        return int(self.part(place >> 40)[0][place & (1 << 40) - 1])


def prefix(groups: DataFrame, parts: int) -> Prefix:
    """``groups`` (id long without nulls, size long), sorted by id; every task writes its running sizes whole."""
    folder = shared_folder(groups.sparkSession, "prefix")
    where = posix(folder)

    def write(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        ids, sizes = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, np.int64) for i in (0, 1))
        n = TaskContext.get().partitionId()
        os.makedirs(where, exist_ok=True)
        save_array(f"{where}/{n}.ids.npy", ids)
        save_array(f"{where}/{n}.ends.npy", np.cumsum(sizes))
        yield pa.RecordBatch.from_pydict({"part": [n], "n": [len(ids)], "size": [int(sizes.sum())], "largest": [int(sizes.max(initial=0))]})

    told = groups.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(write, "part long, n long, size long, largest long")
    return Prefix(where, [tuple(r) for r in told.collect()])  # a row a part


def shard(docs: DataFrame, size: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` (int from 0): runs of doc_id whose largest total size is as small as ``shards`` runs allow.

    Rows of one doc_id are one group and stay together. Groups are in order of doc_id, those of null last as
    one group. ``size`` defaults to the bytes of ``text``; null counts 0. A group of size 0 joins the shard
    before it as long as that has begun. Fewer groups than shards use fewer shards; no rows give no rows.
    A column named shard is replaced, all others stay."""
    weight = F.coalesce(size if size is not None else F.octet_length("text"), F.lit(0)).cast("long")
    every = docs.select(F.col("doc_id").cast("long").alias("id"), weight.alias("size")).groupBy("id").agg(F.sum("size").alias("size"))
    last = every.where(F.col("id").isNull()).agg(F.sum("size")).first()[0]
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = prefix(every.where(F.col("id").isNotNull()), parts)
    if last is not None:  # the group of nulls as a part of its own
        save_array(f"{sums.folder}/null.ids.npy", np.zeros(1, np.int64))
        save_array(f"{sums.folder}/null.ends.npy", np.array([last], np.int64))
        n = max([p[0] for p in sums.parts], default=-1) + 1
        for kind in ("ids", "ends"):
            os.replace(f"{sums.folder}/null.{kind}.npy", f"{sums.folder}/{n}.{kind}.npy")
        sums = Prefix(sums.folder, [*sums.parts, (n, 1, last, last)])
    cuts = sums.cuts(sums.least(shards), shards) if sums.parts else []
    nulls = len(sums.parts) - 1 if last is not None else -1
    firsts = np.array([sums.group(c) for c in cuts if c >> 40 != nulls], np.int64)
    null_shard = len(cuts)

    @F.arrow_udf("int")
    def at(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(firsts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right").astype(np.int32)
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), null_shard, found).astype(np.int32))

    (s,) = fresh(docs, "shard_")
    return put(docs.withColumn(s, at(F.col("doc_id").cast("long"))), {"shard": F.col(f"`{s}`")}).drop(s)
