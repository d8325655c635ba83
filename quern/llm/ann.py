"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.llm.common import blobs, joined, load_array, once, posix, ragged, save_array, shared_folder, table
from quern.llm.lines import mix

#: Hash tables, projections of a table, and buckets probed in a table.
TABLES, PROJECTIONS, PROBES = 24, 16, 400
NEIGHBOURS = 10
#: Sampled queries whose neighbours are found exactly to fit the width of a bucket, the share of them it must find, and
#: the widths tried, in units of the sampled queries' median distance of the last neighbour.
SAMPLE, RECALL = 64, 0.95
WIDTHS = tuple(0.25 * 1.07**k for k in range(63))
#: Vectors in a file, entries in a shard of a table, and vectors in a task's row.
PART, SHARD, BLOCK = 250_000, 1_000_000, 4096


def perturbations(projections: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of places among the 2K nearest bucket borders, in order of the expected sum of squared distances; first the empty one."""
    k = projections
    z = [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, 2 * k + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(z[0], (0,))]
    while heap and len(out) < probes:
        cost, places = heapq.heappop(heap)
        if not any(2 * k - 1 - p in places for p in places):  # a projection can't move both ways
            out.append(places)
        last = places[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (cost - z[last] + z[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (cost + z[last + 1], (*places, last + 1)))
    return out


class Hashes:
    """The tables' projections, of a fixed seed, and the buckets they give."""

    def __init__(self, dims: int, width: float, tables: int, projections: int, probes: int):
        rng = np.random.default_rng(7)
        self.tables, self.k, self.width = tables, projections, width
        self.a = rng.normal(size=(dims, tables * projections))
        self.b = rng.uniform(0, 1, tables * projections)
        self.odd = rng.integers(0, 2**63, projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sets = perturbations(projections, probes)
        self.moves = np.zeros((len(sets), 2 * projections), np.uint64)
        for row, places in enumerate(sets):
            self.moves[row, list(places)] = 1

    def places(self, x: np.ndarray) -> np.ndarray:
        at = x.astype(np.float64) @ self.a / self.width + self.b
        return np.clip(at, -(2.0**62), 2.0**62).reshape(len(x), self.tables, self.k)  # beyond, all lie in one bucket

    def sums(self, floors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (floors.astype(np.int64).view(np.uint64) * self.odd).sum(axis=-1, dtype=np.uint64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(n, tables) keys."""
        return mix(self.sums(np.floor(self.places(x))), 3)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """(tables, probes) keys of one vector: its own buckets, then those beyond the nearest borders."""
        at = self.places(x[None, :])[0]
        floor = np.floor(at)
        inside = at - floor
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1, kind="stable")
        with np.errstate(over="ignore"):
            steps = np.concatenate([np.uint64(0) - self.odd, self.odd])[order]  # a move down or up changes the sum by this
            return mix(self.sums(floor)[:, None] + (steps[:, None, :] * self.moves[None]).sum(axis=2, dtype=np.uint64), 3)


class Store:
    """Vectors and tables in a folder, each mapped when first looked at."""

    def __init__(self, folder: str, hashes: Hashes, bits: int, hot: dict[tuple[int, int], tuple[int, int]]):
        self.folder, self.hashes, self.bits, self.maps = folder, hashes, bits, {}
        self.hot = hot
        self.hot_keys = {t: np.array(sorted(k for u, k in hot if u == t), np.uint64) for t in {t for t, _ in hot}}

    def array(self, name: str):
        if name not in self.maps:
            path = f"{self.folder}/{name}.npy"
            self.maps[name] = load_array(path) if os.path.exists(path) else None
        return self.maps[name]

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Rows, part << 32 | place, in any bucket probed, each once."""
        found = []
        for t, keys in enumerate(self.hashes.probes(x)):
            keys = np.unique(keys)
            if t in self.hot_keys:
                own = np.isin(keys, self.hot_keys[t])
                for key in keys[own].tolist():
                    first, n = self.hot[t, key]
                    found += [x for x in (self.array(f"t{first + j}.rows") for j in range(n)) if x is not None]
                keys = keys[~own]
            shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
            for s in np.unique(shard).tolist():
                index = self.array(f"t{t << self.bits | s}.keys")
                if index is None:
                    continue
                some = keys[shard == s]
                a, b = np.searchsorted(index, some), np.searchsorted(index, some, "right")
                n = b - a
                if n.sum():
                    found.append(self.array(f"t{t << self.bits | s}.rows")[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest rows among the candidates' copies, ties by id."""
        rows = self.candidates(x)
        found = [nearest(x, k, rows[(rows >> 32) == p] & 0xFFFFFFFF, *(self.array(f"p{p}.{n}") for n in ("vectors", "squares", "ids", "offsets")))[:2] for p in np.unique(rows >> 32).tolist()]
        ids, distances = (np.concatenate([f[j] for f in found]) if found else np.zeros(0) for j in (0, 1))
        order = np.lexsort((ids, distances))[:k]
        return ids[order], distances[order]


def nearest(x: np.ndarray, k: int, at: np.ndarray | slice, vectors: np.ndarray, squares: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, distances, places) of the k nearest of the copies of the vectors at these places, ties by id."""
    rough = squares[at] - 2 * (vectors[at] @ x)
    at = np.arange(len(vectors)) if isinstance(at, slice) else at
    if len(at) > k:  # close to the bound, single precision can't tell
        bound = float(np.partition(rough, k - 1)[k - 1])
        slack = 1e-5 * (float(np.abs(squares[at]).max()) + float(x @ x))
        at = at[~(rough > bound + slack)]  # what overflows stays
    exact = np.sqrt(((vectors[at].astype(np.float64) - x.astype(np.float64)) ** 2).sum(axis=1))
    n = offsets[at + 1] - offsets[at]
    own = np.asarray(ids[np.repeat(offsets[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    exact, at = np.repeat(exact, n), np.repeat(at, n)
    order = np.lexsort((own, exact))[:k]
    return own[order], exact[order], at[order]


def fitted(x: np.ndarray, neighbours: list[np.ndarray], last: np.ndarray, make) -> Hashes:
    """Hashes of the least width at which the sampled queries find RECALL of their neighbours; the largest if none does."""
    unit = float(np.median(last[last > 0])) if (last > 0).any() else 1.0

    def enough(width: float) -> bool:
        hashes, found = make(unit * width), 0
        for q, near in zip(x, neighbours):
            own, keys = hashes.probes(q), hashes.buckets(near)
            found += int((keys[:, :, None] == own[None]).any(axis=(1, 2)).sum())
        return found >= RECALL * sum(map(len, neighbours))

    low, high = 0, len(WIDTHS) - 1  # wider buckets find more
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(WIDTHS[middle]) else (middle + 1, high)
    return make(unit * WIDTHS[low])


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, every: int = 1, tables: int = TABLES, projections: int = PROJECTIONS, width: float | None = None, probes: int = PROBES) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): for rows of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``, all rows at 1, the ``k`` nearest other rows.

    Each table buckets the floor of ``projections`` Gaussian projections. A query probes its own bucket
    and those beyond the nearest borders, in order of estimated success; what all tables give is ranked by exact
    distance, ties by id. The buckets' ``width`` is fit to the data unless it is given: for a sample of at most SAMPLE
    queries, those of least hash, neighbours are found exactly among all rows, and the least of WIDTHS at which the
    tables find RECALL of them is taken, so that buckets get narrower as neighbours get nearer. No candidate is dropped, so
    a query of few neighbours in reach has fewer than ``k``. A bucket that a shard can't hold has shards of its own.

    Equal vectors are indexed once, with the ``k`` + 1 least ids that have them: no other can be among anyone's ``k`` nearest,
    as ties go by id. So a vector that many rows share costs no more than one. Repeated rows and those of null ids are
    candidates each for themselves, and queries if ``every`` is 1; a null id comes before others in ties.
    Null or empty vectors, ones with null, NaN or values that aren't finite in single precision, and ones whose length
    isn't the most common (the larger of equally common ones) take no part. Other columns don't matter. No rows give none."""
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<float>")
    none = np.iinfo(np.int64).min
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(none)).alias("id"), e.alias("v")).where((F.size("v") > 0) & finite)
    common = sound.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, rank int, distance double")
    dims = common[0]
    sound = sound.where(F.size("v") == dims)
    queries = sound.where((F.col("id") % every == 0) & (F.col("id") != none)) if every > 1 else sound
    folder = posix(shared_folder(spark, "ann"))
    # the window's limit on ranks is applied before the shuffle too, so no task gets all of a vector's rows
    least = sound.withColumn("n", F.row_number().over(W.Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = queries.select("v").distinct().withColumn("asked", F.lit(True))
    distinct = table(least.join(asked, "v", "left").select("v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "vectors")
    n = distinct.count()
    parts = max(1, -(-n // PART))
    bits = max(0, int(np.ceil(np.log2(n / SHARD))))

    def write(batches):
        got = pa.Table.from_batches(batches)
        if not got.num_rows:
            return
        part = TaskContext.get().partitionId()
        x = ragged(got["v"])[0].reshape(-1, dims).astype(np.float32)
        order = np.lexsort(x.T)  # the same files whichever way the rows arrive
        ids, offsets = ragged(got["ids"].take(pa.array(order)))
        x, squares = x[order], (x[order].astype(np.float64) ** 2).sum(axis=1)
        os.makedirs(folder, exist_ok=True)
        with np.errstate(over="ignore"):
            for name, array in (("vectors", x), ("squares", squares.astype(np.float32)), ("ids", ids), ("offsets", offsets), ("asked", got["asked"].to_numpy()[order])):
                save_array(f"{folder}/p{part}.{name}.npy", array)
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [len(x)]})

    told = distinct.repartition(parts, F.xxhash64("v", F.lit(1))).mapInArrow(write, "part long, n long").collect()  # a row a part

    def blocks(size: int) -> DataFrame:
        rows = spark.createDataFrame([(r[0], r[1]) for r in told], "part long, n long")
        each = rows.select("part", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))).alias("a"))
        each = each.select("part", "a", F.least(F.col("a") + size, F.col("n")).alias("z"))
        return each.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20_000), "part", "a")

    load = lambda part, names, a, z: [load_array(f"{folder}/p{part}.{x}.npy")[a:z] for x in names]

    def fit() -> Hashes:
        sample = distinct.where("asked").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()
        x = np.array([r.v for r in sample], np.float32).reshape(-1, dims)

        def exact(batches):
            for b in batches:
                for part, a, z in zip(*(b.column(c).to_pylist() for c in range(3))):
                    near, squares = load(part, ("vectors", "squares"), a, z)
                    for q in range(len(x)):
                        _, d, at = nearest(x[q], k, slice(None), near, squares, np.arange(len(near)), np.arange(len(near) + 1))
                        yield pa.RecordBatch.from_pydict({"q": np.full(len(at), q), "d": d, "v": list(near[at])}, schema=pa.schema([("q", pa.int64()), ("d", pa.float64()), ("v", pa.list_(pa.float32()))]))

        found = blocks(PART).mapInArrow(exact, "q long, d double, v array<float>").where("d > 0")
        found = found.withColumn("n", F.row_number().over(W.Window.partitionBy("q").orderBy("d", "v"))).where(F.col("n") <= k).toPandas()  # bounded by SAMPLE and k
        groups = [np.array(g.v.tolist(), np.float32).reshape(-1, dims) for q, g in found.groupby("q")]
        return fitted(x[sorted(found.q.unique())], groups, found.groupby("q").d.max().to_numpy(), lambda w: Hashes(dims, w, tables, projections, probes))

    hashes = fit() if width is None else Hashes(dims, width, tables, projections, probes)

    def frequent(batches):
        for b in batches:
            for part, a, z in zip(*(b.column(c).to_pylist() for c in range(3))):
                keys = hashes.buckets(load(part, ("vectors",), a, z)[0])
                for t in range(tables):
                    key, m = np.unique(keys[:, t], return_counts=True)
                    some = m >= (z - a) * least / n
                    yield pa.RecordBatch.from_pydict({"t": np.full(int(some.sum()), t), "key": key[some].view(np.int64), "n": m[some]})

    # a bucket of twice `least` entries has at least half of them where it is named; with one shard a table none is too large
    least, hot, shards = SHARD / 4, {}, tables << bits
    if bits:
        for r in blocks(20_000).mapInArrow(frequent, "t long, key long, n long").groupBy("t", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy("t", "key").collect():
            hot[r.t, int(np.int64(r.key).view(np.uint64))] = shards, max(1, -(-2 * r.n // SHARD))
            shards += hot[r.t, int(np.int64(r.key).view(np.uint64))][1]

    def bucket(batches):
        for b in batches:
            for part, a, z in zip(*(b.column(c).to_pylist() for c in range(3))):
                keys = hashes.buckets(load(part, ("vectors",), a, z)[0])
                rows = np.arange(a, z) + (part << 32)
                for t in range(tables):
                    order = np.argsort(keys[:, t])
                    key = keys[order, t]
                    shard = ((key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)) + (t << bits)
                    for (u, k_), (first, parts_) in hot.items():
                        if u == t:  # a bucket with shards of its own
                            here = np.flatnonzero(key == np.uint64(k_))
                            shard[here] = first + rows[order[here]] % parts_
                    by = np.argsort(shard, kind="stable") if hot else slice(None)
                    yield blobs(shard[by], key[by], rows[order][by])

    def build(key, got):
        keys, rows = joined(got, "b0", np.uint64), joined(got, "b1", np.int64)
        order = np.lexsort((rows, keys))
        s = key[0].as_py()
        save_array(f"{folder}/t{s}.rows.npy", rows[order])
        save_array(f"{folder}/t{s}.keys.npy", keys[order])
        return pa.table({"n": [len(keys)]})

    blocks(20_000).mapInArrow(bucket, "shard long, b0 binary, b1 binary").groupBy("shard").applyInArrow(build, "n long").agg(F.sum("n")).collect()

    def search(batches):
        store = once("ann", folder, lambda: Store(folder, hashes, bits, hot))
        for b in batches:
            for part, a, z in zip(*(b.column(c).to_pylist() for c in range(3))):
                x = store.array(f"p{part}.vectors")
                asked = a + np.flatnonzero(store.array(f"p{part}.asked")[a:z])
                found = [store.nearest(np.asarray(x[r]), k + 1) for r in asked]
                schema = pa.schema([("v", pa.list_(pa.float32())), ("ids", pa.list_(pa.int64())), ("distances", pa.list_(pa.float64()))])
                yield pa.RecordBatch.from_pydict({"v": [x[r] for r in asked], "ids": [f[0] for f in found], "distances": [f[1] for f in found]}, schema=schema)

    found = blocks(BLOCK).mapInArrow(search, "v array<float>, ids array<long>, distances array<double>")
    # a query's own row is the first of its id at distance 0, if it is among the k + 1
    own = F.array_position(F.transform("ids", lambda i, j: F.when((F.get("distances", j) == 0) & (i == F.col("id")), 1).otherwise(0)), 1).cast("int") - 1
    listed = queries.join(found, "v").withColumn("own", own).select("id", F.slice(F.filter(F.arrays_zip("ids", "distances"), lambda _, j: j != F.col("own")), 1, k).alias("near"))
    null = lambda c: F.when(c != none, c)
    return listed.select("id", F.posexplode("near").alias("at", "x")).select(null(F.col("id")).alias("vec_id"), null(F.col("x.ids")).alias("neighbour_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.distances").alias("distance"))
