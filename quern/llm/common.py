"""Helpers that the operators of this subpackage share: expressions, the shared folder, array shards."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column, pattern: str = WORDS) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with these columns at its end; columns it had by those names go."""
    gone = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone], *[v.alias(k) for k, v in columns.items()])


def number_list(values: Iterable, kind: str) -> Column:
    """A literal array; the optimizer folds it once, on the driver."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


# ---------------------------------------------------------------- the shared folder


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if urlparse(path).scheme in ("", "file"):
        os.makedirs(posix(path), exist_ok=True)
        atexit.register(shutil.rmtree, posix(path), ignore_errors=True)
    return path


def posix(path: str) -> str:
    """The path as the operating system has it; arrays can be mapped into memory only there."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {parts.scheme}:")
    return unquote(parts.path)


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read again: the lineage ends there and lost executors lose nothing."""
    path = shared_folder(df.sparkSession, name) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_array(path: str, array: np.ndarray) -> None:
    """Written beside its place and then renamed, so that a second attempt or a lost executor leaves whole files only."""
    part = f"{path}.{uuid.uuid4().hex[:8]}"
    with open(part, "wb") as f:
        np.save(f, np.ascontiguousarray(array))
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def load_array(path: str) -> np.ndarray:
    """Mapped, not read; an empty array can't be mapped."""
    return np.load(path, mmap_mode="r") if os.path.getsize(path) > 256 else np.load(path)


def ragged(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 offsets of an Arrow list column; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    if column.null_count:
        sizes = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        column = column.flatten(), np.concatenate([[0], np.cumsum(sizes)])
        return np.asarray(column[0]), column[1]
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def blobs(shard: np.ndarray, *columns: np.ndarray):
    """A row a shard: the shard and each column's part as bytes. The shards are in order."""
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(shard))
    names = [f"b{k}" for k in range(len(columns))]
    out = {"shard": shard[starts].astype(np.int64)} | {n: [c[a:b].tobytes() for a, b in zip(starts, ends)] for n, c in zip(names, columns)}
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([("shard", pa.int64()), *[(n, pa.binary()) for n in names]]))


def joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])


_kept: dict[str, tuple[object, object]] = {}


def once(kind: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by a Python worker from task to task until another key of this kind comes.

    Functions sent to workers are copied with the globals they name; this one lives in a module, so it isn't."""
    if kind not in _kept or _kept[kind][0] != key:
        _kept.pop(kind, None)
        _kept[kind] = key, make()
    return _kept[kind][1]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def slim() -> None:
    """Gives the memory that a Python worker has freed back to the system, so that workers don't stay as large as their largest batch."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
