"""The crawl: breadth-first waves over links, each wave a written table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from itertools import count
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder the session names in spark.checkpoint.dir; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    sc.setCheckpointDir(f"{root.rstrip('/')}/waves-{uuid.uuid4().hex[:8]}")


def written(df: DataFrame) -> DataFrame:
    """``df`` written below the checkpoint folder and read again; a local folder goes when the driver ends."""
    checkpoints(df.sparkSession)
    root = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{root.rstrip('/')}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if urlparse(path).scheme in ("", "file"):
        atexit.register(shutil.rmtree, urlparse(path).path, ignore_errors=True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def breadth_first(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """(node, depth) of all nodes reached from the seeds (node) over edges (src, dst), up to ``max_depth`` if it is given.

    A wave joins its links and leaves out what was seen; lineage is cut by a checkpoint each wave. With
    ``max_nodes`` the waves stop once so many are known, the last one taken in order of node."""
    checkpoints(seeds.sparkSession)
    wave = seeds.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    seen, known = wave, wave.count()
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        found = wave.join(edges, wave.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        if max_nodes is not None:
            found = found.orderBy("node").limit(max(0, max_nodes - known))
        wave = found.withColumn("depth", F.lit(depth)).checkpoint()
        if not (n := wave.count()):
            break
        known += n
        seen = seen.unionByName(wave)  # a union of checkpoints, one a wave
    return seen
