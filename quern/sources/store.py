"""The store of sites, runs, pages, versions and frontier items: Parquet parts under numbered logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import history

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


STATS = schema(discovered=L, crawled=L, succeeded=L, failed=L, skipped=L, changed=L, unchanged=L, new=L, deleted=L, bytes=L, errors_by_type=T.MapType(S, L), status_codes=T.MapType(I, L), domains=T.ArrayType(S))
HEADING = schema(level=I, text=S, anchor=S)
#: Each table's key and columns.
TABLES: dict[str, tuple[list[str], T.StructType]] = {
    "sites": (["site_id"], schema(site_id=S, name=S, seeds=T.ArrayType(S), allowed_domains=T.ArrayType(S), config=S, created_at=TS, updated_at=TS, total_pages=L, total_runs=L, last_crawl_at=TS, is_active=B)),
    "runs": (["run_id"], schema(run_id=S, site_id=S, status=S, created_at=TS, started_at=TS, completed_at=TS, seeds=T.ArrayType(S), config=S, stats=STATS, error=S)),
    "pages": (["page_id"], schema(page_id=S, site_id=S, url=S, canonical_url=S, current_version_id=S, content_hash=S, etag=S, last_modified=S, first_seen=TS, last_seen=TS, last_crawled=TS, depth=I, referrer_url=S, status_code=I, is_tombstone=B, error_count=I, version_count=I)),
    "versions": (["page_id", "version_id"], schema(version_id=S, page_id=S, site_id=S, run_id=S, url=S, markdown=S, html=S, plain_text=S, content_hash=S, title=S, description=S, status_code=I, language=S, headings=T.ArrayType(HEADING), outlinks=T.ArrayType(S), word_count=L, char_count=L, crawled_at=TS, created_at=TS, is_tombstone=B, extra=S)),
    "frontier": (["item_id"], schema(item_id=S, run_id=S, site_id=S, url=S, url_key=S, depth=I, priority=D, status=S, retries=I, referrer_url=S, discovered_at=TS, completed_at=TS, error=S)),
}


class Conflict(RuntimeError):
    """Another writer was there first."""


class Store:
    """Tables as logs of parts: numbered log files name a base and the upserts since then; a reader takes the newest log whole.

    An upsert writes its own rows only; reads lay the parts over one another by key. After COMPACT parts a write makes
    a new base. A log file is written beside its place and renamed to a number that isn't there yet, so that of two writers
    one gets Conflict. The last log but one and its parts stay, for readers that have begun."""

    COMPACT = 8

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, by_site: bool = False):
        self.spark, self.root, self.read_only, self.by_site = spark, root.rstrip("/"), read_only, by_site
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, table: str) -> list[int]:
        folder = self.path(f"{self.root}/{table}/log")
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(folder) if f.getPath().getName().isdigit()) if self.fs.exists(folder) else []

    def _log(self, table: str, number: int | None = None) -> dict:
        """number, the parts from the base on, and how far streams have come."""
        if number is None:
            number = max(self._numbers(table), default=0)
        if not number:
            return {"number": 0, "parts": [], "streams": {}}
        stream = self.fs.open(self.path(f"{self.root}/{table}/log/{number:010d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": number}
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        key, kind = TABLES[table]
        parts = [self.spark.read.schema(kind).parquet(f"{self.root}/{table}/{p}").select(*kind.fieldNames()) for p in self._log(table)["parts"]]
        if not parts:
            return self.spark.createDataFrame([], kind)
        if len(parts) == 1:
            return parts[0]
        marked = reduce(DataFrame.unionByName, [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)])
        return history.latest(marked, key, ["-__part"]).select(*kind.fieldNames())

    def _commit(self, table: str, rows: DataFrame, log: dict, base: bool, stream: tuple[str, int] | None = None) -> None:
        if self.read_only:
            raise PermissionError("the store is open for reading")
        name = uuid.uuid4().hex
        writer = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table][1]]).write
        (writer.partitionBy("site_id") if self.by_site else writer).parquet(f"{self.root}/{table}/{name}")
        new = {"parts": [name] if base else [*log["parts"], name], "streams": log["streams"] | (dict([stream]) if stream else {})}
        folder, number = f"{self.root}/{table}/log", log["number"] + 1
        self.fs.mkdirs(self.path(folder))
        part, to = self.path(f"{folder}/{name}.part"), self.path(f"{folder}/{number:010d}")
        out = self.fs.create(part, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self.fs.exists(to) or not self.fs.rename(part, to):
            self.fs.delete(part, False)
            self.fs.delete(self.path(f"{self.root}/{table}/{name}"), True)
            raise Conflict(f"{table}: log {number} is there already")
        self._clean(table, number)

    def _clean(self, table: str, number: int) -> None:
        """Logs before the last but one go, and parts that only they name."""
        kept = {p for k in self._numbers(table) if k >= number - 1 for p in self._log(table, k)["parts"]}
        for k in self._numbers(table):
            if k < number - 1:
                for p in set(self._log(table, k)["parts"]) - kept:
                    self.fs.delete(self.path(f"{self.root}/{table}/{p}"), True)
                self.fs.delete(self.path(f"{self.root}/{table}/log/{k:010d}"), False)

    def write(self, table: str, rows: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """A new base, a folder a site if the store is laid out so."""
        self._commit(table, rows, self._log(table), True, stream)

    def rows(self, table: str, values: Iterable[dict[str, Any]]) -> DataFrame:
        kind = TABLES[table][1]
        unknown = {k for v in values for k in v} - set(kind.fieldNames())
        if unknown:
            raise ValueError(f"unknown columns of {table}: {sorted(unknown)}")
        return self.spark.createDataFrame([tuple(v.get(f) for f in kind.fieldNames()) for v in values], kind)

    def save(self, table: str, rows: DataFrame | Iterable[dict[str, Any]], order: list[str] | None = None, stream: tuple[str, int] | None = None) -> None:
        """Upsert by key, as many rows at once as there are; of several rows of a key the first by ``order`` wins.

        ``stream`` (name, batch) is noted in the same log, so that a batch is known to be in the table or not."""
        new = rows if isinstance(rows, DataFrame) else self.rows(table, list(rows))
        key, log = TABLES[table][0], self._log(table)
        if len(log["parts"]) >= self.COMPACT:
            self._commit(table, history.upsert(self.read(table), new, key, order), log, True, stream)
        else:
            self._commit(table, history.latest(new, key, order) if order else new, log, False, stream)

    def batch(self, table: str, stream: str) -> int:
        """The last batch of a stream that is in the table; -1 before any."""
        return self._log(table)["streams"].get(stream, -1)

    def get(self, table: str, **key: Any) -> dict | None:
        row = self.find(table, **key).limit(1).collect()
        return row[0].asDict(recursive=True) if row else None

    def find(self, table: str, **equal: Any) -> DataFrame:
        out = self.read(table)
        for k, v in equal.items():
            out = out.where(F.col(k) == v)
        return out

    # the queries by name
    def sites(self) -> DataFrame:
        return self.read("sites").orderBy(F.desc("created_at"), "site_id")

    def runs(self, site_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return history.page_of(self.find("runs", site_id=site_id), ["-created_at", "run_id"], limit, offset)

    def latest_run(self, site_id: str) -> dict | None:
        got = self.runs(site_id, 1).collect()
        return got[0].asDict(recursive=True) if got else None

    def pages(self, site_id: str, limit: int = 1000, offset: int = 0, tombstones: bool = False) -> DataFrame:
        p = self.find("pages", site_id=site_id)
        return history.page_of(p if tombstones else p.where(~F.col("is_tombstone")), ["-last_seen", "page_id"], limit, offset)

    def count_pages(self, site_id: str, tombstones: bool = False) -> int:
        p = self.find("pages", site_id=site_id)
        return (p if tombstones else p.where(~F.col("is_tombstone"))).count()

    def pages_to_recrawl(self, site_id: str, now, max_age_hours: float | None = None, limit: int = 1000) -> DataFrame:
        return history.stale(self.find("pages", site_id=site_id), F.lit(now).cast("timestamp"), max_age_hours, limit)

    def current_version(self, page_id: str) -> DataFrame:
        p = self.find("pages", page_id=page_id).select("page_id", F.col("current_version_id").alias("version_id"))
        return self.read("versions").join(p, ["page_id", "version_id"])

    def versions(self, page_id: str, limit: int = 10) -> DataFrame:
        return history.page_of(self.find("versions", page_id=page_id), ["-crawled_at", "version_id"], limit)

    def frontier(self, run_id: str, status: str | None = None, limit: int = 100) -> DataFrame:
        f = self.find("frontier", run_id=run_id)
        return (f.where(F.col("status") == status) if status else f).orderBy(F.desc("priority"), F.asc("discovered_at"), "item_id").limit(limit)

    def set_status(self, item_id: str, status: str, now, error: str | None = None) -> None:
        hit = F.col("item_id") == item_id
        done = status in ("completed", "failed", "skipped")
        item = self.read("frontier").where(hit).withColumns({"status": F.lit(status), "error": F.lit(error)})
        self.save("frontier", item.withColumn("completed_at", F.lit(now).cast("timestamp")) if done else item)

    def clear_frontier(self, run_id: str) -> int:
        n = self.find("frontier", run_id=run_id).count()
        if n:
            self.write("frontier", history.without(self.read("frontier"), "run_id", run_id))
        return n

    def delete_site(self, site_id: str) -> None:
        """The site and all that belongs to it."""
        for table in ("frontier", "versions", "pages", "runs", "sites"):
            if self._log(table)["parts"]:
                self.write(table, history.without(self.read(table), "site_id", site_id))

    def sql(self, query: str) -> DataFrame:
        """Any query over the tables as views."""
        for t in TABLES:
            self.read(t).createOrReplaceTempView(t)
        return self.spark.sql(query)

    def healthy(self) -> bool:
        try:
            return self.spark.sql("SELECT 1").first()[0] == 1
        except Exception:  # noqa: BLE001
            return False


def open_store(spark: SparkSession, config: dict) -> Store:
    """The store that a configuration names; where it can't be had, the fallback folder, unless it must not fall back."""
    try:
        store = Store(spark, config["root"], config.get("read_only", False), config.get("by_site", False))
        if not config.get("read_only"):
            store.fs.mkdirs(store.path(store.root))
        return store
    except Exception:
        if config.get("fail_if_unavailable", False) or "fallback" not in config:
            raise
        return Store(spark, config["fallback"])
