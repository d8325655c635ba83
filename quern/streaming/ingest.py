"""Fetch results as a stream: each batch updates pages and versions and appends its change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import hashing, urls
from quern.operators import job
from quern.operators.history import latest
from quern.sources.store import Store

SCHEMA = "url string, status_code int, html string, fetched_at timestamp"


def results(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def apply(batch: DataFrame, store: Store, site_id: str, run_id: str, events: str, number: int) -> None:
    """One batch: the newest result of each URL against the page as stored.

    Events and versions come before pages, whose log also says which batch is in. A batch that comes again before that
    finds the pages as they were and writes the same events and versions over; after it, it does nothing."""
    if store.batch("pages", events) >= number:
        return
    keyed = batch.withColumn("url_key", urls.normalize(F.col("url")))
    new = job.extracted(latest(keyed, ["url_key"], ["-fetched_at"])).withColumn("doc_id", hashing.doc_id(F.col("url_key"))).withColumns({"depth": F.lit(0), "referrer_url": F.lit(None).cast("string")})
    pages = store.find("pages", site_id=site_id)
    old = pages.select(F.col("page_id").alias("doc_id"), F.col("content_hash").alias("old_hash"), "is_tombstone")
    gone = F.col("status_code").isin(404, 410)
    kind = (
        F.when(gone & F.col("old_hash").isNotNull() & ~F.col("is_tombstone"), "deleted").when(gone | ~F.col("status_code").between(200, 299), F.lit(None).cast("string"))
        .when(F.col("old_hash").isNull(), "created").when(F.col("old_hash") != F.col("content_hash"), "changed").otherwise("unchanged")
    )
    rows = new.join(old, "doc_id", "left").withColumn("event", kind).where("event IS NOT NULL").persist()
    try:
        rows.select("doc_id", "url", "event", "old_hash", "content_hash", "fetched_at", F.lit(run_id).alias("run_id")).write.mode("overwrite").parquet(f"{events}/batch={number}")
        fetched = F.col("fetched_at")
        written = rows.where("event IN ('created', 'changed')").drop("old_hash", "is_tombstone", "event")
        for_pages, for_versions = job.versioned(written, pages, site_id, run_id, fetched)
        store.save("versions", for_versions)
        dead = rows.where("event = 'deleted'").select(F.col("doc_id").alias("page_id"))
        tombs = pages.join(dead, "page_id").withColumn("is_tombstone", F.lit(True))
        store.save("pages", for_pages.unionByName(tombs.select(*for_pages.columns)), stream=(events, number))
    finally:
        rows.unpersist()


def start(stream: DataFrame, store: Store, site_id: str, run_id: str, events: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(lambda df, n: apply(df, store, site_id, run_id, events, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
