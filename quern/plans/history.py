"""Queries over crawl history: stores, runs, versions, staleness, sitemaps, fetch metrics, the circuit breaker."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.operators import changes, history, metrics


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit("2001-10-01 00:00:00").cast("timestamp_ntz")


def runs(spark, sf_dir):
    """Orders stand for runs: customer for site, order date for creation."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("site_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("cost"))


def versions(spark, sf_dir):
    """Line items stand for page versions: part for page, ship date for the crawl."""
    l = read(spark, sf_dir, "lineitem")
    return l.select(F.col("l_partkey").alias("page_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version_id"), F.col("l_shipdate").alias("crawled_at"), F.col("l_returnflag").alias("content"), F.col("l_orderkey").alias("run_id"))


def log(spark, sf_dir):
    """Events stand for fetches: user for domain, errors for failures."""
    e = read(spark, sf_dir, "events")
    change = F.expr("CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'changed' WHEN 'view' THEN 'unchanged' WHEN 'click' THEN 'deleted' END")
    return e.select("event_id", "ts", F.col("user_id").alias("domain"), (F.col("event_type") != "error").alias("success"), F.col("event_type").alias("status"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("bytes"), change.alias("change"))


def runs_list(spark, sf_dir):
    """The second page of fifty of all runs, newest first."""
    return history.page_of(runs(spark, sf_dir), ["-created_at", "run_id"], limit=50, offset=50).select("run_id", "site_id")


def latest_run(spark, sf_dir):
    return history.latest(runs(spark, sf_dir), ["site_id"], ["-created_at", "-run_id"]).select("site_id", "run_id")


def runs_by_status(spark, sf_dir):
    """Per site its newest five runs; of those the finished ones, as the status filter comes after the limit."""
    return history.latest(runs(spark, sf_dir), ["site_id"], ["-created_at", "-run_id"], 5).where("status = 'F'").select("site_id", "run_id")


def run_upsert(spark, sf_dir):
    """Old runs overlaid with those of the second half, which have another status."""
    r = runs(spark, sf_dir)
    new = r.where("run_id % 2 = 0").withColumn("status", F.lit("done"))
    return history.upsert(r, new, ["run_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("run_id").alias("ids"))


def site_cascade(spark, sf_dir):
    """What stays after one site's deletion, by table."""
    r = runs(spark, sf_dir)
    v = versions(spark, sf_dir).join(r.select("run_id", "site_id"), "run_id")
    left = {"runs": r, "versions": v}
    out = None
    for name, df in left.items():
        one = history.without(df, "site_id", 7).agg(F.lit(name).alias("kept_table"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def current_version(spark, sf_dir):
    v = versions(spark, sf_dir)
    pages = v.groupBy("page_id").agg(F.max("version_id").alias("current_version_id"))
    return v.join(pages.select("current_version_id"), F.col("version_id") == F.col("current_version_id")).select("page_id", "version_id", "crawled_at")


def version_history_topn(spark, sf_dir):
    return history.latest(versions(spark, sf_dir), ["page_id"], ["-crawled_at", "-version_id"], 3).select("page_id", "version_id", "crawled_at")


def version_count_running(spark, sf_dir):
    w = W.Window.partitionBy("page_id").orderBy("crawled_at", "version_id").rowsBetween(W.Window.unboundedPreceding, 0)
    return versions(spark, sf_dir).select("page_id", "version_id", F.count(F.lit(1)).over(w).alias("version_count"))


def version_changes(spark, sf_dir):
    """Each version against the one before it."""
    w = W.Window.partitionBy("page_id").orderBy("crawled_at", "version_id")
    before = F.lag("content").over(w)
    return versions(spark, sf_dir).select("page_id", "version_id", F.when(before.isNull(), "created").when(before != F.col("content"), "changed").otherwise("unchanged").alias("event"))


def _pages(spark, sf_dir):
    v = versions(spark, sf_dir).groupBy("page_id").agg(F.max("crawled_at").alias("last_crawled"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), (F.col("p_size") == 1).alias("is_tombstone"))
    return p.join(v, "page_id", "left")


def needs_recrawl(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", changes.needs_recrawl(F.col("is_tombstone"), F.col("last_crawled"), now(), 24.5 * 30).alias("due"))


def pages_to_recrawl(spark, sf_dir):
    """The hundred pages crawled longest ago, those never crawled first, tombstones left out."""
    return history.stale(_pages(spark, sf_dir), now(), 24.0 * 30, 100).select("page_id", "last_crawled")


def pages_count(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("is_tombstone")).alias("live"), F.count_if(F.col("last_crawled").isNull()).alias("never"))


def sitemap_skip(spark, sf_dir):
    """Pages whose sitemap entry, here an order's date, is newer than their last crawl, or that have none."""
    p = _pages(spark, sf_dir).withColumn("url", F.concat(F.lit("p"), F.col("page_id")))
    o = read(spark, sf_dir, "orders")
    s = o.select(F.concat(F.lit("p"), F.col("o_orderkey")).alias("loc"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("lastmod"))
    return changes.sitemap_skip(p, s).select("page_id")


def metrics_run(spark, sf_dir):
    return metrics.run(log(spark, sf_dir))


def metrics_domain(spark, sf_dir):
    return metrics.by_domain(log(spark, sf_dir))


def status_histogram(spark, sf_dir):
    return metrics.histogram(log(spark, sf_dir), "status")


def domain_errors(spark, sf_dir):
    return log(spark, sf_dir).where("NOT success").groupBy("domain").agg(F.count(F.lit(1)).alias("errors"), F.max("ts").alias("last_error"))


def circuit_breaker(spark, sf_dir):
    return metrics.circuit(log(spark, sf_dir), "domain", ["ts", "event_id"], threshold=3).where("failures_in_a_row >= 2").select("event_id", "domain", "failures_in_a_row", "opens")


def site_runs(spark, sf_dir):
    """Runs of every site, sites without any too."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_name").alias("name"))
    r = runs(spark, sf_dir).groupBy("site_id").agg(F.count(F.lit(1)).alias("runs"), F.max("created_at").alias("last_run"))
    return c.join(r, "site_id", "left").select("site_id", "name", F.coalesce("runs", F.lit(0)).alias("runs"), "last_run")


QUERIES = {f.__name__: f for f in (runs_list, latest_run, runs_by_status, run_upsert, site_cascade, current_version, version_history_topn, version_count_running, version_changes, needs_recrawl, pages_to_recrawl, pages_count, sitemap_skip, metrics_run, metrics_domain, status_histogram, domain_errors, circuit_breaker, site_runs)}

V = "(SELECT l_partkey AS page_id, l_orderkey * 10 + l_linenumber AS version_id, l_shipdate AS crawled_at, l_returnflag AS content, l_orderkey AS run_id FROM lineitem)"
P = f"(SELECT p.p_partkey AS page_id, p.p_size = 1 AS is_tombstone, v.last_crawled FROM part p LEFT JOIN (SELECT page_id, max(crawled_at) AS last_crawled FROM {V} GROUP BY page_id) v ON p.p_partkey = v.page_id)"
LOG = "(SELECT event_id, ts, user_id AS domain, event_type <> 'error' AS success, event_type AS status, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS bytes FROM events)"

SQL = {
    "runs_list": "SELECT o_orderkey AS run_id, o_custkey AS site_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50",
    "latest_run": "SELECT site_id, run_id FROM (SELECT o_custkey AS site_id, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "runs_by_status": "SELECT site_id, run_id FROM (SELECT o_custkey AS site_id, o_orderkey AS run_id, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5 AND status = 'F'",
    "run_upsert": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE o_orderstatus END AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders GROUP BY 1",
    "site_cascade": f"SELECT 'runs' AS kept_table, count(*) AS n FROM orders WHERE o_custkey <> 7 UNION ALL SELECT 'versions', count(*) FROM {V} v JOIN orders ON run_id = o_orderkey WHERE o_custkey <> 7",
    "current_version": f"SELECT v.page_id, v.version_id, v.crawled_at FROM {V} v JOIN (SELECT max(version_id) AS current_version_id FROM {V} GROUP BY page_id) p ON v.version_id = p.current_version_id",
    "version_history_topn": f"SELECT page_id, version_id, crawled_at FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY crawled_at DESC, version_id DESC) AS n FROM {V}) WHERE n <= 3",
    "version_count_running": f"SELECT page_id, version_id, count(*) OVER (PARTITION BY page_id ORDER BY crawled_at, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version_count FROM {V}",
    "version_changes": f"SELECT page_id, version_id, CASE WHEN before IS NULL THEN 'created' WHEN before <> content THEN 'changed' ELSE 'unchanged' END AS event FROM (SELECT *, lag(content) OVER (PARTITION BY page_id ORDER BY crawled_at, version_id) AS before FROM {V})",
    "needs_recrawl": f"SELECT page_id, CASE WHEN is_tombstone THEN false WHEN last_crawled IS NULL THEN true ELSE epoch_us(TIMESTAMP '2001-10-01') - epoch_us(last_crawled) > 2646000000000 END AS due FROM {P}",
    "pages_to_recrawl": f"SELECT page_id, last_crawled FROM {P} WHERE NOT is_tombstone AND (last_crawled IS NULL OR last_crawled < TIMESTAMP '2001-10-01' - INTERVAL 720 HOUR) ORDER BY last_crawled ASC NULLS FIRST, page_id LIMIT 100",
    "pages_count": f"SELECT count(*) AS pages, count_if(NOT is_tombstone) AS live, count_if(last_crawled IS NULL) AS never FROM {P}",
    "sitemap_skip": f"SELECT page_id FROM {P} p LEFT JOIN orders o ON o.o_orderkey = p.page_id WHERE o.o_orderkey IS NULL OR p.last_crawled IS NULL OR o.o_orderdate + INTERVAL 1 DAY > p.last_crawled",
    "metrics_run": f"""
        SELECT count(*) AS pages_crawled, count_if(success) AS pages_succeeded, count_if(NOT success) AS pages_failed, count_if(status = 'signup') AS pages_new, count_if(status IN ('signup', 'purchase')) AS pages_changed,
               count_if(status = 'view') AS pages_unchanged, count_if(status = 'click') AS pages_deleted, CAST(sum(bytes) AS BIGINT) AS bytes, round(avg(latency_ms), 6) AS avg_latency_ms, count(DISTINCT domain) AS domains,
               CASE WHEN count_if(NOT success) > 0 THEN 'partial' ELSE 'completed' END AS status FROM {LOG}""",
    "metrics_domain": f"SELECT domain, count(*) AS requests, count_if(success) AS successes, count_if(NOT success) AS failures, round(avg(latency_ms), 6) AS avg_latency_ms, CAST(sum(bytes) AS BIGINT) AS bytes, round(count_if(success) / count(*), 6) AS success_rate FROM {LOG} GROUP BY domain",
    "status_histogram": "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type",
    "domain_errors": "SELECT user_id AS domain, count(*) AS errors, max(ts) AS last_error FROM events WHERE event_type = 'error' GROUP BY user_id",
    "circuit_breaker": f"""
        WITH i AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM {LOG}),
        f AS (SELECT *, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY domain, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures_in_a_row FROM i)
        SELECT event_id, domain, failures_in_a_row, failures_in_a_row = 3 AND NOT success AS opens FROM f WHERE failures_in_a_row >= 2""",
    "site_runs": "SELECT c_custkey AS site_id, c_name AS name, coalesce(runs, 0) AS runs, last_run FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS runs, max(o_orderdate) AS last_run FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
}
