"""Run, domain and status aggregates of a fetch log, and the circuit breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def run(log: DataFrame) -> DataFrame:
    """One row of a log (domain, success, status, latency_ms, bytes, change): counts, sums, mean latency, distinct domains, status."""
    change = lambda k: F.count_if(F.col("change") == k)
    return log.agg(
        F.count(F.lit(1)).alias("pages_crawled"), F.count_if("success").alias("pages_succeeded"), F.count_if(~F.col("success")).alias("pages_failed"),
        change("created").alias("pages_new"), (change("created") + change("changed")).alias("pages_changed"), change("unchanged").alias("pages_unchanged"), change("deleted").alias("pages_deleted"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency_ms"), F.countDistinct("domain").alias("domains"),
    ).withColumn("status", F.when(F.col("pages_failed") > 0, "partial").otherwise("completed"))


def by_domain(log: DataFrame) -> DataFrame:
    return log.groupBy("domain").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.sum("bytes").alias("bytes"),
    ).withColumn("success_rate", F.round(_ratio(F.col("successes"), F.col("requests")), 6))


def histogram(log: DataFrame, column: str) -> DataFrame:
    return log.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram_map(log: DataFrame, column: str) -> DataFrame:
    """The histogram as one map, for the run's record."""
    return histogram(log, column).agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias("histogram"))


def circuit(log: DataFrame, key: str, order: list[str], success: str = "success", threshold: int = 5) -> DataFrame:
    """``log`` with ``failures_in_a_row`` and ``opens``: whether the run of failures reaches the threshold at this row."""
    w = W.Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.col(success).cast("int")).over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    out = log.withColumn("island", island)
    inside = W.Window.partitionBy(key, "island").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    n = F.sum((~F.col(success)).cast("int")).over(inside)
    return out.withColumn("failures_in_a_row", n).withColumn("opens", (F.col("failures_in_a_row") == threshold) & ~F.col(success)).drop("island")


def scheduler(requests: DataFrame, circuits: DataFrame) -> DataFrame:
    """One row: fetches under way, domains tracked, circuits open; of requests (domain, active) and circuits (domain, state)."""
    a = requests.agg(F.count_if("active").alias("active_requests"), F.countDistinct("domain").alias("tracked_domains"))
    return a.crossJoin(circuits.agg(F.count_if(F.col("state") == "open").alias("open_circuits")))
