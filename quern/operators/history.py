"""Reads and writes of keyed tables: pages of results, newest rows of a group, upserts, cascades, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def ordering(keys: list[str]) -> list[Column]:
    """'-x' is descending with nulls last, 'x' ascending with nulls first."""
    return [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_first(k) for k in keys]


def page_of(rows: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    return rows.orderBy(*ordering(order)).offset(offset).limit(limit)


def latest(rows: DataFrame, group: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps no more of a group than that."""
    w = W.Window.partitionBy(*group).orderBy(*ordering(order))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` overlaid with ``new`` by key; of several new rows of one key the first by ``order`` wins."""
    if order:
        new = latest(new, key, order)
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(~F.col(key).eqNullSafe(F.lit(value)))


def stale(pages: DataFrame, now: Column, max_age_hours: float | None, limit: int) -> DataFrame:
    """Live pages last crawled longer ago than that, or never; longest ago first."""
    live = pages.where(~F.col("is_tombstone"))
    if max_age_hours is not None:
        live = live.where(F.col("last_crawled").isNull() | (F.col("last_crawled") < now - F.make_dt_interval(secs=F.lit(float(max_age_hours * 3600)))))
    return live.orderBy(F.asc_nulls_first("last_crawled"), "page_id").limit(limit)
