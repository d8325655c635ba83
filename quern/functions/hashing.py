"""Ids and content hashes: XXH64 of seed 0 in 16 hex digits, natively where the session allows it."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(text: str | bytes) -> str:
    return xxhash.xxh64_hexdigest(text)


def xxh64(text: Column) -> Column:
    """XXH64 with seed 0; Spark's own function has another seed, so the expression is built directly."""
    from pyspark.sql.classic.column import Column as Classic

    if isinstance(text, Classic):
        from pyspark import SparkContext

        jvm = SparkContext._active_spark_context._jvm
        name = "org.apache.spark.sql.catalyst.expressions.XxHash64"
        children = jvm.scala.jdk.javaapi.CollectionConverters.asScala([jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(text._jc)]).toSeq()
        built = getattr(jvm.org.apache.spark.sql.catalyst.expressions, name.rpartition(".")[2])(children, 0)
        return F.when(text.isNotNull(), F.lpad(F.lower(F.hex(Classic(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(built)))), 16, "0"))

    @F.arrow_udf("string")
    def outside(values):
        import pyarrow as pa

        return pa.array([None if v is None else xxhash.xxh64_hexdigest(v) for v in values.to_pylist()], pa.string())

    return outside(text)


def squeezed(text: Column) -> Column:
    """White space of any kind and length as one space, none at the ends."""
    # a single space needs no replacing, and texts have little else
    return F.btrim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]", " "))


def content_hash(text: Column, normalize: bool = True) -> Column:
    return xxh64(squeezed(text) if normalize else text)


def doc_id(url: Column) -> Column:
    return xxh64(url)


def version_id(hash_: Column, at: Column) -> Column:
    return F.concat(F.lit("v_"), F.substring(hash_, 1, 12), F.lit("_"), F.date_format(at, "yyyyMMddHHmmss"))


def chunk_id(doc: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", doc, index)


def site_id(seeds: Iterable[str]) -> str:
    return hash_text("|".join(sorted(seeds)))[:12]


def run_id(now: datetime | None = None) -> str:
    return f"run_{(now or datetime.now()):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
