"""Fetching: captured pages as an offline web, or HTTP in the executors behind one interface."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import html, urls

RESULT = "url string, status string, status_code int, html string, etag string, last_modified string, final_url string, error string, latency_ms double, attempts int"
Fetcher = Callable[[str, dict[str, str]], dict]


def http(timeout: float = 30.0, agent: str = "quern/1.0", headers: dict[str, str] | None = None, proxy: str | None = None) -> Fetcher:
    """GET with conditional headers; answers of 200 to 399 succeed, 304 is not_modified, 404 and 410 are gone."""

    def get(url: str, conditional: dict[str, str]) -> dict:
        opener = urllib.request.build_opener(*([urllib.request.ProxyHandler({"http": proxy, "https": proxy})] if proxy else []))
        request = urllib.request.Request(url, headers={"User-Agent": agent, **(headers or {}), **conditional})
        try:
            with opener.open(request, timeout=timeout) as r:
                body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
                return {"status_code": r.status, "html": body, "etag": r.headers.get("ETag"), "last_modified": r.headers.get("Last-Modified"), "final_url": r.url}
        except urllib.error.HTTPError as e:
            return {"status_code": e.code, "final_url": e.url}

    return get


def outcome(code: int | None) -> str:
    if code is None:
        return "error"
    return "not_modified" if code == 304 else "gone" if code in (404, 410) else "success" if 200 <= code < 400 else "error"


def fetch(requests: DataFrame, fetcher: Fetcher, retries: int = 3, wait: float = 1.0, delay: float = 0.0, threads: int = 8, in_order: bool = False) -> DataFrame:
    """Results of ``requests`` (url, and etag and last_modified if there are any), with bounded retries; with ``in_order`` in the requests' order.

    URLs of one host go to one task, one after another with ``delay`` between them; tasks fetch hosts side by side."""

    def one(row) -> dict:
        conditional = {h: v for h, v in (("If-None-Match", row.get("etag")), ("If-Modified-Since", row.get("last_modified"))) if isinstance(v, str)}
        out = {"url": row["url"], "place": row.get("place"), "status_code": None, "html": None, "etag": None, "last_modified": None, "final_url": None, "error": None}
        began = time.perf_counter()
        for attempt in range(1, retries + 2):
            try:
                out |= fetcher(row["url"], conditional) | {"error": None}
                if out["status_code"] is not None and out["status_code"] < 500:
                    break
            except Exception as e:  # noqa: BLE001 - a fetch may fail in any way; the row says how
                out["error"] = f"{type(e).__name__}: {e}"
            if attempt <= retries:
                time.sleep(min(60.0, wait * 2 ** (attempt - 1)))
        timed_out = (out["error"] or "").startswith("TimeoutError")
        return out | {"status": "timeout" if timed_out else outcome(out["status_code"]), "latency_ms": (time.perf_counter() - began) * 1000, "attempts": attempt}

    schema = RESULT + (", place long" if in_order else "")
    names = [c.split()[0] for c in schema.split(", ")]
    requests = requests.withColumn("place", F.monotonically_increasing_id()) if in_order else requests

    def run(batches):
        for pdf in batches:
            groups = [g.to_dict("records") for _, g in pdf.groupby("host", sort=False)]

            def host(rows):
                out = []
                for i, r in enumerate(rows):
                    if i and delay:
                        time.sleep(delay)
                    out.append(one(r))
                return out

            with ThreadPoolExecutor(threads) as pool:
                done = [r for rows in pool.map(host, groups) for r in rows]
            yield pd.DataFrame(done, columns=names).astype({"status_code": "Int32", "attempts": "Int32"})

    got = requests.withColumn("host", urls.host(F.col("url"))).repartition("host").mapInPandas(run, schema)
    return got.orderBy("place").drop("place") if in_order else got


def captured(requests: DataFrame, web: DataFrame) -> DataFrame:
    """Results from captured pages (url, html): a join, 404 for what wasn't captured."""
    w = web.select("url", "html")
    code = F.when(F.col("html").isNull(), 404).otherwise(200)
    return requests.select("url").join(w, "url", "left").select("url", F.when(code == 200, "success").otherwise("gone").alias("status"), code.alias("status_code"), "html")


def hybrid(results: DataFrame, render: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results with pages that scripts seem to draw rendered anew by ``render`` (url -> url, html); others stay."""
    draw = html.needs_rendering(F.col("html"), html.text(F.col("html")))
    seen = results.withColumn("draw", F.coalesce(draw, F.lit(False)))
    drawn = render(seen.where("draw").select("url")).select("url", F.col("html").alias("drawn"))
    return seen.join(drawn, "url", "left").withColumn("html", F.coalesce("drawn", "html")).drop("drawn", "draw")
