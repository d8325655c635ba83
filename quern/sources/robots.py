"""Robots rules as rows: parsing, the check of URLs, delays and sitemaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import urls

MODES = ("strict", "off", "allowlist")


def parse(files: DataFrame) -> DataFrame:
    """Rules (domain, agent, kind, value) of robots files (domain, status_code, body); others than 200 give none.

    Lines are numbered; an agent line after a rule begins a new group, and rules go to every agent of their group."""
    line = F.explode(F.transform(F.split("body", r"\r?\n"), lambda x, i: F.struct(i.alias("n"), F.btrim(F.regexp_replace(x, "#.*$", "")).alias("line"))))
    rows = files.where("status_code = 200").select("domain", line.alias("l")).select("domain", "l.n", F.lower(F.btrim(F.split_part("l.line", F.lit(":"), F.lit(1)))).alias("field"), F.btrim(F.regexp_replace("l.line", "^[^:]*:", "")).alias("value")).where("field IN ('user-agent', 'allow', 'disallow', 'crawl-delay', 'sitemap')")
    w = W.Window.partitionBy("domain").orderBy("n")
    in_group = rows.where("field <> 'sitemap'").withColumn("before", F.lag("field").over(w))
    groups = in_group.withColumn("grp", F.sum(((F.col("field") == "user-agent") & (F.coalesce("before", F.lit("")) != "user-agent")).cast("int")).over(w))
    agents = groups.where("field = 'user-agent'").select("domain", "grp", F.lower("value").alias("agent"))
    rules = groups.where("field <> 'user-agent'").select("domain", "grp", F.col("field").alias("kind"), "value").join(agents, ["domain", "grp"]).drop("grp")
    sitemaps = rows.where("field = 'sitemap'").select("domain", F.col("field").alias("kind"), "value", F.lit("*").alias("agent"))
    return rules.unionByName(sitemaps).select("domain", "agent", "kind", "value")


def gathered(candidates: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: Column, known: DataFrame | None = None, ttl: float = 3600.0) -> DataFrame:
    """Rules with fetched_at for every domain of ``candidates`` (url): ``known`` ones up to ``ttl`` seconds old, and others fetched.

    One file a domain is asked for, by the least scheme among its URLs. A domain whose file can't be had or has no rules keeps
    a row of kind 'none', so that it isn't asked again before its time."""
    domains = candidates.select(urls.host(F.col("url")).alias("domain"), F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url")), F.lit("/robots.txt")).alias("url")).groupBy("domain").agg(F.min("url").alias("url"))
    fresh = known.where(F.col("fetched_at") > now - F.make_dt_interval(secs=F.lit(float(ttl)))) if known is not None else None
    wanted = domains.join(fresh.select("domain").distinct(), "domain", "left_anti") if fresh is not None else domains
    files = wanted.join(fetch(wanted.select("url")).select("url", "status_code", F.col("html").alias("body")), "url", "left").select("domain", "status_code", "body")
    none = wanted.select("domain", F.lit("*").alias("agent"), F.lit("none").alias("kind"), F.lit("").alias("value"))
    new = parse(files).unionByName(none).withColumn("fetched_at", now)
    return fresh.select(*new.columns).unionByName(new) if fresh is not None else new


def check(candidates: DataFrame, rules: DataFrame, agent: str = "quern", mode: str = "strict", allow: list[str] | None = None) -> DataFrame:
    """``candidates`` (url) with ``robots_allowed``: the longest matching rule decides, allow on a tie; none allows.

    The agent's own group is used if the domain has one, else that of '*'. 'off' allows all; 'allowlist' allows
    the listed domains whatever their rules. Rules meet candidates by domain in one shuffled or broadcast join,
    as their size says, and a domain's rules are one array."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "off":
        return candidates.withColumn("robots_allowed", F.lit(True))
    own = rules.where(F.col("kind").isin("allow", "disallow") & (F.col("value") != "")).withColumn("mine", F.col("agent") == agent.lower()).where("mine OR agent = '*'")
    own = own.withColumn("best", F.max("mine").over(W.Window.partitionBy("domain"))).where("mine = best")
    arrays = own.groupBy("domain").agg(F.collect_list(F.struct("kind", "value")).alias("rules"))
    path = F.concat(F.when(urls.path(F.col("url")) == "", F.lit("/")).otherwise(urls.path(F.col("url"))), F.regexp_extract("url", r"(\?[^#]*)", 1))
    like = lambda v: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(v, r"([.\\+?^(){}|\[\]])", r"\\$1"), r"\*", ".*"))
    matched = F.filter("rules", lambda r: F.regexp(path, like(r["value"])))
    ranked = F.array_max(F.transform(matched, lambda r: F.struct(F.length(r["value"]).alias("n"), (r["kind"] == "allow").alias("ok"))))
    out = candidates.withColumn("domain", urls.host(F.col("url"))).join(arrays, "domain", "left")
    ok = F.coalesce(ranked["ok"], F.lit(True))
    if mode == "allowlist":
        ok = ok | F.col("domain").isin(*(allow or []))
    return out.withColumn("robots_allowed", ok).drop("rules", "domain")


def delays(rules: DataFrame, agent: str = "quern") -> DataFrame:
    """(domain, delay) in seconds, the agent's own before that of all."""
    d = rules.where(F.col("kind") == "crawl-delay").withColumn("mine", F.col("agent") == agent.lower()).where("mine OR agent = '*'")
    return d.groupBy("domain").agg(F.max_by(F.expr("try_cast(value AS DOUBLE)"), "mine").alias("delay"))


def sitemaps(rules: DataFrame) -> DataFrame:
    return rules.where("kind = 'sitemap'").select("domain", F.col("value").alias("loc")).distinct()
