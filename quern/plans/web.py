"""Queries over crawled pages: URLs, links, content, frontier and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import hashing, html, markdown, patterns, text, urls
from quern.operators import frontier, gate, links, publish
from quern.sources import crawl

def u():
    return F.col("url")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


# SQL of the same expressions, for DuckDB's dialect of regular expressions
AUTH = r"lower(regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1))"
SCHEME = "lower(regexp_extract(url, '^([^:/?#]+):', 1))"
PATH = "regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
HOST = f"split_part({AUTH}, ':', 1)"
TRACKING = ", ".join(f"'{t}'" for t in urls.TRACKING)
NORMAL = f"""
    SELECT *, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(auth, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(auth, ':443$', '') ELSE auth END
        || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key
    FROM (SELECT *, {SCHEME} AS scheme, {AUTH} AS auth,
                 regexp_replace(regexp_replace(regexp_replace({PATH}, '/+', '/', 'g'), '%7[Ee]', '~', 'g'), '/+$', '') AS p,
                 list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({TRACKING}))) AS q
          FROM pages)"""
HTML_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', chr(10), 'g'), '\n\s*\n', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
WORDS = r"CASE WHEN regexp_replace({t}, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace({t}, '^\s+|\s+$', '', 'g'), '\s+')) END"


def cleaned(x: str) -> str:
    for entity, char in html.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


TITLE = f"coalesce(nullif({cleaned('''regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1)''')}, ''), nullif({cleaned('''regexp_extract(html, '(?is)<h1[^>]*>([^<]+)</h1>', 1)''')}, ''))"
DEPTH = "len(list_filter(string_split({p}, '/'), lambda x: x <> '')) - 1"


def depth():
    return F.size(F.filter(F.split(urls.path(u()), "/"), lambda x: x != "")) - 1


def page_documents(spark, sf_dir):
    """URL form, text, title, sizes and the gate's verdict of every page."""
    docs = pages(spark, sf_dir).select("page_id", "url", urls.normalize(u()).alias("url_key"), html.title(F.col("html")).alias("title"), html.text(F.col("html")).alias("text"))
    docs = docs.withColumns({"n_chars": F.length("text").cast("long"), "n_words": text.word_count(F.col("text"))})
    return gate.gated(docs, "page_id", "url", "text", keep=["url_key", "title", "n_chars", "n_words"])


def url_normalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.normalize(u()).alias("url_key"))


def url_parts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.scheme(u()).alias("scheme"), urls.host(u()).alias("host"), urls.registered_domain(u()).alias("registered_domain"), urls.extension(u()).alias("extension"))


def url_collisions(spark, sf_dir):
    """URLs of one normal form."""
    p = pages(spark, sf_dir).select("page_id", urls.normalize(u()).alias("url_key"))
    return p.groupBy("url_key").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).where("n > 1")


def output_paths(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.output_path(u()).alias("path"))


def link_filter_reason(spark, sf_dir):
    why = links.gate(u(), depth(), ["example.com", "example.org"], True, ["/en", "/de", "/fr"], ["/en/*", "/de/*"], ["*.html"], max_depth=1)
    return pages(spark, sf_dir).select("page_id", why.alias("reason"))


def pattern_rules(spark, sf_dir):
    inc, exc = ["/en/*", r"^https://.*/(de|fr)/\d+$"], ["*utm_source*", "spam-farm"]
    return pages(spark, sf_dir).select("page_id", patterns.included(u(), inc, exc).alias("included"), patterns.reason(u(), inc, exc).alias("why"))


def links_extract(spark, sf_dir):
    return links.extract(pages(spark, sf_dir)).select("page_id", F.col("position").cast("long").alias("position"), "href", "text", "is_internal", "is_nofollow")


def link_summary(spark, sf_dir):
    l = links.extract(pages(spark, sf_dir))
    return l.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if("is_internal").alias("internal"), F.count_if(~F.col("is_internal")).alias("external"))


def link_targets(spark, sf_dir):
    """Inlinks of every target, over all pages."""
    l = links.extract(pages(spark, sf_dir)).select("page_id", urls.path(F.col("href")).alias("path"))
    return l.groupBy("path").agg(F.count(F.lit(1)).alias("inlinks"), F.countDistinct("page_id").alias("pages"))


def html_text(spark, sf_dir):
    t = html.text(F.col("html"))
    return pages(spark, sf_dir).select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n_chars"), text.word_count(t).alias("n_words"))


def _with_head(p: DataFrame) -> DataFrame:
    head = F.concat(F.lit('<html lang="en-US"><head><meta name="description" content="About &amp; around '), F.col("page_id"), F.lit('"><meta content="Crawl Corp" property="og:site_name"><meta name="keywords" content="a, b,, c'), F.col("page_id"), F.lit('"><link rel="canonical" href="'), u(), F.lit('"></head><h2 id="s'), F.col("page_id"), F.lit('">Part '), F.col("page_id"), F.lit("</h2>"))
    return p.withColumn("html", F.concat(head, F.col("html")))


HEAD = """'<html lang="en-US"><head><meta name="description" content="About &amp; around ' || page_id || '"><meta content="Crawl Corp" property="og:site_name"><meta name="keywords" content="a, b,, c' || page_id || '"><link rel="canonical" href="' || url || '"></head>' || html"""


def page_metadata(spark, sf_dir):
    m = _with_head(pages(spark, sf_dir)).select("page_id", html.metadata(F.col("html")).alias("m"))
    return m.select("page_id", "m.title", "m.description", "m.canonical_url", "m.language", "m.og_site_name", F.array_join("m.keywords", "|").alias("keywords"))


def headings_outline(spark, sf_dir):
    h = _with_head(pages(spark, sf_dir)).select("page_id", F.posexplode(html.headings(F.col("html"))).alias("position", "h"))
    return h.select("page_id", F.col("position").cast("long").alias("position"), F.col("h.level").cast("long").alias("level"), "h.text", "h.anchor")


def frontier_priority(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", frontier.priority(u(), depth()).alias("priority"))


def frontier_topk(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", urls.normalize(u()).alias("url_key"), frontier.priority(u(), depth()).alias("priority"), F.lit("pending").alias("status"), F.col("page_id").alias("discovered_at"))
    return frontier.top(p, 50).select("page_id", "priority")


def frontier_bfs(spark, sf_dir):
    """Waves from the least page over links from page n to 3n + 1, 3n + 2 and 3n + 3, until a wave is empty."""
    p = pages(spark, sf_dir).select(F.col("page_id").alias("node"))
    edges = p.select(F.col("node").alias("src"), F.explode(F.array(*[F.col("node") * 3 + k for k in (1, 2, 3)])).alias("dst")).join(p, F.col("dst") == F.col("node"), "left_semi")
    return crawl.breadth_first(p.where("node = 0"), crawl.written(edges))


def breadcrumbs(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", publish.breadcrumbs(u()).alias("breadcrumbs"))


def prev_next(spark, sf_dir):
    p = pages(spark, sf_dir).withColumns({"depth": depth(), "host": urls.host(u())})
    return publish.neighbours(p, "depth", "url", "page_id", within="host").select("page_id", "prev_url", "next_url")


def index_sections(spark, sf_dir):
    return publish.index(pages(spark, sf_dir).withColumn("title", html.title(F.col("html")))).select("section", "pages")


def domain_pages(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(urls.registered_domain(u()).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars"), F.countDistinct(urls.host(u())).alias("hosts"))


def doc_id_xxh64(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", hashing.doc_id(urls.normalize(u())).alias("doc_id"))


def link_rewrite(spark, sf_dir):
    """Markdown that names the next page of the host, its link made relative."""
    w = W.Window.partitionBy(urls.authority(u())).orderBy("page_id")
    d = pages(spark, sf_dir).select("page_id", "url", F.lead("url").over(w).alias("next"))
    d = d.withColumn("markdown", F.concat(F.lit("See [next]("), F.coalesce("next", F.lit("mailto:x@example.com")), F.lit(") and [top](#top).")))
    return publish.rewrite_links(d, "page_id").select("page_id", "markdown")


def publish_files(spark, sf_dir):
    d = pages(spark, sf_dir).select("page_id", "url", html.title(F.col("html")).alias("title"), html.text(F.col("html")).alias("markdown"), (F.col("page_id") % 10 == 0).alias("is_tombstone"), F.lit(None).cast("string").alias("redirect_url"))
    return publish.pages(d).select("path", "action", F.md5("content").alias("content_md5"))


def _markdown(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", markdown.markdown(F.col("html")).alias("markdown"))


def html_markdown(spark, sf_dir):
    return _markdown(spark, sf_dir).select("page_id", F.md5("markdown").alias("markdown_md5"), F.length("markdown").cast("long").alias("n_chars"))


def markdown_blocks(spark, sf_dir):
    """Blocks that pruning keeps, by page."""
    b = markdown.pruned(markdown.blocks(_markdown(spark, sf_dir), "page_id"))
    return b.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("words").alias("words"))


def block_bm25(spark, sf_dir):
    """BM25 of every block for a query; frequencies over all blocks of all pages."""
    b = markdown.bm25(markdown.blocks(_markdown(spark, sf_dir), "page_id"), "page_id", "the en reaux")
    return b.where("score > 0").select("page_id", F.col("block").cast("long").alias("block"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (html_markdown, markdown_blocks, block_bm25, page_documents, url_normalize, url_parts, url_collisions, output_paths, link_filter_reason, pattern_rules, links_extract, link_summary, link_targets, html_text, page_metadata, headings_outline, frontier_priority, frontier_topk, frontier_bfs, breadcrumbs, prev_next, index_sections, domain_pages, doc_id_xxh64, link_rewrite, publish_files)}

SUFFIXES = ", ".join(f"'{s}'" for s in urls.SUFFIXES)
REGISTERED = f"""CASE WHEN regexp_extract({HOST}, '([^.]*\\.[^.]*)$', 1) = '' THEN {HOST} WHEN regexp_extract({HOST}, '([^.]*\\.[^.]*)$', 1) IN ({SUFFIXES}) THEN regexp_extract({HOST}, '((?:[^.]*\\.)?[^.]*\\.[^.]*)$', 1) ELSE regexp_extract({HOST}, '([^.]*\\.[^.]*)$', 1) END"""
EXTENSION = f"lower(regexp_extract({PATH}, '(\\.[^./]{{1,9}})$', 1))"
PRIORITY = f"100.0::DOUBLE / ({DEPTH.format(p=PATH)} + 1) * CASE WHEN " + " OR ".join(f"contains(lower(url), '{w}')" for w in frontier.DOCS) + " THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN " + " OR ".join(f"contains(lower(url), '{w}')" for w in frontier.ARCHIVES) + " THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
BARE = r"regexp_replace(regexp_replace(" + PATH + r", '^/+|/+$', '', 'g'), '\.(html|htm|php|aspx|asp)$', '')"
LINKS = f"""
    raw AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s+[^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a\\s+[^>]*>.*?</a>'), 1) - 1 AS position FROM pages),
    refs AS (SELECT *, trim(regexp_extract(a, '^(?i:<a)\\s+[^>]*?href=["'']([^"'']+)["'']', 1)) AS ref FROM raw),
    hrefs AS (SELECT *, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref ELSE regexp_extract(url, '^[^:]+://[^/?#]*') || ref END AS href FROM refs WHERE ref <> '' AND NOT regexp_matches(ref, '(?i)^(javascript:|mailto:|tel:|data:|#|void\\()')),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, regexp_extract(href, '^([^?#]*)', 1) ORDER BY position) AS n FROM hrefs WHERE regexp_matches(href, '(?i)^https?://')),
    links AS (SELECT page_id, position, href, {cleaned("regexp_replace(regexp_replace(regexp_replace(a, '^<[^>]*>', ''), '</a>$', ''), '<[^>]+>', ' ', 'g')")} AS text,
        lower(regexp_extract(href, '^[^:]+://([^/?#]*)', 1)) = {AUTH} OR ends_with(lower(regexp_extract(href, '^[^:]+://([^/?#:]*)', 1)), '.' || {HOST}) AS is_internal, contains(regexp_extract(a, '^<[^>]*>'), 'nofollow') AS is_nofollow
        FROM firsts WHERE n = 1)"""
TEXT_DOCS = f"SELECT page_id, url, {HTML_TEXT} AS text FROM pages"

MARKDOWN = "html"
for pattern, to in markdown.chain():
    quoted = to.replace("$1", "\\1").replace("$2", "\\2").replace("\n", "' || chr(10) || '")
    MARKDOWN = f"regexp_replace({MARKDOWN}, '{pattern.replace(chr(39), chr(39) * 2)}', '{quoted}', 'g')"
for entity, char in html.ENTITIES:
    MARKDOWN = f"replace({MARKDOWN}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
BLOCKS = f"""
    m AS (SELECT page_id, {MARKDOWN} AS markdown FROM pages),
    parts AS (SELECT page_id, unnest(regexp_split_to_array(markdown, '\\n\\n+')) AS content, generate_subscripts(regexp_split_to_array(markdown, '\\n\\n+'), 1) - 1 AS block FROM m),
    blocks AS (SELECT page_id, block, content, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w,
        coalesce(list_sum(list_transform(regexp_extract_all(content, '\\[([^\\]]*)\\]\\([^)]*\\)', 1), lambda x: length(x))), 0) / length(content) AS link_share FROM parts WHERE content <> '')"""
TERMS = ("en", "reaux", "the")
SCORE = " + ".join(f"ln(1 + (n - df_{t} + 0.5) / (df_{t} + 0.5)) * tf_{t} * 2.5 / (tf_{t} + 1.5 * (0.25 + 0.75 * len(w) / mean))" for t in TERMS)

OUTPUT = f"CASE WHEN {BARE} = '' THEN 'index.md' WHEN contains(regexp_extract({BARE}, '([^/]*)$', 1), '.') THEN {BARE} || '.md' ELSE {BARE} || '/index.md' END"
CRUMBS = "'[Home](/)' || CASE WHEN len(parts) > 1 THEN ' > [' || upper(parts[1][1]) || lower(parts[1][2:]) || '](/' || parts[1] || ')' ELSE '' END || CASE WHEN len(parts) > 0 THEN ' > ' || regexp_replace(parts[len(parts)], '\\.[A-Za-z0-9]+$', '') ELSE '' END"
# a file's way to another: up from its folder to the one they share, then down
RELATIVE = """
    SELECT page_id, nxt, a, b, len(list_filter(range(1, least(len(a), len(b))), lambda i: a[1:i] = b[1:i])) AS shared FROM (
        SELECT d.page_id, d.nxt, string_split(d.file, '/') AS a, string_split(k.file, '/') AS b FROM d LEFT JOIN k ON k.key = d.nxt_key)"""
LOCATION = "regexp_replace(regexp_extract({u}, '^([^?#]*)', 1), '([^/])/+$', '\\1')"

SQL = {
    "link_rewrite": f"""
        WITH p AS (SELECT page_id, url, {OUTPUT} AS file, {LOCATION.format(u="url")} AS key, {AUTH} AS auth FROM pages),
        d AS (SELECT *, {LOCATION.format(u="nxt")} AS nxt_key FROM (SELECT *, lead(url) OVER (PARTITION BY auth ORDER BY page_id) AS nxt FROM p)),
        k AS (SELECT key, min(file) AS file FROM p GROUP BY key)
        SELECT page_id, 'See [next](' || CASE WHEN nxt IS NULL THEN 'mailto:x@example.com' ELSE repeat('../', len(a) - 1 - shared) || array_to_string(b[shared + 1:], '/') END || ') and [top](#top).' AS markdown FROM ({RELATIVE})""",
    "publish_files": f"""
        WITH p AS (SELECT page_id, url, {OUTPUT} AS path, {TITLE} AS title, {HTML_TEXT} AS text, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS parts FROM pages),
        h AS (SELECT *, '---' || chr(10) || 'title: "' || replace(replace(title, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' || chr(10) || 'url: "' || url || '"' || chr(10) || '---' || chr(10) AS head FROM p)
        SELECT path, CASE WHEN page_id % 10 = 0 THEN 'tombstone' ELSE 'write' END AS action, md5(head || CASE WHEN page_id % 10 = 0 THEN chr(10) || '# Page removed' || chr(10) || chr(10) || 'This page is no longer there.' || chr(10)
            ELSE chr(10) || {CRUMBS} || chr(10) || chr(10) || '*Source: [' || url || '](' || url || ')*' || chr(10) || chr(10) || coalesce(text, '') || chr(10) END) AS content_md5 FROM h""",
    "html_markdown": f"WITH {BLOCKS} SELECT page_id, md5(markdown) AS markdown_md5, length(markdown) AS n_chars FROM m",
    "markdown_blocks": f"WITH {BLOCKS} SELECT page_id, count(*) AS blocks, CAST(sum(len(w)) AS BIGINT) AS words FROM blocks WHERE starts_with(content, '#') OR (len(w) >= 5 AND link_share <= 0.5) GROUP BY page_id",
    "block_bm25": f"""
        WITH {BLOCKS}, t AS (SELECT *, {", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf_{t}" for t in TERMS)} FROM blocks),
        g AS (SELECT count(*) AS n, avg(len(w)) AS mean, {", ".join(f"count_if(tf_{t} > 0) AS df_{t}" for t in TERMS)} FROM t)
        SELECT page_id, block, round({SCORE}, 6) AS score FROM t, g WHERE {SCORE} > 0""",
    "page_documents": f"""
        WITH n AS ({NORMAL}), t AS (SELECT page_id, url, url_key, {TITLE} AS title, {HTML_TEXT} AS text FROM n),
        own AS (SELECT *, {WORDS.format(t='text')} AS n_words, CASE WHEN regexp_matches(url, '(?i){"|".join(gate.BLOCKED_URLS)}') THEN 'blocked_pattern' WHEN length(text) < 100 THEN 'too_short' WHEN {WORDS.format(t='text')} < 10 THEN 'low_word_count' END AS own FROM t),
        c AS (SELECT *, CASE WHEN own IS NULL THEN min(CASE WHEN own IS NULL THEN page_id END) OVER (PARTITION BY trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS first_id FROM own)
        SELECT page_id, url_key, title, length(text) AS n_chars, CAST(n_words AS BIGINT) AS n_words, coalesce(own, CASE WHEN first_id <> page_id THEN 'duplicate_content' ELSE 'passed' END) AS reason, CASE WHEN first_id <> page_id THEN first_id END AS duplicate_of FROM c""",
    "url_normalize": f"SELECT page_id, url_key FROM ({NORMAL})",
    "url_parts": f"SELECT page_id, {SCHEME} AS scheme, {HOST} AS host, {REGISTERED} AS registered_domain, {EXTENSION} AS extension FROM pages",
    "url_collisions": f"SELECT url_key, count(*) AS n, min(page_id) AS first_id FROM ({NORMAL}) GROUP BY url_key HAVING count(*) > 1",
    "output_paths": f"SELECT page_id, {OUTPUT} AS path FROM pages",
    "link_filter_reason": f"""
        SELECT page_id, CASE WHEN {SCHEME} = '' OR {AUTH} = '' THEN 'invalid_url' WHEN {SCHEME} NOT IN ('http', 'https') THEN 'invalid_scheme' WHEN {DEPTH.format(p=PATH)} > 1 THEN 'max_depth_exceeded'
            WHEN NOT ({HOST} IN ('example.com', 'example.org') OR ends_with({HOST}, '.example.com') OR ends_with({HOST}, '.example.org')) THEN 'domain_not_allowed'
            WHEN NOT (starts_with({PATH}, '/en') OR starts_with({PATH}, '/de') OR starts_with({PATH}, '/fr')) THEN 'path_not_allowed'
            WHEN regexp_matches(lower({PATH}), '({"|".join(e.replace(".", chr(92) + ".") for e in links.BLOCKED_EXTENSIONS)})$') THEN 'blocked_extension'
            WHEN ends_with(lower(url), '.html') THEN 'excluded_pattern' WHEN NOT (contains(lower(url), '/en/') OR contains(lower(url), '/de/')) THEN 'no_include_match' ELSE 'allowed' END AS reason FROM pages""",
    "pattern_rules": """
        SELECT page_id, NOT (contains(lower(url), 'utm_source') OR contains(lower(url), 'spam-farm')) AND (contains(lower(url), '/en/') OR regexp_matches(url, '(?i)^https://.*/(de|fr)/\\d+$')) AS included,
            CASE WHEN contains(lower(url), 'utm_source') THEN 'exclude:*utm_source*' WHEN contains(lower(url), 'spam-farm') THEN 'exclude:spam-farm' WHEN contains(lower(url), '/en/') THEN 'include:/en/*'
                 WHEN regexp_matches(url, '(?i)^https://.*/(de|fr)/\\d+$') THEN 'include:^https://.*/(de|fr)/\\d+$' END AS why FROM pages""",
    "links_extract": f"WITH {LINKS} SELECT * FROM links",
    "link_summary": f"WITH {LINKS} SELECT page_id, count(*) AS links, count_if(is_internal) AS internal, count_if(NOT is_internal) AS external FROM links GROUP BY page_id",
    "link_targets": f"WITH {LINKS} SELECT regexp_extract(href, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, count(*) AS inlinks, count(DISTINCT page_id) AS pages FROM links GROUP BY 1",
    "html_text": f"SELECT page_id, md5(text) AS text_md5, length(text) AS n_chars, CAST({WORDS.format(t='text')} AS BIGINT) AS n_words FROM ({TEXT_DOCS})",
    "page_metadata": f"SELECT page_id, {TITLE} AS title, 'About & around ' || page_id AS description, url AS canonical_url, 'en' AS language, 'Crawl Corp' AS og_site_name, 'a|b|c' || page_id AS keywords FROM (SELECT page_id, url, {HEAD} AS html FROM pages)",
    "headings_outline": f"""
        WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>[^<]+</h[1-6]>')) AS h, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6][^>]*>[^<]+</h[1-6]>'), 1) AS k FROM pages)
        SELECT page_id, 0::BIGINT AS position, 2::BIGINT AS level, 'Part ' || page_id AS text, 's' || page_id AS anchor FROM pages UNION ALL
        SELECT page_id, k::BIGINT, CAST(regexp_extract(h, '(?i)^<h([1-6])', 1) AS BIGINT), {cleaned("regexp_extract(h, '>([^<]+)<', 1)")}, nullif(regexp_extract(h, '(?i)^<h[1-6][^>]*\\sid=["'']([^"'']+)["'']', 1), '') FROM h""",
    "frontier_priority": f"SELECT page_id, {PRIORITY} AS priority FROM pages",
    "frontier_topk": f"SELECT page_id, {PRIORITY} AS priority FROM pages ORDER BY priority DESC, page_id LIMIT 50",
    "frontier_bfs": """
        WITH RECURSIVE waves AS (
            SELECT page_id AS node, 0 AS depth FROM pages WHERE page_id = 0 UNION ALL
            SELECT p.page_id, w.depth + 1 FROM waves w JOIN pages p ON p.page_id IN (3 * w.node + 1, 3 * w.node + 2, 3 * w.node + 3))
        SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM waves GROUP BY node""",
    "breadcrumbs": f"""
        WITH p AS (SELECT page_id, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS parts FROM pages)
        SELECT page_id, '[Home](/)' || CASE WHEN len(parts) > 1 THEN ' > [' || upper(parts[1][1]) || lower(parts[1][2:]) || '](/' || parts[1] || ')' ELSE '' END || CASE WHEN len(parts) > 0 THEN ' > ' || regexp_replace(parts[len(parts)], '\\.[A-Za-z0-9]+$', '') ELSE '' END AS breadcrumbs FROM p""",
    "prev_next": f"""
        WITH p AS (SELECT page_id, url, {HOST} AS host, {DEPTH.format(p=PATH)} AS depth FROM pages)
        SELECT page_id, lag(url) OVER w AS prev_url, lead(url) OVER w AS next_url FROM p WINDOW w AS (PARTITION BY host ORDER BY depth, url, page_id)""",
    "index_sections": f"WITH p AS (SELECT list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS parts FROM pages) SELECT CASE WHEN len(parts) > 1 THEN parts[1] ELSE '/' END AS section, count(*) AS pages FROM p GROUP BY 1",
    "domain_pages": f"SELECT {REGISTERED} AS domain, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars, count(DISTINCT {HOST}) AS hosts FROM pages GROUP BY 1",
}
