from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import html, markdown
from quern.functions.hashing import hash_text
from quern.operators import changes, chunking, frontier, gate, history, job, links, metrics, publish
from quern.sources import config, crawl, fetch, robots, sitemap
from quern.sources.store import Conflict, open_store

PAGE = """<html lang="en-GB"><head><title> A &amp; B </title><meta content="d" name="description"><meta property="og:title" content="OG">
<link rel="canonical" href="https://e.com/c"><style>x{}</style></head><body><h2 id="s">Two</h2><script>var a = "<b>";</script>
<a href="/p?a=1">one <b>x</b></a><a href='/p?a=2'>again</a><a rel="nofollow" href="https://o.org/z#f">out</a><a href="mailto:x@y.z">m</a><a href="../up">up</a></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "https://e.com/d/i.html", PAGE)], "page_id int, url string, html string")
    m = df.select(html.metadata(F.col("html")).alias("m")).first().m
    assert (m.title, m.description, m.canonical_url, m.language) == ("A & B", "d", "https://e.com/c", "en") and [tuple(h) for h in m.headings] == [(2, "Two", "s")]
    t = df.select(html.text(F.col("html"))).first()[0]
    assert "var a" not in t and "<" not in t and "one" in t
    got = [tuple(r) for r in links.extract(df).orderBy("position").select("href", "text", "is_internal", "is_nofollow", "anchor").collect()]
    assert got == [("https://e.com/p?a=1", "one x", True, False, None), ("https://o.org/z#f", "out", False, True, "f"), ("https://e.com/up", "up", True, False, None)]


def test_gate_order(spark):
    rows = [("https://sub.e.com/docs/a", 2), ("https://e.com/docs/a", 3), ("ftp://e.com/x", 0), ("javascript:x", 0), ("https://o.com/docs/", 0), ("https://e.com/x.pdf", 0), ("https://e.com/docs/private", 0), ("https://e.com/blog", 0), ("", 0)]
    df = spark.createDataFrame(rows, "url string, depth int")
    why = links.gate(F.col("url"), F.col("depth"), ["e.com"], include=["/docs/*"], exclude=["*private*"], max_depth=2)
    assert [r[0] for r in df.select(why).collect()] == ["allowed", "max_depth_exceeded", "invalid_scheme", "invalid_url", "domain_not_allowed", "blocked_extension", "excluded_pattern", "no_include_match", "invalid_url"]


def test_quality_gate(spark):
    long = "the words of this page are many and good " * 4
    rows = [(1, "https://e.com/login", long), (2, "https://e.com/a", "tiny"), (3, "https://e.com/b", "x" * 200), (4, "https://e.com/c", long), (5, "https://e.com/d", "  " + long), (6, "https://e.com/e", None)]
    out = gate.gated(spark.createDataFrame(rows, "k int, url string, text string"), "k", "url").orderBy("k")
    assert [(r.k, r.reason, r.duplicate_of) for r in out.collect()] == [(1, "blocked_pattern", None), (2, "too_short", None), (3, "low_word_count", None), (4, "passed", None), (5, "duplicate_content", 4), (6, "too_short", None)]
    wrong = gate.gated(spark.createDataFrame(rows[3:5], "k int, url string, text string"), "k", "url", languages=["fr"]).orderBy("k")
    assert [r.reason for r in wrong.collect()] == ["wrong_language", "duplicate_content"]


def test_frontier(spark):
    c = spark.createDataFrame([("a", "https://e.com/docs/a", 0, 5.0), ("a", "https://e.com/docs/a?x", 1, 9.0), ("b", "b", 1, 7.0), ("c", "c", 1, 6.0)], "url_key string, url string, depth int, priority double")
    seen = spark.createDataFrame([("c",)], "url_key string")
    assert [(r.url_key, r.depth) for r in frontier.admit(c, seen, 5).collect()] == [("b", 1), ("a", 0)]
    assert [r.url_key for r in frontier.admit(c, seen, 1).collect()] == ["b"]
    f = spark.createDataFrame([("a", "in_progress", 8.0, 0)], "url_key string, status string, priority double, retries int")
    assert tuple(frontier.returned(f, f.select("url_key")).select("status", "priority", "retries").first()) == ("pending", 4.0, 1)
    p = spark.range(1).select(frontier.priority(F.lit("https://e.com/docs/x"), F.lit(1)), frontier.priority(F.lit("https://e.com/tag/x"), F.lit(0))).first()
    assert tuple(p) == (75.0, 50.0)


def test_chunkers():
    md = "lead\n\n# One\n\n" + "a b. " * 30 + "\n\n### Three\n\n" + "c " * 60 + "\n\n## Two\n\n" + "d " * 60 + "\n\n#### Four\n\nlost"
    got = chunking.by_heading(md)
    assert [(c[0], c[1], c[2]) for c in got] == [("One", 1, "One"), ("Three", 3, "One > Three"), ("Two", 2, "One > Two")]
    assert [c[0] for c in chunking.by_heading("# A\n\n" + "x" * 200 + "\n\n## B\n\n" + "y" * 200 + "\n\n## C\n\n" + "z" * 200, levels=[2])] == ["B", "C"]
    assert len(chunking.by_heading("plain text", "T")) == 1 and chunking.by_heading("", None) == []
    big = "# H\n\n" + "sentence one. " * 400
    assert all(len(c[3]) <= 2000 for c in chunking.by_heading(big)) and len(chunking.by_heading(big)) > 2


def test_token_chunks_end():
    parts = chunking.by_tokens("x" * 10_000, size=50, overlap=10)
    assert all(len(p) <= 200 for p in parts) and parts[0][-40:] == parts[1][:40] and sum(map(len, parts)) - 40 * (len(parts) - 1) == 10_000
    assert chunking.by_tokens("", 50, 10) == [] and chunking.by_tokens("short", 50, 10) == ["short"]
    with pytest.raises(ValueError):
        chunking.by_tokens("x", 10, 10)


def test_chunk_rows(spark):
    df = spark.createDataFrame([("d", "# A\n\n" + "x " * 100 + "\n\n# B\n\n" + "y " * 100), ("e", None)], "doc_id string, markdown string")
    rows = chunking.heading_chunks(df, "doc_id").orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.is_first, r.is_last, r.total_chunks) for r in rows] == [("d_chunk_0000", True, False, 2), ("d_chunk_0001", False, True, 2)]
    flat = chunking.sections(df, "doc_id", F.col("markdown")).collect()
    assert [(r.heading, r.path) for r in flat] == [("A", "A"), ("B", "B")]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, t string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (5, "e"), (4, None)], "k int, t string")
    assert {r.k: r.event for r in changes.events(old, new, "k", "t").collect()} == {1: "unchanged", 2: "changed", 3: "deleted", 4: "unchanged", 5: "created"}
    got = changes.diff_ratio(spark.createDataFrame([("abcd", "bcde"), ("x", "x"), (None, "y")], "a string, b string"), "a", "b").collect()
    assert [(r.ratio, r.significant) for r in got] == [(0.75, True), (1.0, False), (0.0, True)]
    now = F.lit(datetime(2024, 1, 2)).cast("timestamp")
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    due = lambda tomb, last, age, force=False: changes.needs_recrawl(F.lit(tomb), last, now, age, force)
    row = spark.range(1).select(due(True, at, 1, True), due(True, at, 1), due(False, F.lit(None).cast("timestamp"), 100), due(False, at, 24), due(False, at, 23.5), due(False, at, None)).first()
    assert tuple(row) == (True, False, True, False, True, True)


def test_metrics(spark):
    log = spark.createDataFrame([("d", True, "200", 50.0, 1024, "created"), ("d", False, "500", 100.0, 512, None)], "domain string, success boolean, status string, latency_ms double, bytes long, change string")
    r = metrics.run(log).first()
    assert (r.pages_crawled, r.pages_failed, r.bytes, r.avg_latency_ms, r.status) == (2, 1, 1536, 75.0, "partial")
    assert metrics.by_domain(log).first().success_rate == 0.5
    assert metrics.run(log.where("false")).first().pages_crawled == 0


def test_publishing(spark):
    docs = spark.createDataFrame([("1", "https://e.com/docs/page", "[Internal](other) [Out](https://x.org) [A](#a) [M](mailto:a@b.c)", "T", 1, False, None), ("2", "https://e.com/docs/other", "x", None, 0, True, "/n")], "doc_id string, url string, markdown string, title string, depth int, is_tombstone boolean, redirect_url string")
    got = {r.doc_id: r.markdown for r in publish.rewrite_links(docs).collect()}
    assert got["1"] == "[Internal](../other/index.md) [Out](https://x.org) [A](#a) [M](mailto:a@b.c)" and got["2"] == "x"
    assert [r.url for r in publish.single_page(docs).collect()] == ["https://e.com/docs/other", "https://e.com/docs/page"]
    files = {r.path: (r.action, r.content) for r in publish.pages(docs, "redirect").collect()}
    assert files["docs/other/index.md"][0] == "redirect" and "/n" in files["docs/other/index.md"][1] and 'title: "T"' in files["docs/page/index.md"][1]
    import json

    assert [d["doc_id"] for d in json.loads(publish.json_array(docs, "doc_id"))] == ["1", "2"]


def test_write_files(spark, tmp_path):
    files = spark.createDataFrame([("a/index.md", "x"), ("b.md", "y")], "path string, content string")
    publish.write_files(files, str(tmp_path))
    assert (tmp_path / "a/index.md").read_text() == "x" and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b.md"]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 2\n\nUser-agent: quern\nDisallow: /q*z\nSitemap: https://e.com/s.xml"
    rules = robots.parse(spark.createDataFrame([("e.com", 200, body), ("o.com", 404, "User-agent: *\nDisallow: /")], "domain string, status_code int, body string"))
    urls_ = spark.createDataFrame([("https://e.com/private/x",), ("https://e.com/qaz",), ("https://o.com/a",)], "url string")
    ok = lambda agent: {r.url.split("/", 3)[3]: r.robots_allowed for r in robots.check(urls_, rules, agent).collect()}
    assert ok("quern") == {"private/x": True, "qaz": False, "a": True} and ok("other") == {"private/x": False, "qaz": True, "a": True}
    assert robots.delays(rules, "other").first().delay == 2.0 and robots.sitemaps(rules).first().loc == "https://e.com/s.xml"


def test_robots_are_fetched_once_in_their_time(spark):
    asked: list = []

    def files(requests):
        rows = [r.url for r in requests.collect()]
        asked.append(sorted(rows))
        return spark.createDataFrame([(u, 200 if "//e.com" in u else 404, "User-agent: *\nDisallow: /private") for u in rows], "url string, status_code int, html string")

    at = lambda hour: F.lit(datetime(2024, 1, 1, hour)).cast("timestamp")
    wave = spark.createDataFrame([("https://e.com/private/x",), ("https://e.com/y",), ("http://o.org/private/z",)], "url string")
    rules = robots.gathered(wave, files, at(0)).cache()
    assert {r.url: r.robots_allowed for r in robots.check(wave, rules).collect()} == {"https://e.com/private/x": False, "https://e.com/y": True, "http://o.org/private/z": True}
    robots.gathered(wave, files, F.lit(datetime(2024, 1, 1, 0, 30)).cast("timestamp"), rules).collect()
    again = robots.gathered(wave, files, at(2), rules)
    assert again.count() == rules.count() and asked == [["http://o.org/robots.txt", "https://e.com/robots.txt"], [], ["http://o.org/robots.txt", "https://e.com/robots.txt"]]
    home = spark.createDataFrame([("https://e.com/private/x", "<p>" + "many words are here and there " * 9 + "</p>"), ("https://e.com/", "<p>" + "other words are here and there " * 9 + "</p>")], "url string, html string")
    done = job.crawl(spark, config.Crawl(seeds=("https://e.com/", "https://e.com/private/x")), lambda r: fetch.captured(r, home), rules=lambda wave: robots.gathered(wave, files, at(0)))
    assert [r.url for r in done.documents.collect()] == ["https://e.com/"]


def test_frontier_by_domain(spark):
    items = spark.createDataFrame([("https://a.com/1", "pending"), ("https://a.com/2", "failed"), ("https://b.com/", "completed")], "url string, status string")
    assert {tuple(r) for r in frontier.by_domain(items).collect()} == {("a.com", 1, 0, 0, 1, 2), ("b.com", 0, 0, 1, 0, 1)}


def test_site_files(spark):
    """Neighbours over several ranges, links between files, the source, and no link to what is removed."""
    rows = [(f"d{i}", f"https://e.com/p{i:02}", f"T{i}", f"See [x](/p{(i + 1) % 30:02}).", i % 3, i == 5) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id string, url string, title string, markdown string, depth int, is_tombstone boolean").repartition(4)
    got = {r.path: r for r in publish.site(docs, order=("url",)).collect()}
    assert len(got) == 30 and got["p05/index.md"].action == "tombstone"
    page = got["p06/index.md"].content
    assert "*Source: [https://e.com/p06](https://e.com/p06)*" in page and "[x](../p07/index.md)" in page
    assert page.rstrip().endswith("**Previous:** [T4](../p04/index.md) | **Next:** [T7](../p07/index.md)")
    assert "Previous" not in got["p00/index.md"].content and "Next" not in got["p29/index.md"].content


def test_sitemaps(spark):
    xml = '<urlset xmlns="x"><url><loc>https://e.com/a&amp;b</loc><lastmod>2024-01-02T03:04:05+00:00</lastmod><priority>0.5</priority></url><url><loc>https://e.com/c</loc><lastmod>bad</lastmod></url></urlset>'
    bodies = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>s</loc></sitemap></sitemapindex>"), ("s", xml)], "source string, body string")
    got = {r.loc: (r.lastmod, r.priority) for r in sitemap.all_entries(spark.createDataFrame([("i",)], "source string"), bodies).collect()}
    assert got == {"https://e.com/a&b": (datetime(2024, 1, 2, 3, 4, 5), 0.5), "https://e.com/c": (None, None)}


def test_fetch_retries(spark):
    def flaky(url, conditional):
        if "fail" in url:
            raise TimeoutError("slow")
        return {"status_code": 304 if conditional else 200, "html": "<p>x</p>"}

    req = spark.createDataFrame([("https://e.com/a", None), ("https://e.com/b", "tag"), ("https://o.com/fail", None)], "url string, etag string")
    got = {r.url: (r.status, r.attempts) for r in fetch.fetch(req, flaky, retries=1, wait=0).collect()}
    assert got == {"https://e.com/a": ("success", 1), "https://e.com/b": ("not_modified", 1), "https://o.com/fail": ("timeout", 2)}
    assert [r.url for r in fetch.fetch(req.repartition(3), flaky, retries=0, wait=0, in_order=True).collect()] == [r.url for r in req.repartition(3).collect()]


def test_chunks_counted_by_an_encoding(spark):
    text = "Überraschung und noch mehr davon. " * 40
    count = chunking.counter("/opt/tokenizers/byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([("d", text)], "doc_id string, markdown string")
    got = chunking.token_chunks(docs, "doc_id", size=64, overlap=0, count=count).collect()
    assert len(got) > 3 and all(count(r.content) <= 64 for r in got) and "".join(r.content for r in got).replace(" ", "") == text.replace(" ", "")
    assert chunking.with_documents(spark.createDataFrame([("d", 1), ("e", 2)], "doc_id string, k int"), docs, "doc_id", "markdown").where("markdown IS NULL").count() == 1


def test_chunks_leave_before_the_batch_is_through(spark, tmp_path):
    """What Python holds follows HELD and a document, not the batch; keys stay with their chunks across the parts."""
    peak = tmp_path / "peak"

    def count(text):  # in the worker
        import tracemalloc

        import pandas  # noqa: F401 (pyarrow imports these when it first needs them; they aren't to count)
        import pyarrow.compute  # noqa: F401

        if text.startswith("first"):
            tracemalloc.start()
        if text == "last":
            peak.write_text(str(tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()
        return len(text) // 4

    word = F.when(F.col("id") == 0, "first ").otherwise("words ")
    docs = spark.range(501).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 500, "last").otherwise(F.repeat(word, 2500)).alias("markdown"))  # a batch of 7.5 MB
    got = chunking.token_chunks(docs, "doc_id", count=count)
    r = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("total_chunks").alias("t"), F.min("content").alias("c"), F.sum(F.col("is_last").cast("int")).alias("last")).orderBy("doc_id").collect()
    assert [x.doc_id for x in r] == list(range(501)) and all(x.n == x.t and x.last == 1 for x in r) and "first" in r[0].c and r[-1].c == "last"
    assert int(peak.read_text()) < 3 << 20


def test_store(spark, tmp_path):
    store = open_store(spark, {"root": str(tmp_path / "s")})
    t = datetime(2024, 1, 1)
    store.save("sites", [{"site_id": "a", "created_at": t}, {"site_id": "b", "created_at": t}])
    store.save("sites", [{"site_id": "a", "name": "A", "created_at": t}])
    assert store.get("sites", site_id="a")["name"] == "A" and store.sites().count() == 2
    store.save("pages", [{"page_id": str(i), "site_id": "a", "url": f"u{i}", "is_tombstone": i == 2, "last_crawled": None if i else t, "last_seen": t} for i in range(3)])
    assert store.count_pages("a") == 2 and store.count_pages("a", True) == 3 and [r.page_id for r in store.pages_to_recrawl("a", t).collect()] == ["1", "0"]
    store.save("frontier", [{"item_id": "x", "run_id": "r", "status": "pending", "priority": 1.0}])
    store.set_status("x", "completed", t)
    assert store.frontier("r", "completed").count() == 1 and store.clear_frontier("r") == 1
    store.delete_site("a")
    again = open_store(spark, {"root": str(tmp_path / "s"), "read_only": True})
    assert again.count_pages("a", True) == 0 and again.get("sites", site_id="b") is not None and again.healthy()
    with pytest.raises(PermissionError):
        again.save("sites", [{"site_id": "c"}])
    with pytest.raises(ValueError):
        store.save("sites", [{"nope": 1}])
    assert store.sql("SELECT count(*) FROM sites").first()[0] == 1


def test_config(tmp_path):
    assert config.build(config.Crawl, {"seeds": ["a"], "quality": {"min_words": 3}}).quality.min_words == 3
    with pytest.raises(ValueError):
        config.build(config.Crawl, {"speed": 3})
    with pytest.raises(ValueError):
        config.Sync(strategies=("guess",))
    (tmp_path / "c.toml").write_text('seeds = ["a"]\nmax_depth = 2\n')
    assert config.load(config.Crawl, tmp_path / "c.toml").max_depth == 2
    u = config.UserConfig(tmp_path / "u.json")
    (tmp_path / "u.json").write_text("{broken")
    assert u.load()["max_pages"] == 100
    u.set("max_pages", "7")
    assert u.load()["max_pages"] == 7


def web(spark):
    body = "<p>" + "the page has many words and they are fine " * 5 + "</p>"
    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [("https://e.com/", body + "0" + link("/a", "/b", "https://o.org/")), ("https://e.com/a", body + "1" + link("/c", "/gone")), ("https://e.com/b", body + "1" + link("/c", "/gone")), ("https://e.com/c", "short")]
    return spark.createDataFrame(rows, "url string, html string")


def test_crawl_and_sync(spark, tmp_path):
    pages, heard = web(spark), []
    hooks = job.Hooks(redact=[lambda s: s.replace("many", "MANY")], on_page=[lambda r: heard.append(r["url"])], on_error=[lambda r: 1 / 0])
    done = job.crawl(spark, config.Crawl(seeds=("https://e.com/",)), lambda r: fetch.captured(r, pages), hooks=hooks)
    assert sorted(heard) == ["https://e.com/", "https://e.com/a"] and len(hooks.errors) == 1
    assert {r.url for r in done.log.where("NOT success").collect()} == {"https://e.com/gone"} and job.finished(done.log)["status"] == "partial"
    assert "MANY" in done.documents.first().markdown
    store = open_store(spark, {"root": str(tmp_path / "s")})
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    for _ in range(2):  # again: nothing is new
        p, v = job.versioned(done.documents, store.read("pages"), "s", "r", now)
        n = v.count()
        store.save("versions", v)
        store.save("pages", p)
    assert n == 0 and store.read("versions").count() == 2 and {r.version_count for r in store.read("pages").collect()} == {1}
    known = spark.createDataFrame([("https://e.com/", None, 0), ("https://e.com/dead", "x", 1), ("https://e.com/lost", "x", 0)], "url string, content_hash string, error_count int").withColumns({"is_tombstone": F.lit(False), "last_crawled": now})
    out = job.sync(known, lambda r: fetch.captured(r, pages), config.Sync(), now)
    assert {r.url: r.outcome for r in out.collect()} == {"https://e.com/": "changed", "https://e.com/dead": "deleted", "https://e.com/lost": "pending_deletion"}


def test_crawl_and_sync_again_and_again(spark, tmp_path):
    """Validators go out and come back; 304, changed, noise alone, 404 once and twice, and a crawl that finds a page gone."""
    text = lambda x: "<p>" + f"the page {x} has many words and they are fine " * 5 + "</p>"
    home = text("home") + "".join(f'<a href="/{k}">x</a>' for k in "abcd")
    web_ = {"https://e.com/": home} | {f"https://e.com/{k}": text(k) for k in "abcd"}
    asked: list = []

    def fetcher(pages):
        def get(requests):
            rows = requests.collect()
            asked.append({r.url: r.asDict() for r in rows})
            out = []
            for r in rows:
                tag = f"tag-{hash_text(pages.get(r.url, ''))}"
                code = 404 if r.url not in pages else 304 if r.asDict().get("etag") == tag else 200
                out.append((r.url, fetch.outcome(code), code, pages[r.url] if code == 200 else None, tag if code in (200, 304) else None, None, 5.0))
            return spark.createDataFrame(out, "url string, status string, status_code int, html string, etag string, last_modified string, latency_ms double")

        return get

    store = open_store(spark, {"root": str(tmp_path / "s")})
    at = lambda day: F.lit(datetime(2024, 1, day)).cast("timestamp")

    def crawl_(day, pages):
        done = job.crawl(spark, config.Crawl(seeds=("https://e.com/",)), fetcher(pages))
        stored = store.read("pages")
        p, v = job.versioned(done.documents, stored, "s", f"r{day}", at(day))
        lost_p, lost_v = job.tombstones(done.gone, stored, "s", f"r{day}", at(day))
        store.save("versions", v.unionByName(lost_v))
        store.save("pages", p.unionByName(lost_p))
        return done

    def sync_(day, pages):
        stored = store.find("pages", site_id="s")
        found = crawl.written(job.sync(job.noise_free(stored, store.read("versions")), fetcher(pages), config.Sync(), at(day)))
        p, v = job.merged(found, stored, "s", f"r{day}", at(day))
        p = crawl.written(p)
        store.save("versions", v)
        store.save("pages", p)
        return {r.url[-1]: r.outcome for r in found.collect()}

    done = crawl_(1, web_)
    assert job.finished(done.log, done.seconds)["avg_latency_ms"] == 5.0 and job.finished(done.log, 2.0)["pages_per_second"] == 2.5
    first = {r.url[-1]: r for r in store.read("pages").collect()}
    assert set(first) == set("/abcd") and first["a"].etag.startswith("tag-") and [r.outlinks for r in store.read("versions").where("url = 'https://e.com/'").collect()] == [[f"https://e.com/{k}" for k in "abcd"]]
    now = web_ | {"https://e.com/a": text("a new"), "https://e.com/b": text("b") + "<p>12:30</p>"}
    del now["https://e.com/c"]
    assert sync_(2, now) == {"/": "unchanged", "a": "changed", "b": "unchanged", "c": "pending_deletion", "d": "unchanged"}
    assert asked[-1]["https://e.com/a"]["etag"] == first["a"].etag
    assert sync_(3, now) == {"/": "unchanged", "a": "unchanged", "b": "unchanged", "c": "deleted", "d": "unchanged"}
    assert set(sync_(4, now)) == set("/abd")  # tombstones aren't asked for again
    rows = {r.url[-1]: r for r in store.read("pages").collect()}
    assert rows["c"].is_tombstone and rows["c"].status_code == 404 and rows["a"].version_count == 2 and rows["b"].version_count == 1 and rows["a"].etag != first["a"].etag
    assert store.read("versions").where("is_tombstone").count() == 1 and store.read("versions").count() == 7 and store.versions(rows["a"].page_id).count() == 2
    del now["https://e.com/d"]
    crawl_(5, now)
    assert store.count_pages("s") == 3 and store.get("pages", page_id=rows["d"].page_id)["is_tombstone"]


def test_store_parts(spark, tmp_path):
    """Upserts add parts, which are laid over one another and put together now and then; the last log but one stays readable."""
    import os

    store = open_store(spark, {"root": str(tmp_path / "s")})
    for n in range(20):
        before = store.read("runs") if n else None
        store.save("runs", [{"run_id": f"r{n % 3}", "site_id": "a", "status": str(n)}])
        assert before is None or before.count() == min(n, 3)
        assert len(store._log("runs")["parts"]) <= store.COMPACT
    assert {r.run_id: r.status for r in store.read("runs").collect()} == {"r0": "18", "r1": "19", "r2": "17"}
    assert len(os.listdir(tmp_path / "s" / "runs")) <= 2 * store.COMPACT + 1 and len([f for f in os.listdir(tmp_path / "s" / "runs" / "log") if f.isdigit()]) == 2
    stale_log = store._log("runs") | {"number": 1}
    with pytest.raises(Conflict):
        store._commit("runs", store.read("runs"), stale_log | {"number": store._log("runs")["number"] - 1}, True)
    store.save("runs", [{"run_id": "s"}], stream=("events", 4))
    assert store.batch("runs", "events") == 4 and store.batch("runs", "other") == -1


def test_breadth_first(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2), (2, 3)], "src int, dst int")
    got = crawl.breadth_first(spark.createDataFrame([(0,)], "node int"), edges, 5)
    assert {(r.node, r.depth) for r in got.collect()} == {(0, 0), (1, 1), (2, 1), (3, 2)}
    assert crawl.breadth_first(spark.createDataFrame([(0,)], "node int"), edges, 5, max_nodes=2).count() == 2


def test_history(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B", 1), (2, "C", 2), (3, "c", 1)], "k int, v string, n int")
    got = history.upsert(old, new, ["k"], ["-n"])
    assert {(r.k, r.v) for r in got.collect()} == {(1, "a"), (2, "C"), (3, "c")}


def test_markdown_blocks(spark):
    page = '<nav><a href="/x">x</a></nav><h2>Cats</h2><p>The <b>cat</b> sat &amp; slept on the mat</p><ul><li><a href="/a">only a link here in this one</a></li></ul><p>dog</p>'
    df = spark.createDataFrame([(1, page)], "page_id int, html string").withColumn("markdown", markdown.markdown(F.col("html")))
    assert df.first().markdown == "## Cats\n\nThe **cat** sat & slept on the mat\n\n- [only a link here in this one](/a)\n\ndog"
    parts = markdown.blocks(df, "page_id")
    assert [r.block for r in markdown.pruned(parts).orderBy("block").collect()] == [0, 1]
    assert markdown.joined(markdown.pruned(parts), "page_id").first().markdown == "## Cats\n\nThe **cat** sat & slept on the mat"
    scores = [r.score for r in markdown.bm25(parts, "page_id", "dog").orderBy("block").collect()]
    assert scores[:3] == [0, 0, 0] and scores[3] > 0
    assert spark.range(1).select(markdown.chosen(F.lit(" "), F.lit("b"))).first()[0] == "b"


def test_store_by_site(spark, tmp_path):
    store = open_store(spark, {"root": str(tmp_path / "s"), "by_site": True})
    store.save("pages", [{"page_id": "1", "site_id": "a", "is_tombstone": False}, {"page_id": "2", "site_id": "b", "is_tombstone": False}])
    store.save("pages", [{"page_id": "2", "site_id": "b", "is_tombstone": True}])
    assert store.count_pages("a") == 1 and store.count_pages("b") == 0 and store.read("pages").columns[0] == "page_id"


def test_single_page_file(spark, tmp_path):
    docs = spark.createDataFrame([("https://e.com/b", "B", "two", 1), ("https://e.com/", "A", "one", 0)], "url string, title string, markdown string, depth int")
    publish.write_single_page(docs, str(tmp_path / "all.md"))
    got = (tmp_path / "all.md").read_text()
    assert got.index("- [A](#a)") < got.index("  - [B](#b)") < got.index("## A") < got.index("## B")


def test_scheduler_stats(spark):
    r = metrics.scheduler(spark.createDataFrame([("d", True), ("e", False)], "domain string, active boolean"), spark.createDataFrame([("d", "open")], "domain string, state string")).first()
    assert tuple(r) == (1, 2, 1)
