import pytest
from pyspark.sql import functions as F

from quern.functions import hashing, patterns, text, urls


def one(spark, column_of, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.select("i", column_of(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_normalize(spark):
    cases = {
        "HTTPS://EXAMPLE.COM/Page": "https://example.com/Page", "https://example.com:443/a": "https://example.com/a", "http://example.com:80/a": "http://example.com/a",
        "http://example.com:8080/a": "http://example.com:8080/a", "https://example.com/page/": "https://example.com/page", "https://example.com/": "https://example.com/",
        "https://example.com": "https://example.com/", "https://example.com/p#section": "https://example.com/p", "https://example.com/p?z=1&a=2&m=3": "https://example.com/p?a=2&m=3&z=1",
        "https://example.com/p?utm_source=x&id=1": "https://example.com/p?id=1", "not-a-url": "not-a-url", "https://example.com//a//b": "https://example.com/a/b",
        "https://e.com/p?q=a%20b&q=A": "https://e.com/p?q=A&q=a+b", "https://e.com/%7Eme": "https://e.com/~me", "https://e.com/p?x=": "https://e.com/p?x=",
    }
    assert dict(zip(cases, one(spark, urls.normalize, *cases))) == cases
    assert one(spark, lambda c: urls.normalize(c, drop=["sid"], strip_www=True, keep_fragment=True), "https://www.e.com/?sid=4&b=1#x") == ["https://e.com/?b=1#x"]
    assert one(spark, urls.normalize, None) == [None]


def test_domains_and_extensions(spark):
    assert one(spark, urls.host, "https://Sub.example.com:81/p") == ["sub.example.com"]
    assert one(spark, urls.registered_domain, "https://a.b.example.com/p", "https://x.example.co.uk", "http://localhost/") == ["example.com", "example.co.uk", "localhost"]
    assert one(spark, urls.extension, "https://e.com/a.PDF", "https://e.com/a", "https://e.com/a.b/c", "https://e.com/x.averyveryverylong") == [".pdf", "", "", ""]


def test_output_paths(spark):
    cases = {"https://e.com/": "index.md", "https://e.com/about": "about/index.md", "https://e.com/file.html": "file/index.md", "https://e.com/file.txt": "file.txt.md"}
    assert one(spark, urls.output_path, *cases) == list(cases.values())


@pytest.mark.parametrize("base", ["http://e.com/a/b/c?x=1", "https://e.com/", "http://e.com/a/b/"])
def test_resolve_is_urljoin(spark, base):
    from urllib.parse import urljoin

    refs = ["d", "/d", "../d", "./d", "?y=2", "//o.com/p", "http://o.com/q", "../../d/./e?z#f", "#g", "d/", "..", "."]
    got = one(spark, lambda c: urls.resolve(F.lit(base), c), *refs)
    assert got == [urljoin(base, r) for r in refs]


def test_patterns(spark):
    assert patterns.is_glob("/docs/*") and patterns.is_glob("/docs/.*") and not patterns.is_glob("/api/v(1|2)/.*") and patterns.is_glob("*(x)")
    hit = lambda p, u: one(spark, lambda c: patterns.matches_any(c, [p]), u)[0]
    assert hit("/docs/*", "https://e.com/docs/guide") and not hit("/docs/.*", "https://e.com/docs/guide")
    assert hit("/api/v(1|2)/.*", "https://e.com/api/v2/x") and hit("regex:/docs/.*", "https://e.com/docs/guide") and hit("*.PDF", "https://e.com/a.pdf")
    assert hit("[invalid", "https://e.com/[invalid") and not hit("[invalid", "https://e.com/invalid")
    rule = lambda u: one(spark, lambda c: patterns.included(c, ["/docs/*"], ["*private*"]), u)[0]
    assert rule("https://e.com/docs/a") and not rule("https://e.com/docs/private") and not rule("https://e.com/x")


def test_hashes(spark):
    values = ["", "a", "hello world", "é" * 40, "x" * 1000]
    assert one(spark, hashing.xxh64, *values) == [hashing.hash_text(v) for v in values]
    assert one(spark, hashing.content_hash, " a \n b ", "a b")[0] == hashing.hash_text("a b")
    assert hashing.site_id(["b", "a"]) == hashing.site_id(["a", "b"]) and len(hashing.site_id(["a"])) == 12
    row = spark.range(1).select(hashing.version_id(F.lit("abcdef1234567890"), F.lit("2024-01-01 12:00:00").cast("timestamp")), hashing.chunk_id(F.lit("d"), F.lit(3))).first()
    assert tuple(row) == ("v_abcdef123456_20240101120000", "d_chunk_0003")


def test_texts(spark):
    assert one(spark, text.plain, "# Hi\n\n**b** and [l](u) `c`\n\n\n\n- x\n1. y") == ["Hi\n\nb and l \nx\ny"]
    assert one(spark, text.word_count, "", " a  b\nc ", None) == [0, 3, None]
    assert one(spark, text.redact, "m a.b@c.org 555-123-4567 123-45-6789 4111 1111 1111 1111") == ["m [EMAIL REDACTED] [PHONE REDACTED] [SSN REDACTED] [CARD REDACTED]"]
    assert one(spark, text.title_case, "o'neil 3d map") == ["O'Neil 3D Map"]
    assert one(spark, text.language_hint, "There it goes", "Guten Tag") == ["en", None]
