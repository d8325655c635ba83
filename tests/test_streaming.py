from datetime import datetime, timedelta

from quern import cli
from quern.sources.store import open_store
from quern.streaming import breaker, ingest

T0 = datetime(2024, 1, 1)


def test_ingest(spark, tmp_path):
    store = open_store(spark, {"root": str(tmp_path / "store")})
    folder, events = str(tmp_path / "in"), str(tmp_path / "events")

    def feed(n, rows):
        spark.createDataFrame([(u, c, h, T0 + timedelta(hours=n)) for u, c, h in rows], ingest.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        ingest.start(ingest.results(spark, folder), store, "s", f"r{n}", events, str(tmp_path / "cp")).awaitTermination()

    feed(0, [("https://e.com/a", 200, "<p>one</p>"), ("https://e.com/b", 200, "<p>two</p>"), ("https://e.com/x", 500, None)])
    feed(1, [("https://e.com/a", 200, "<p>changed</p>"), ("https://e.com/b", 404, None)])
    got = sorted((r.url, r.event, r.run_id) for r in spark.read.parquet(events).collect())
    assert got == [("https://e.com/a", "changed", "r1"), ("https://e.com/a", "created", "r0"), ("https://e.com/b", "created", "r0"), ("https://e.com/b", "deleted", "r1")]
    assert store.read("versions").count() == 3 and store.count_pages("s") == 1 and store.count_pages("s", True) == 2


def test_a_batch_that_comes_again(spark, tmp_path, monkeypatch):
    """A batch that fails before or after its pages are saved, and is then replayed, leaves one and the same state."""
    store, events = open_store(spark, {"root": str(tmp_path / "store")}), str(tmp_path / "events")
    batch = lambda rows, h: spark.createDataFrame([(u, c, x, T0 + timedelta(hours=h)) for u, c, x in rows], ingest.SCHEMA)
    first = batch([("https://e.com/a", 200, "<p>one</p>"), ("https://e.com/b", 200, "<p>two</p>")], 0)
    second = batch([("https://e.com/a", 200, "<p>changed</p>"), ("https://e.com/b", 404, None)], 1)
    state = lambda: (sorted((r.url, r.event) for r in spark.read.parquet(events).where("batch = 1").collect()), store.read("versions").count(), store.count_pages("s"))
    ingest.apply(first, store, "s", "r", events, 0)
    save = store.save

    def failing(table, *rest, **more):
        if table == "pages":
            raise OSError("lost")
        save(table, *rest, **more)

    monkeypatch.setattr(store, "save", failing)
    try:
        ingest.apply(second, store, "s", "r", events, 1)
    except OSError:
        pass
    monkeypatch.setattr(store, "save", save)
    ingest.apply(second, store, "s", "r", events, 1)  # again, as nothing said that it was done
    want = ([("https://e.com/a", "changed"), ("https://e.com/b", "deleted")], 3, 1)
    assert state() == want
    ingest.apply(second, store, "s", "r", events, 1)  # and again, after the pages but before the stream's own note
    assert state() == want


def test_breaker(spark, tmp_path):
    rows = [("d", T0 + timedelta(seconds=s), ok) for s, ok in ((0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (70, True))]
    spark.createDataFrame(rows, "domain string, ts timestamp, success boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("domain string, ts timestamp, success boolean").parquet(str(tmp_path / "in"))
    q = breaker.circuit(stream, threshold=3).writeStream.format("memory").queryName("breaker").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.failures_in_a_row, r.state) for r in spark.sql("SELECT * FROM breaker ORDER BY ts").collect()]
    assert got == [(1, "closed"), (2, "closed"), (0, "closed"), (1, "closed"), (2, "closed"), (3, "open"), (0, "closed")]


def store_site(spark, tmp_path):
    return open_store(spark, {"root": str(tmp_path / "s")}).sites().first().site_id


def test_cli(spark, tmp_path, capsys):
    pages = str(tmp_path / "pages")
    spark.createDataFrame([("https://e.com/", "<p>" + "many words are here and there " * 9 + "</p>")], "url string, html string").write.parquet(pages)
    args = ["--store", str(tmp_path / "s"), "--config", str(tmp_path / "c.json")]
    assert cli.main([*args, "crawl", "https://e.com/", "--pages", pages, "--output", str(tmp_path / "out")], spark) == 0
    assert cli.main([*args, "sites"], spark) == 0 and cli.main([*args, "list", "--status", "completed"], spark) == 0
    site = store_site(spark, tmp_path)
    assert cli.main([*args, "sync", site, "--pages", pages], spark) == 0
    assert cli.main([*args, "config", "set", "max_depth", "3"], spark) == 0 and cli.main([*args, "config", "show"], spark) == 0
    out = capsys.readouterr().out
    assert "https://e.com/" in out and "completed" in out and "max_depth" in out and "pending_deletion" in out
    assert spark.read.text(str(tmp_path / "out")).count() == 1
