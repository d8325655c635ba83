"""Publishing: JSON and Markdown of documents, navigation, link rewriting, as columns; files are written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import text as T
from quern.functions import urls
from quern.sources.crawl import written

SAFE = {"ignoreNullFields": "false"}


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row, nulls kept; written as text by the executors."""
    return rows.select(F.to_json(F.struct(*rows.columns), SAFE).alias("value"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.mode("overwrite").text(path)


def json_array(rows: DataFrame, *order: str) -> str:
    """All rows as one JSON array, streamed row by row to the driver; for exports that one file can hold."""
    return "[\n  " + ",\n  ".join(r[0] for r in json_lines(rows.orderBy(*order)).toLocalIterator()) + "\n]"


def page_title(url: Column) -> Column:
    """A title from the last path segment, its hyphens and underscores spaces; the host for the root."""
    last = F.regexp_extract(F.regexp_replace(urls.path(url), "/+$", ""), "([^/]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""), "[-_]+", " ")
    return F.when(bare == "", urls.host(url)).otherwise(T.title_case(bare))


def section(url: Column) -> Column:
    """The first path segment; '/' where there is one segment at most."""
    parts = F.filter(F.split(urls.path(url), "/"), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit("/"))


def breadcrumbs(url: Column) -> Column:
    """[Home](/) and a link for each path segment, the last one plain."""
    parts = F.filter(F.split(urls.path(url), "/"), lambda x: x != "")
    name = lambda x: T.title_case(F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]+$", ""), "[-_]+", " "))
    crumbs = F.transform(parts, lambda x, i: F.when(i == F.size(parts) - 1, name(x)).otherwise(F.concat(F.lit("["), name(x), F.lit("](/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/"), F.lit(")"))))
    return F.array_join(F.concat(F.array(F.lit("[Home](/)")), crumbs), " > ")


def neighbours(docs: DataFrame, *order: str, url: str = "url", within: str | None = None) -> DataFrame:
    """``docs`` with prev_url and next_url in that order, and prev_title and next_title if they have titles.

    Without ``within`` all rows are one sequence: they are written in ranges of the order, each of which is numbered and
    looked through by itself, and the ranges' ends, a row each, are joined to one another."""
    names = [c for c in (url, "title") if c in docs.columns]
    label = {url: "url", "title": "title"}
    if within:
        w = W.Window.partitionBy(within).orderBy(*order)
        return docs.withColumns({f"prev_{label[c]}": F.lag(c).over(w) for c in names} | {f"next_{label[c]}": F.lead(c).over(w) for c in names})
    ranged = written(docs.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    w = W.Window.partitionBy("__range").orderBy(*order)
    sides = F.struct(*[F.col(c) for c in names])
    each = ranged.withColumns({"__prev": F.lag(sides).over(w), "__next": F.lead(sides).over(w)})
    first, last = (each.where(f"{c} IS NULL").select("__range", sides.alias("end")) for c in ("__prev", "__next"))
    whole = W.Window.partitionBy().orderBy("__range")  # a row a range
    ends = first.withColumnRenamed("end", "a").join(last.withColumnRenamed("end", "z"), "__range").select("__range", F.lag("z").over(whole).alias("before"), F.lead("a").over(whole).alias("after"))
    out = each.join(ends, "__range").withColumns({"__prev": F.coalesce("__prev", "before"), "__next": F.coalesce("__next", "after")})
    return out.withColumns({f"{side}_{label[c]}": F.col(f"__{side}.{c}") for side in ("prev", "next") for c in names}).drop("__range", "__prev", "__next", "before", "after")


def index(docs: DataFrame) -> DataFrame:
    """(section, pages, lines): the index's entries of each section by URL."""
    line = F.concat(F.lit("- ["), F.coalesce("title", page_title(F.col("url"))), F.lit("]("), urls.output_path(F.col("url")), F.lit(")"))
    rows = docs.select(section(F.col("url")).alias("section"), F.struct("url", line.alias("line")).alias("x"))
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("pages"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("lines"))


def frontmatter(fields: dict[str, Column]) -> Column:
    """A YAML head; quotes and backslashes in values are escaped, null fields left out."""
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [F.concat(F.lit(f"{k}: "), quoted(v)) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def relative(source: Column, target: Column) -> Column:
    """The path from one output file to another."""
    a, b = F.split(source, "/"), F.split(target, "/")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)))
    common = F.least(same, F.size(a) - 1, F.size(b) - 1)
    return F.concat(F.repeat(F.lit("../"), F.size(a) - 1 - common), F.array_join(F.slice(b, common + 1, F.size(b)), "/"))


LINK = r"(\[[^\]]*\])\(([^)\s]+)\)"


def rewrite_links(docs: DataFrame, key: str = "doc_id", url: str = "url", content: str = "markdown") -> DataFrame:
    """``docs`` with links to other documents made relative paths of their files.

    Texts are cut at links, the links' targets joined to the documents' URLs without query and fragment, and the
    pieces put together again; other links, anchors and special schemes stay."""
    found = F.regexp_extract_all(content, F.lit(LINK), F.lit(0))
    target = lambda x: F.regexp_extract(x, LINK, 2)
    bare = lambda x: F.regexp_replace(F.regexp_extract(x, "^([^?#]*)", 1), "(?<=[^/])/+$", "")
    links = docs.select(F.col(key), F.col(url).alias("from"), F.posexplode(found).alias("at", "link"))
    links = links.withColumn("ref", target(F.col("link"))).where(~F.col("ref").rlike(r"(?i)^(javascript:|mailto:|tel:|data:|#)"))
    links = links.withColumn("to", bare(urls.resolve(F.col("from"), F.col("ref"))))
    known = docs.select(bare(F.col(url)).alias("to"), urls.output_path(F.col(url)).alias("file")).groupBy("to").agg(F.min("file").alias("file"))
    new = links.join(known, "to").select(key, "at", F.concat(F.regexp_extract("link", LINK, 1), F.lit("("), relative(urls.output_path(F.col("from")), F.col("file")), F.lit(")")).alias("new"))
    by_doc = new.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("new"))
    out = docs.join(by_doc, key, "left")
    pieces = F.split(content, LINK, -1)
    shown = F.transform(found, lambda x, i: F.coalesce(F.try_element_at(F.col("new"), i), x))
    whole = F.array_join(F.flatten(F.zip_with(pieces, shown, lambda p, x: F.array(p, F.coalesce(x, F.lit(""))))), "")
    return out.withColumn(content, F.when(F.col("new").isNotNull(), whole).otherwise(F.col(content))).drop("new")


def single_page(docs: DataFrame) -> DataFrame:
    """(depth, url, toc, body) in the order of one big page: contents entries and sections; tombstones aren't left out."""
    name = F.coalesce("title", page_title(F.col("url")))
    anchor = T.slug(name)
    toc = F.concat(F.repeat(F.lit(" "), 2 * F.least("depth", F.lit(3))), F.lit("- ["), name, F.lit("](#"), anchor, F.lit(")"))
    body = F.concat(F.lit("## "), name, F.lit("\n\n*Source: "), F.col("url"), F.lit("*\n\n"), F.coalesce("markdown", F.lit("")), F.lit("\n\n---\n"))
    return docs.select("depth", "url", toc.alias("toc"), body.alias("body")).orderBy("depth", "url")


def write_single_page(docs: DataFrame, path: str, title: str = "Contents", toc: bool = True) -> None:
    """One big Markdown file, streamed row by row; the contents come first."""
    import os

    rows = single_page(docs).persist()
    try:
        part = f"{path}.part"
        with open(part, "w", encoding="utf-8") as f:
            f.write(f"# {title}\n\n")
            if toc:
                f.writelines(r.toc + "\n" for r in rows.select("toc").toLocalIterator())
                f.write("\n---\n\n")
            f.writelines(r.body + "\n" for r in rows.select("body").toLocalIterator())
        os.replace(part, path)
    finally:
        rows.unpersist()


def navigation(docs: DataFrame) -> Column:
    """Links to the files before and after a document that has prev_url and next_url, with titles if it has prev_title and next_title; empty for none."""

    def link(side: str, label: str) -> Column:
        url = F.col(f"{side}_url")
        name = F.coalesce(F.col(f"{side}_title"), page_title(url)) if f"{side}_title" in docs.columns else page_title(url)
        return F.when(url.isNotNull(), F.concat(F.lit(f"**{label}:** ["), name, F.lit("]("), relative(urls.output_path(F.col("url")), urls.output_path(url)), F.lit(")")))

    if "prev_url" not in docs.columns:
        return F.lit("")
    both = F.concat_ws(" | ", link("prev", "Previous"), link("next", "Next"))
    return F.when(both != "", F.concat(F.lit("\n\n---\n"), both)).otherwise("")


def pages(docs: DataFrame, deletion: str = "tombstone") -> DataFrame:
    """(path, action, content) of every file: a page, a tombstone, a redirect or a removal.

    A page has its head, breadcrumbs, a line that names its source, its text, and links to its neighbours where ``docs`` has
    them; ``site`` puts rewritten links and neighbours there."""
    url = F.col("url")
    head = frontmatter({"title": F.coalesce("title", page_title(url)), "url": url})
    source = F.concat(F.lit("*Source: ["), url, F.lit("]("), url, F.lit(")*\n\n"))
    body = F.concat(head, F.lit("\n"), breadcrumbs(url), F.lit("\n\n"), source, F.coalesce("markdown", F.lit("")), navigation(docs), F.lit("\n"))
    gone = F.coalesce("is_tombstone", F.lit(False))
    stub = {"tombstone": F.concat(head, F.lit("\n# Page removed\n\nThis page is no longer there.\n")), "redirect": F.concat(head, F.lit("\nMoved to "), F.coalesce("redirect_url", F.lit("/")), F.lit("\n")), "remove": F.lit(None).cast("string")}[deletion]
    return docs.select(urls.output_path(url).alias("path"), F.when(gone, deletion).otherwise("write").alias("action"), F.when(gone, stub).otherwise(body).alias("content"))


def site(docs: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("depth", "url"), within: str | None = None, deletion: str = "tombstone") -> DataFrame:
    """The files of a whole site as ``pages`` has them, with links between documents relative and each live page's neighbours."""
    live = ~F.coalesce("is_tombstone", F.lit(False))
    linked = neighbours(docs.where(live).select(key, "url", "title", *{*order, *([within] if within else [])} - {"url", "title", key}), *order, within=within)
    linked = linked.select(F.col(key), "prev_url", "next_url", "prev_title", "next_title")
    return pages(rewrite_links(docs, key).join(linked, key, "left"), deletion)


def write_files(files: DataFrame, folder: str) -> None:
    """Each executor writes its files whole and renames them into place; a repeated task does no harm."""

    def write(rows):
        import os
        import uuid

        for r in rows:
            to = os.path.join(folder, r.path)
            if r.content is None:
                if os.path.exists(to):
                    os.remove(to)
                continue
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{uuid.uuid4().hex[:8]}"
            with open(part, "w", encoding="utf-8") as f:
                f.write(r.content)
            os.replace(part, to)

    files.select("path", "content").foreachPartition(write)
