"""Queries over extracted texts: gates, duplicates, redaction, changes between snapshots, chunks, export."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import hashing, html, text
from quern.operators import changes, chunking, gate, publish


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def quality_gate(spark, sf_dir):
    return gate.gated(docs(spark, sf_dir), "doc_id", None, "text", languages=["en"], keep=[])


def duplicate_first_wins(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.md5(hashing.squeezed(F.col("text"))).alias("content"))
    return d.withColumn("first_id", F.min("doc_id").over(W.Window.partitionBy("content"))).where("doc_id <> first_id").select("doc_id", "first_id")


def content_hash_groups(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", hashing.content_hash(F.col("text")).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first_id", "n")


def language_heuristic(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.language_hint(F.col("text")).alias("hint"))


def word_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).alias("words"), F.length("text").cast("long").alias("chars"), text.estimated_tokens(F.col("text")).alias("tokens"))


def source_summary(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def pii_redact(spark, sf_dir):
    r = text.redact(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(r).alias("text_md5"), (r != F.col("text")).alias("redacted"))


def markdown():
    return F.concat(F.lit("# Talk\n\n**"), F.col("role"), F.lit("** said `x` in [a link](http://e.com/"), F.col("turn"), F.lit(") and ![a picture](p.png):\n\n- item _one_\n1. item __two__\n\n\n\n---\n"), F.coalesce("text", F.lit("")))


def markdown_plain_text(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("markdown", markdown())
    return c.select("conv_id", "turn", F.md5(text.plain(F.col("markdown"))).alias("plain_md5"))


def entity_decode(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(html.clean(F.regexp_replace("html", "<[^>]+>", " "))).alias("clean_md5"))


def _snapshots(spark, sf_dir):
    """Two crawls of the documents: in the second every seventh text has changed, every eleventh document is gone, and some are new."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    new = d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text"), F.lit(" updated"))).otherwise(F.col("text")))
    return d, new.unionByName(d.where("doc_id % 50 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text"))


def change_events(spark, sf_dir):
    return changes.events(*_snapshots(spark, sf_dir), "doc_id", "text")


def change_summary(spark, sf_dir):
    return change_events(spark, sf_dir).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def noise_hash_change(spark, sf_dir):
    """Texts that gain a time, a counter and a session id haven't changed once noise is left out; others have."""
    d = docs(spark, sf_dir)
    noisy = F.concat(F.col("text"), F.lit(" 12:34 pm 1,204 views session_id=ab12"), F.when(F.col("doc_id") % 5 == 0, F.lit(" truly new")).otherwise(F.lit("")))
    return d.select("doc_id", changes.has_changed(changes.noise_hash(F.col("text")), changes.noise_hash(noisy)).alias("changed"))


def header_responses(spark, sf_dir):
    status = F.expr("CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 200 WHEN 1 THEN 304 WHEN 2 THEN 404 WHEN 3 THEN 410 WHEN 4 THEN 500 ELSE 206 END")
    return docs(spark, sf_dir).select("doc_id", changes.response(status).alias("outcome"), changes.deletion(status, (F.col("doc_id") % 3).cast("int")).alias("deletion"))


def diff_ratio(spark, sf_dir):
    """How like each changed text is to the one before it."""
    old, new = _snapshots(spark, sf_dir)
    pairs = old.withColumnRenamed("text", "old_text").join(new.withColumnRenamed("text", "new_text"), "doc_id").where("old_text <> new_text")
    return changes.diff_ratio(pairs, "old_text", "new_text").select("doc_id", "ratio", "significant")


def _talks(spark, sf_dir):
    """A Markdown document of each conversation: a heading a turn."""
    c = read(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts")).select("conv_id", F.concat(F.lit("# Talk\n\n"), F.array_join("parts.part", "\n\n")).alias("markdown"))


def heading_sections(spark, sf_dir):
    s = chunking.sections(_talks(spark, sf_dir), "conv_id", F.col("markdown"))
    return s.select("conv_id", "heading", "path", F.md5("body").alias("body_md5"))


def chunk_heading(spark, sf_dir):
    c = chunking.heading_chunks(_talks(spark, sf_dir), "conv_id", least=1, most=1_000_000)
    return c.select("conv_id", "heading", "section_path", F.md5("content").alias("content_md5"))


def chunk_heading_split(spark, sf_dir):
    return chunking.heading_chunks(_talks(spark, sf_dir), "conv_id").select("conv_id", "chunk_id", "level", "section_path", "content", "is_first", "is_last")


def chunk_documents(spark, sf_dir):
    """Every chunk with what is known of its conversation."""
    whole = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"))
    chunks = chunking.heading_chunks(_talks(spark, sf_dir), "conv_id").select("conv_id", "chunk_id")
    return chunking.with_documents(chunks, whole, "conv_id", "turns", "last_turn").select("conv_id", "chunk_id", "turns", "last_turn")


def chunk_token(spark, sf_dir):
    return chunking.token_chunks(docs(spark, sf_dir), "doc_id", "text").select("doc_id", "chunk_id", "content", "total_chunks", "overlap_tokens", "estimated_tokens")


def chunk_window(spark, sf_dir):
    """Chunk index and total of every turn in its conversation."""
    c = read(spark, sf_dir, "conversations")
    w = W.Window.partitionBy("conv_id")
    i = F.row_number().over(w.orderBy("turn", "role", "text")) - 1
    n = F.count(F.lit(1)).over(w)
    return c.select("conv_id", "turn", i.alias("chunk_index"), n.alias("total_chunks"), (i == 0).alias("is_first"), (i == n - 1).alias("is_last"))


def export_jsonl(spark, sf_dir):
    return publish.json_lines(docs(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"))


QUERIES = {f.__name__: f for f in (quality_gate, duplicate_first_wins, content_hash_groups, language_heuristic, word_counts, source_summary, pii_redact, markdown_plain_text, entity_decode, change_events, change_summary, noise_hash_change, header_responses, diff_ratio, heading_sections, chunk_heading, chunk_heading_split, chunk_documents, chunk_token, chunk_window, export_jsonl)}

WORDS = r"(CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END)"
SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
HINT = "CASE WHEN regexp_matches(lower(substr(text, 1, 1000)), 'the|and|is|are|was|were|have|has') THEN 'en' END"
#: Written apart from the expressions' constants, so that a wrong pattern on one side shows.
REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL REDACTED]', 'g'),
    '\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b', '[PHONE REDACTED]', 'g'), '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '[SSN REDACTED]', 'g'), '\b[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}\b', '[CARD REDACTED]', 'g')"""
MD = "'# Talk' || chr(10) || chr(10) || '**' || role || '** said `x` in [a link](http://e.com/' || turn || ') and ![a picture](p.png):' || chr(10) || chr(10) || '- item _one_' || chr(10) || '1. item __two__' || chr(10) || chr(10) || chr(10) || chr(10) || '---' || chr(10) || coalesce(text, '')"
PLAIN = "markdown"
for _pattern, _to in (
    (r"```(?:.|\n)*?```", ""), ("`[^`]+`", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"(?m)^[#]{1,6}[ \t\n\f\r]+", ""), (r"[*][*]([^*]+)[*][*]", r"\1"), (r"[*]([^*]+)[*]", r"\1"),
    ("__([^_]+)__", r"\1"), ("_([^_]+)_", r"\1"), (r"(?m)^[-*_]{3,}$", ""), (r"(?m)^[ \t\n\f\r]*[-*+][ \t\n\f\r]+", ""), (r"(?m)^[ \t\n\f\r]*[0-9]+[.][ \t\n\f\r]+", ""), (r"\n\n\n+", "\n\n"), (" +", " "),
):
    PLAIN = f"regexp_replace({PLAIN}, '{_pattern}', '{_to}', 'g')"
BARE = "text"
for _pattern in (r"(?i)\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[ap]m)?\b", r"(?i)\b[0-9]+ (?:second|minute|hour|day|week|month|year)s? ago\b", r"(?i)\b[0-9,]+ (?:view|comment|like|share)s?\b", r"(?i)\bsession[_-]?id=[0-9A-Za-z_]+"):
    BARE = f"regexp_replace({BARE}, '{_pattern}', '', 'g')"
BARE = rf"trim(regexp_replace({BARE}, '\s+', ' ', 'g'))"
# sections of over 2000 characters are cut at the last blank line of each window, else behind its last sentence, else hard
PIECES = r"""
    WITH RECURSIVE sections AS (
        SELECT conv_id, turn, 'Talk > ' || role || ' ' || turn AS path, '## ' || role || ' ' || turn || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS content FROM conversations),
    cuts AS (
        SELECT conv_id, turn, path, content, 0 AS a, CASE WHEN length(content) <= 2000 THEN length(content) ELSE coalesce(nullif(length(regexp_extract(substr(content, 1, 2000), '(?s)^(.*)\n\n', 1)), 0), nullif(length(regexp_extract(substr(content, 1, 2000), '(?s)^(.*[.]) ', 1)), 0), 2000) END AS z FROM sections
        UNION ALL
        SELECT conv_id, turn, path, content, z, z + CASE WHEN length(content) - z <= 2000 THEN length(content) - z ELSE coalesce(nullif(length(regexp_extract(substr(content, z + 1, 2000), '(?s)^(.*)\n\n', 1)), 0), nullif(length(regexp_extract(substr(content, z + 1, 2000), '(?s)^(.*[.]) ', 1)), 0), 2000) END
        FROM cuts WHERE z < length(content)),
    chunks AS (
        SELECT conv_id, turn, path, a, CASE WHEN length(content) > 2000 THEN regexp_replace(substr(content, a + 1, z - a), '^\s+|\s+$', '', 'g') ELSE content END AS content FROM cuts WHERE length(content) >= 100),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, a) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM chunks WHERE content <> '')
    SELECT conv_id, printf('%d_chunk_%04d', conv_id, k) AS chunk_id, CAST(2 AS INTEGER) AS level, path AS section_path, content, k = 0 AS is_first, k = n - 1 AS is_last FROM numbered"""
CLEAN = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for entity, char in html.ENTITIES:
    CLEAN = f"replace({CLEAN}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
EVENTS = """
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.doc_id IS NULL THEN 'created' WHEN o.text IS DISTINCT FROM n.text THEN 'changed' ELSE 'unchanged' END AS event
    FROM documents o FULL JOIN (
        SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' updated' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0
        UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 50 = 0) n ON o.doc_id = n.doc_id"""

SQL = {
    "quality_gate": f"""
        WITH own AS (SELECT doc_id, text, CASE WHEN length(text) < 100 THEN 'too_short' WHEN {WORDS} < 10 THEN 'low_word_count' END AS own, {SQUEEZED} AS content FROM documents),
        c AS (SELECT *, CASE WHEN own IS NULL THEN min(CASE WHEN own IS NULL THEN doc_id END) OVER (PARTITION BY content) END AS first_id FROM own)
        SELECT doc_id, coalesce(own, CASE WHEN first_id <> doc_id THEN 'duplicate_content' WHEN coalesce({HINT}, 'en') <> 'en' THEN 'wrong_language' ELSE 'passed' END) AS reason, CASE WHEN first_id <> doc_id THEN first_id END AS duplicate_of FROM c""",
    "duplicate_first_wins": f"SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {SQUEEZED}) AS first_id FROM documents) WHERE doc_id <> first_id",
    "content_hash_groups": f"SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY {SQUEEZED} HAVING count(*) > 1",
    "language_heuristic": f"SELECT doc_id, {HINT} AS hint FROM documents",
    "word_counts": f"SELECT doc_id, CAST({WORDS} AS BIGINT) AS words, length(text) AS chars, length(text) // 4 AS tokens FROM documents",
    "source_summary": "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY source, lang",
    "pii_redact": f"SELECT doc_id, md5({REDACTED}) AS text_md5, {REDACTED} <> text AS redacted FROM documents",
    "markdown_plain_text": f"SELECT conv_id, turn, md5(regexp_replace({PLAIN}, '^\\s+|\\s+$', '', 'g')) AS plain_md5 FROM (SELECT *, {MD} AS markdown FROM conversations)",
    "entity_decode": f"SELECT page_id, md5(trim(regexp_replace({CLEAN}, '\\s+', ' ', 'g'))) AS clean_md5 FROM pages",
    "change_events": EVENTS,
    "change_summary": f"SELECT event, count(*) AS n FROM ({EVENTS}) GROUP BY event",
    "noise_hash_change": f"""
        WITH noisy AS (SELECT doc_id, text || ' 12:34 pm 1,204 views session_id=ab12' || CASE WHEN doc_id % 5 = 0 THEN ' truly new' ELSE '' END AS text FROM documents)
        SELECT doc_id, o.bare IS DISTINCT FROM n.bare AS changed FROM (SELECT doc_id, {BARE} AS bare FROM documents) o JOIN (SELECT doc_id, {BARE} AS bare FROM noisy) n USING (doc_id)""",
    "chunk_heading_split": PIECES,
    "chunk_documents": f"SELECT c.conv_id, c.chunk_id, t.turns, t.last_turn FROM ({PIECES}) c LEFT JOIN (SELECT conv_id, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id) t ON t.conv_id = c.conv_id",
    "header_responses": """
        WITH s AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 304 WHEN 2 THEN 404 WHEN 3 THEN 410 WHEN 4 THEN 500 ELSE 206 END AS status FROM documents)
        SELECT doc_id, CASE WHEN status = 304 THEN 'unchanged' WHEN status IN (404, 410) THEN 'deleted' WHEN status BETWEEN 200 AND 299 THEN 'changed' ELSE 'failed' END AS outcome,
               CASE WHEN status IN (404, 410) THEN CASE WHEN doc_id % 3 + 1 >= 2 THEN 'deleted' ELSE 'pending_deletion' END END AS deletion FROM s""",
    "heading_sections": r"SELECT conv_id, role || ' ' || turn AS heading, 'Talk > ' || role || ' ' || turn AS path, md5(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS body_md5 FROM conversations UNION ALL SELECT DISTINCT conv_id, 'Talk', 'Talk', md5('') FROM conversations",
    "chunk_heading": r"SELECT conv_id, role || ' ' || turn AS heading, 'Talk > ' || role || ' ' || turn AS section_path, md5('## ' || role || ' ' || turn || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS content_md5 FROM conversations UNION ALL SELECT DISTINCT conv_id, 'Talk', 'Talk', md5('# Talk' || chr(10) || chr(10)) FROM conversations",
    "export_jsonl": "SELECT CAST(to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS VARCHAR) AS value FROM documents",
    "chunk_window": "SELECT conv_id, turn, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS total_chunks, row_number() OVER w = 1 AS is_first, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
}
