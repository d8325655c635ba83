"""Chunkers: heading sections as native expressions with a fold, tokens by packing in Arrow calls."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEADING = re.compile(r"^(#{1,6})\s+(.+?)$", re.M)
CHUNK = "struct<chunk_index:int,total_chunks:int,heading:string,level:int,section_path:string,content:string,start:int,end:int,overlap_tokens:int,estimated_tokens:int>"
#: A worker passes chunks on once they come to so many characters, with some more for each row: beside the Arrow batch it holds no more than that and one document.
HELD, ROW = 1 << 20, 256


def _pieces(text: str, most: int, sentences: bool) -> Iterator[tuple[int, str]]:
    """Cuts at the last blank line of each window, else after its last sentence, else hard."""
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            cut = text.rfind("\n\n", at, end)
            if cut <= at and sentences:
                cut = text.rfind(". ", at, end) + 1
            end = cut if cut > at else end
        if part := text[at:end].strip():
            yield at, part
        at = end


def by_heading(text: str, title: str | None = None, least: int = 100, most: int = 2000, levels: Iterable[int] = (1, 2, 3), with_heading: bool = True) -> list[tuple]:
    """(heading, level, path, content, start, end) of each chunk; sections end at any heading, those of other levels are left out."""
    levels, found = set(levels), list(_HEADING.finditer(text))
    out, stack = [], []
    sections = [(m, found[i + 1].start() if i + 1 < len(found) else len(text)) for i, m in enumerate(found) if len(m[1]) in levels]
    if not sections:
        return [(title, None, title or "", p, a, a + len(p)) for a, p in _pieces(text, most, False)]
    for m, end in sections:
        level, heading = len(m[1]), m[2].strip()
        del stack[level - 1 :]
        stack.append(heading)
        body = text[m.end() : end].strip()
        content = f"{'#' * level} {heading}\n\n{body}" if with_heading else body
        path = " > ".join(stack)
        if len(content) > most:
            out += [(heading, level, path, p, m.start() + a, m.start() + a + len(p)) for a, p in _pieces(content, most, True)]
        elif len(content) >= least:
            out.append((heading, level, path, content, m.start(), end))
    return out


def _split(text: str, separators: list[str], fits: Callable[[str], bool]) -> list[str]:
    if fits(text) or not separators:
        return [text]
    parts = text.split(separators[0])
    kept = [p + (separators[0] if i < len(parts) - 1 else "") for i, p in enumerate(parts) if p]
    return [y for x in kept for y in _split(x, separators[1:], fits)]


def by_tokens(text: str, size: int = 512, overlap: int = 50, separators: Iterable[str] = ("\n\n", "\n", ". ", " "), count: Callable[[str], int] = lambda s: len(s) // 4) -> list[str]:
    """Greedy packing of the pieces into chunks of ``size`` tokens; each after the first begins with the last of the one before."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    if count(text) <= size:
        return [text] if text.strip() else []
    out: list[str] = []
    held, n = "", 0
    for piece in _split(text, list(separators), lambda s: count(s) <= size):
        k = count(piece)
        if k > size:  # no separator helps: windows that overlap and always go on
            if held.strip():
                out.append(held)
            step, width = max(1, 4 * (size - overlap)), 4 * size
            at = 0
            while True:
                out.append(piece[at : at + width])
                if at + width >= len(piece):
                    break
                at += step
            held, n = "", 0
            continue
        if n + k > size and held:
            out.append(held)
            held = held[-4 * overlap :] if overlap else ""
            n = count(held)
        held, n = held + piece, n + k
    if held.strip():
        out.append(held)
    return out


def _rows(chunks: list[tuple]) -> list[dict]:
    names = ("heading", "level", "section_path", "content", "start", "end", "overlap_tokens")
    return [dict(zip(names, c), chunk_index=i, total_chunks=len(chunks), estimated_tokens=len(c[3]) // 4) for i, c in enumerate(chunks)]


def counter(path: str, pattern: str = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""") -> Callable[[str], int]:
    """Counts tokens of a byte-pair encoding, whose rank file (base64 piece and rank a line) is at ``path`` on every worker; for ``count`` of by_tokens."""

    def count(text: str) -> int:
        return len(_encoding(path, pattern).encode_ordinary(text))

    return count


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_documents(chunks: DataFrame, docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """``chunks`` with these columns of their documents; chunks without one keep nulls."""
    return chunks.join(docs.select(key, *columns), key, "left")


def _placed(text: str, parts: list[str], overlap: int) -> list[tuple]:
    out, at = [], 0
    for i, p in enumerate(parts):
        a = text.find(p[:50], at)
        a = at if a < 0 else a
        out.append((None, None, "", p, a, a + len(p), overlap if i else 0))
        at = max(0, a + len(p) - 4 * overlap)
    return out


def _exploded(docs: DataFrame, key: str, text: str, fn: Callable[[str, str | None], list[dict]], title: str | None) -> DataFrame:
    given = docs.select(F.col(key), F.col(text).alias("_text"), (F.col(title) if title else F.lit(None).cast("string")).alias("_title"))
    name = given.columns[0]

    def chunks(batches):
        import pyarrow as pa

        kind = pa.struct([("chunk_index", pa.int32()), ("total_chunks", pa.int32()), ("heading", pa.string()), ("level", pa.int32()), ("section_path", pa.string()), ("content", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("overlap_tokens", pa.int32()), ("estimated_tokens", pa.int32())])

        def part(keys, at, rows):
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(rows, kind)], [name, "c"])

        for batch in batches:
            keys, texts, titles = batch.columns
            at, rows, held = [], [], 0
            for i in range(len(texts)):  # a text at a time: lists of a whole batch's texts and chunks take several times the batch
                x = texts[i].as_py()
                for row in fn(x, titles[i].as_py()) if x else []:
                    at.append(i)
                    rows.append(row)
                    held += ROW + len(row["content"]) + len(row["section_path"])
                    if held >= HELD:
                        yield part(keys, at, rows)
                        at, rows, held = [], [], 0
            if rows:
                yield part(keys, at, rows)
            del batch, keys, texts, titles  # before the next one is read

    made = given.mapInArrow(chunks, T.StructType([given.schema[0], T.StructField("c", T.DataType.fromDDL(CHUNK))]))
    ends = {"is_first": F.col("c.chunk_index") == 0, "is_last": F.col("c.chunk_index") == F.col("c.total_chunks") - 1}
    return made.select(key, F.format_string("%s_chunk_%04d", F.col(key).cast("string"), F.col("c.chunk_index")).alias("chunk_id"), "c.*", *[v.alias(k) for k, v in ends.items()])


def heading_chunks(docs: DataFrame, key: str, text: str = "markdown", title: str | None = None, **options) -> DataFrame:
    """One row a chunk of each document, split at headings."""
    return _exploded(docs, key, text, lambda x, t: _rows([(*c, 0) for c in by_heading(x, t, **options)]), title)


def token_chunks(docs: DataFrame, key: str, text: str = "markdown", size: int = 512, overlap: int = 50, **options) -> DataFrame:
    """One row a chunk of each document, packed to a number of tokens."""
    return _exploded(docs, key, text, lambda x, t: _rows(_placed(x, by_tokens(x, size, overlap, **options), overlap)), None)


def sections(docs: DataFrame, key: str, text: Column, levels: Iterable[int] = (1, 2, 3)) -> DataFrame:
    """(key, section, level, heading, path, body) of each section at those levels, natively: split before headings and a fold for the path."""
    parts = F.filter(F.split(text, r"(?md)(?=^#{1,6}\s)"), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    rows = F.filter(
        F.transform(parts, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#{1,6})", 1)).alias("level"), F.btrim(F.regexp_extract(x, r"(?d)^#{1,6}\s+(.+)", 1)).alias("heading"), F.regexp_replace(F.regexp_replace(x, r"(?d)^#{1,6}\s+.+", ""), r"^\s+|\s+$", "").alias("body"))),
        lambda s: s["level"].isin(*levels),
    )
    folded = F.aggregate(
        rows, F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<level:int,heading:string,body:string,path:string>>").alias("out")),
        lambda acc, s: F.struct(
            F.concat(F.slice(acc["stack"], F.lit(1), F.least(F.size(acc["stack"]), s["level"] - 1)), F.array(s["heading"])).alias("stack"),
            F.concat(acc["out"], F.array(F.struct(s["level"].alias("level"), s["heading"].alias("heading"), s["body"].alias("body"), F.array_join(F.concat(F.slice(acc["stack"], F.lit(1), F.least(F.size(acc["stack"]), s["level"] - 1)), F.array(s["heading"])), " > ").alias("path")))).alias("out"),
        ),
    )["out"]
    return docs.select(key, F.posexplode(folded).alias("section", "s")).select(key, "section", "s.*")
