"""Line dedup: a sharded minimal perfect hash over distinct lines, probed by the documents."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, let, load_array, once, posix, save_array, shared_folder, slim, table

#: Distinct lines that one shard holds, about.
SHARD_LINES = 500_000
GAMMA, LEVELS = 2.0, 48
NO_ID = (1 << 63) - 1


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; one hash function a seed."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """n distinct 64-bit keys to 0..n-1: on each level the keys that are alone in their bit take it, the others go on."""

    def __init__(self, bits: np.ndarray, ranks: np.ndarray, levels: np.ndarray, rest: np.ndarray):
        self.bits, self.ranks, self.levels, self.rest = bits, ranks, levels, rest
        self.placed = int(levels[-1, 2]) if len(levels) else 0

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, ranks, levels, left, start, rank = [], [], [], keys, 0, 0
        for level in range(LEVELS):
            if not len(left):
                break
            words = max(1, int(np.ceil(GAMMA * len(left) / 64)))
            at = (mix(left, level) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            word = np.packbits(alone.reshape(words, 64), axis=1, bitorder="little").view("<u8").ravel()
            each = alone.reshape(words, 64).sum(axis=1)
            bits.append(word)
            ranks.append(rank + np.cumsum(each) - each)
            rank += int(each.sum())
            levels.append((start, words, rank))
            start += words
            left = left[~alone[at]]
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return cls(join(bits, np.uint64), join(ranks, np.uint32), np.array(levels, np.int64).reshape(-1, 3), np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1, or some key's number, for others."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (start, words, _) in enumerate(self.levels.tolist()):
            if not len(left):
                break
            at = (mix(keys[left], level) % np.uint64(words * 64)).astype(np.int64)
            word, bit = self.bits[start + (at >> 6)], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) != 0
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[start + (at[hit] >> 6)] + np.bitwise_count(below)
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            out[left] = np.where(self.rest[at] == keys[left], self.placed + at, -1)
        return out


#: ``apart``: the lines whose hash another line of the shard has, as rows of hash, fingerprint, count and owner.
PARTS = ("bits", "ranks", "levels", "rest", "fingerprints", "counts", "apart", "owners")


class Index:
    """The shards in a folder, each mapped when first probed."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.shards = folder, bits, {}

    def shard(self, n: int):
        if n not in self.shards:
            if not os.path.exists(f"{self.folder}/{n}.owners.npy"):
                self.shards[n] = None
            else:
                parts = {p: load_array(f"{self.folder}/{n}.{p}.npy") for p in PARTS}
                self.shards[n] = PerfectHash(*(parts[p] for p in PARTS[:4])), *(parts[p] for p in PARTS[4:])
        return self.shards[n]

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each line occurs, 0 if it isn't indexed, and the least doc_id that has it."""
        counts, owners = np.zeros(len(keys), np.int64), np.full(len(keys), NO_ID, np.int64)
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        order = np.argsort(shard, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0])) if len(keys) else []
        for at in np.split(order, starts[1:]) if len(keys) else []:
            if (got := self.shard(int(shard[at[0]]))) is None:
                continue
            which, known, count, apart, owner = got
            k = which.index(keys[at])
            sure = k >= 0
            sure[sure] = known[k[sure]] == prints[at[sure]]
            counts[at[sure]], owners[at[sure]] = count[k[sure]], owner[k[sure]]
            for hash_, print_, n, first in apart.tolist():
                same = at[(keys[at].view(np.int64) == hash_) & (prints[at] == print_)]
                counts[same], owners[same] = n, first
        return counts, owners


def trimmed(line: Column) -> Column:
    """Without the spaces, tabs and carriage returns around it."""
    return F.trim(line, F.lit(" \t\r"))


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def line_hashes(text: Column) -> Column:
    """Hash and fingerprint, which come from different functions, of the trimmed lines; null for a blank line."""
    return F.transform(F.transform(F.split(text, "\n", -1), trimmed), lambda x: F.when(x != "", F.struct(line_hash(x).alias("line"), F.hash(x).alias("print"))))


def index(docs: DataFrame, shard_lines: int = SHARD_LINES) -> tuple[str, int]:
    """The folder of the shards over all lines of ``docs``, and the bits of a hash that choose the shard."""
    spark = docs.sparkSession
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("owner"), F.explode(line_hashes(F.col("text"))).alias("l")).where("l is not null").select("owner", "l.line", "l.print")
    lines = table(lines.groupBy("line", "print").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner")), "lines")
    bits = max(0, int(np.ceil(np.log2(max(1, lines.count()) / shard_lines))))
    folder = posix(shared_folder(spark, "line-index"))

    def build(key, got):
        n = key[0].as_py()
        order = np.lexsort((got["print"].to_numpy(), got["line"].to_numpy()))
        hashes, prints, counts, owners = (got[c].to_numpy()[order] for c in ("line", "print", "n", "owner"))
        again = np.append(False, hashes[1:] == hashes[:-1])
        apart = np.stack([x[again].astype(np.int64) for x in (hashes, prints, counts, owners)], axis=1)
        keys, prints, counts, owners = hashes[~again].view(np.uint64), prints[~again], counts[~again], owners[~again]
        which = PerfectHash.build(keys)
        at = which.index(keys)
        arrays = {"bits": which.bits, "ranks": which.ranks, "levels": which.levels, "rest": which.rest, "apart": apart}
        for name, values in (("fingerprints", prints), ("counts", counts.astype(np.min_scalar_type(int(counts.max(initial=0))))), ("owners", owners)):
            arrays[name] = np.empty_like(values)
            arrays[name][at] = values
        os.makedirs(folder, exist_ok=True)
        for name in PARTS:  # owners last: they say that the shard is whole
            save_array(f"{folder}/{n}.{name}.npy", arrays[name])
        slim()
        return pa.table({"shard": [n], "n": [len(keys)]})

    shard = F.shiftrightunsigned("line", 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    lines.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, n long").agg(F.sum("n")).collect()
    return folder, bits


def dedup(docs: DataFrame, shard_lines: int = SHARD_LINES) -> DataFrame:
    """``docs`` with later copies of lines taken out of ``text``, and ``lines_removed`` (int).

    A line counts without the spaces, tabs and carriage returns around it; blank lines stay and count for nothing. Of a line that occurs more
    than once, the first occurrence in the document of least doc_id stays, whatever the order of rows. Rows of
    one doc_id count as one document, so each of them keeps what that document keeps; rows of null ids count
    as one document after all others. A null text stays null, with 0 removed; an empty one stays empty.
    Columns named lines_removed are replaced; all others stay."""
    folder, bits = index(docs, shard_lines)

    @F.arrow_udf("array<boolean>")
    def kept(hashes: pa.Array, ids: pa.Array) -> pa.Array:
        lines = once("lines", folder, lambda: Index(folder, bits))
        each = hashes.flatten()
        null = np.asarray(each.is_null())
        offsets = np.asarray(hashes.offsets).astype(np.int64) - hashes.offsets[0].as_py()
        field = lambda name: pc.struct_field(each, name).fill_null(0).to_numpy(zero_copy_only=False)
        filled, prints = field("line").view(np.uint64), field("print")
        counts, owners = np.zeros(len(filled), np.int64), np.zeros(len(filled), np.int64)
        counts[~null], owners[~null] = lines.probe(filled[~null], prints[~null])
        doc = np.repeat(np.arange(len(hashes)), np.diff(offsets))
        mine = np.repeat(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), np.diff(offsets))
        keep = (counts <= 1) | (owners == mine)
        again = np.flatnonzero((counts > 1) & keep)
        first = np.lexsort((again, prints[again], filled[again], doc[again]))
        same = np.append(False, np.logical_and.reduce([x[again][first][1:] == x[again][first][:-1] for x in (filled, prints, doc)])) if len(again) else np.zeros(0, bool)
        keep[again[first[same]]] = False
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keep))

    k, t, n = fresh(docs, "keep_", "text_", "removed_")
    marked = docs.withColumn(k, kept(F.coalesce(line_hashes(F.col("text")), F.array().cast("array<struct<line:bigint,print:int>>")), F.col("doc_id").cast("long")))
    mask = F.col(f"`{k}`")
    left = let(F.split(F.col("text"), "\n", -1), lambda a: F.array_join(F.filter(a, lambda _, i: F.get(mask, i)), "\n"))
    removed = F.size(F.filter(mask, lambda x: ~x))
    text = F.when(removed > 0, left).otherwise(F.col("text"))
    cols = [text.alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() != "lines_removed"]
    return marked.select(*cols, removed.alias("lines_removed"))


def emptied(text: Column, removed: Column) -> Column:
    """Whether all that a document said is said before."""
    return (removed > 0) & (F.trim(text, F.lit(" \t\r\n")) == "")
