"""Byte-level BPE: ranked merges folded over distinct words in Spark, and pieces concatenated again."""

from __future__ import annotations

import base64
import heapq
import os
import re
import uuid
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import fresh, let, load_array, number_list, once, posix, put, ragged, save_array, shared_folder, slim, table

#: The pattern of the rank files, with Unicode's white space; its alternatives in the order of how often they match, as
#: those that swap places begin with other letters, and without giving back letters where that can't help.
PATTERN = r"(?U) ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s++"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words that one shard of the word table holds, about, and that one task encodes, at most.
SHARD_WORDS, TASK_WORDS = 500_000, 200_000
#: Words of more bytes are merged by a heap in a worker, as a fold copies the word at every merge.
LONG = 1_000
#: Bits of an id; a larger number is the rank of a pair that no merge makes.
BITS = 17
NONE = 1 << BITS


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def displaced(pairs: dict[int, dict[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a sparse table laid over one another: the value of (left, right) lies at shift[left] + right, and names left."""
    columns = {left: np.array(sorted(row)) for left, row in pairs.items()}
    free, shift, first = np.ones(2 * n, bool), np.zeros(n, np.int64), 0
    for left, at in sorted(columns.items(), key=lambda x: (-len(x[1]), x[0])):
        if len(at) == 1:  # these fill the gaps
            break
        begin, block = max(first - 65536, int(at[0])), 64
        while True:
            if (short := begin + block + n - len(free)) > 0:
                free = np.append(free, np.ones(short + n, bool))
            start = np.flatnonzero(free[begin : begin + block]) + begin - at[0]
            for c in at[1:]:
                start = start[free[start + c]]
            if len(start):
                break
            begin, block = begin + block, min(4 * block, 1 << 14)
        shift[left], first = start[0], int(start[0] + at[0])
        free[start[0] + at] = False
    single = [left for left, at in columns.items() if len(at) == 1]
    gaps = np.flatnonzero(np.append(free, np.ones(len(single), bool)))[: len(single)]
    shift[single] = gaps - [int(columns[left][0]) for left in single]
    out = np.full(max([0, *(int(shift[left] + at[-1]) for left, at in columns.items())]) + 1, NONE - 1 << BITS, np.int64)
    for left, at in columns.items():
        out[shift[left] + at] = [left << BITS | pairs[left][c] for c in at.tolist()]
    return shift, out


class RankMap:
    """Ranks of adjacent pieces as literal arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        if max(ranks.values()) >= NONE - 1:
            raise ValueError(f"ids of up to {BITS} bits are known")
        pairs: dict[int, dict[int, int]] = {}
        for p, r in ranks.items():
            for k in range(1, len(p)):
                if p[:k] in ranks and p[k:] in ranks:
                    pairs.setdefault(ranks[p[:k]], {})[ranks[p[k:]]] = r
        shift, slots = displaced(pairs, max(ranks.values()) + 1)
        self.shift, self.slots = number_list(shift, "bigint"), number_list(slots, "bigint")
        # of a byte and the next one, or 256 at the end: the pair's rank and the byte's id
        of = [ranks[bytes([b])] for b in range(256)]
        self.starts = number_list((pairs.get(of[a], {}).get(of[b] if b < 256 else -1, NONE) << BITS | of[a] for a in range(256) for b in range(257)), "bigint")
        self.hex = F.split(F.lit(",".join(p.hex().upper() for p, _ in sorted(ranks.items(), key=lambda x: x[1]))), ",")


def merged(word: Column, ranks: RankMap) -> Column:
    """Ids of a word: its bytes' ids, of which the adjacent pair of least rank, the first of equals, is merged until none is left.

    The fold's state is an array of longs, each the rank of the pair that begins there above the id; an end mark
    on both sides pairs with nothing. A merge replaces two of them by one, and renews the one before."""
    mask, none = F.lit((1 << BITS) - 1), F.lit(NONE).cast("bigint")
    mark = F.array(F.lit(NONE << BITS | NONE - 1).cast("bigint"))
    codes = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c))

    def fold(slots: Column, shift: Column, starts: Column) -> Column:
        def with_rank(left: Column, right: Column) -> Column:
            # no place for the pair, or one that another pair has: more than any rank
            rank = F.least(F.get(slots, F.get(shift, left) + right).bitwiseXOR(F.shiftleft(left, BITS)), none)
            return F.shiftleft(rank, BITS).bitwiseOR(left)

        def merge(e: Column, m: Column, at: Column) -> Column:
            before, after = F.get(e, at - 2).bitwiseAND(mask), F.get(e, at + 1).bitwiseAND(mask)
            return F.flatten(F.array(F.slice(e, F.lit(1), at - 2), F.array(with_rank(before, m), with_rank(m, after)), F.slice(e, at + 2, F.size(e))))

        def round_(e: Column, _: Column) -> Column:
            return let(F.array_min(e), lambda x: F.when(x >= F.lit(NONE << BITS), e).otherwise(let(F.array_position(e, x).cast("int"), lambda at: merge(e, F.shiftright(x, BITS), at))))

        start = let(codes, lambda c: F.flatten(F.array(mark, F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.get(starts, a * 257 + F.coalesce(b, F.lit(256)))), mark)))
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2))), start, round_)

    folded = let(ranks.slots, lambda a: let(ranks.shift, lambda b: let(ranks.starts, lambda c: fold(a, b, c))))
    return let(folded, lambda e: F.transform(F.slice(e, F.lit(2), F.size(e) - 2), lambda x: x.bitwiseAND(mask).cast("int")))


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids by a heap of pairs: n log n steps for n bytes."""
    n = len(word)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k, end = heapq.heappop(heap)
        middle = ends[k]
        if not alive[k] or middle >= n or ends[middle] != end:  # one of the two is another piece by now
            continue
        alive[middle], ends[k] = 0, end
        if end < n:
            before[end] = k
            if (r := ranks.get(word[k : ends[end]])) is not None:
                heapq.heappush(heap, (r, k, ends[end]))
        if (p := before[k]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    k, out = 0, []
    while k < n:
        out.append(ranks[word[k : ends[k]]])
        k = ends[k]
    return out


#: White space that fills LONG characters or more, all but the last character before other text: a word of its own, cut out before
#: the compiled encoder's expressions, which can't hold such a run.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(rf"{_SPACE}{{{LONG},}}(?:(?={_SPACE})|\Z)")


def count_tokens(text: str, encoder, ranks: dict[bytes, int]) -> int:
    n, begin = 0, 0
    for run in _RUN.finditer(text):
        n += len(encoder.encode_ordinary(text[begin : run.start()])) + len(heap_merged(run[0].encode(), ranks))
        begin = run.end()
    return n + len(encoder.encode_ordinary(text[begin:]))


def n_tokens(text: Column, ranks: dict[bytes, int]) -> Column:
    """How many ids ``encode`` gives a text, counted by a compiled encoder where the text is, without a shuffle; null for null."""
    key = uuid.uuid4().hex

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        import tiktoken

        pattern = PATTERN.removeprefix("(?U)")
        encoder = once("encoder", key, lambda: tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        out = pa.array([None if t is None else count_tokens(t, encoder, ranks) for t in (x.as_py() for x in texts)], pa.int64())
        slim()
        return out

    return counted(text)


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def word_hash(word: Column, seed: int = 0) -> Column:
    return F.xxhash64(word, F.lit(seed))


def word_table(docs: DataFrame, ranks: RankMap, shard_words: int = SHARD_WORDS) -> tuple[str, int, dict[str, tuple[int, list[int]]]]:
    """The folder of the encoded distinct words, as sorted hashes with their ids' places, and the bits that name a shard.

    Words that share a hash, n^2 / 2^65 pairs of n, are given back apart, with another hash each."""
    spark = docs.sparkSession
    distinct = table(docs.select(F.explode(pieces(F.col("text"))).alias("word")).where("word <> ''").distinct(), "words")
    n = distinct.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n) / shard_words))))
    folder = posix(shared_folder(spark, "bpe"))
    known = ranks.ranks

    @F.arrow_udf("array<int>")
    def heaps(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else heap_merged(w, known) for w in words.to_pylist()], pa.list_(pa.int32()))

    def ids(words: DataFrame) -> DataFrame:
        short = words.where(F.octet_length("word") <= LONG).withColumn("ids", merged(F.col("word"), ranks))
        return short.unionByName(words.where(F.octet_length("word") > LONG).withColumn("ids", heaps(F.encode("word", "UTF-8"))))

    def save(key, got):
        s = key[0].as_py()
        hashes = got["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        ids, offsets = ragged(got["ids"].take(pa.array(order)))
        hashes = hashes[order]
        os.makedirs(folder, exist_ok=True)
        for name, x in (("ids", ids.astype(np.int32)), ("offsets", offsets), ("hashes", hashes)):
            save_array(f"{folder}/{s}.{name}.npy", x)
        return pa.table({"hash": np.unique(hashes[1:][hashes[1:] == hashes[:-1]]).view(np.int64)})

    shard = F.shiftrightunsigned("hash", 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_WORDS))
    hashed = ids(distinct.repartition(tasks).withColumn("hash", word_hash(F.col("word")))).select(shard.alias("shard"), "hash", "ids")
    shared = [r.hash for r in hashed.groupBy("shard").applyInArrow(save, "hash long").collect()]
    apart: dict[str, tuple[int, list[int]]] = {}
    if shared:
        words = Words(folder, bits, {})
        for r in ids(distinct.where(word_hash(F.col("word")).isin(shared))).collect():
            seed = next(k for k in count(1) if not words.has(h := second_hash(spark, r.word, k)) and h not in {x for x, _ in apart.values()})
            apart[r.word] = second_hash(spark, r.word, seed), r.ids
    return folder, bits, apart


def second_hash(spark: SparkSession, word: str, seed: int) -> int:
    return spark.range(1).select(F.xxhash64(F.lit(word), F.lit(seed))).first()[0]


class Words:
    def __init__(self, folder: str, bits: int, apart: dict[str, tuple[int, list[int]]]):
        self.folder, self.bits, self.maps = folder, bits, {}
        self.apart = {np.int64(h).view(np.uint64): np.array(ids, np.int32) for h, ids in apart.values()}

    def shard(self, s: int):
        if s not in self.maps:
            path = f"{self.folder}/{s}.hashes.npy"
            self.maps[s] = [load_array(f"{self.folder}/{s}.{x}.npy") for x in ("hashes", "offsets", "ids")] if os.path.exists(path) else [np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)]
        return self.maps[s]

    def has(self, h: int) -> bool:
        h = np.int64(h).view(np.uint64)
        hashes = self.shard(int(h >> np.uint64(64 - self.bits)) if self.bits else 0)[0]
        at = np.searchsorted(hashes, h)
        return bool(at < len(hashes) and hashes[at] == h)

    def encode(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and how many each has."""
        word, place = np.unique(sought, return_inverse=True)
        shard = (word >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(word), np.int64)
        sizes, parts = np.zeros(len(word), np.int64), []
        own = np.isin(word, np.array(list(self.apart), np.uint64)) if self.apart else np.zeros(len(word), bool)
        for s in np.unique(shard):
            a, b = np.searchsorted(shard, [s, s + 1])
            hashes, offsets, ids = self.shard(int(s))
            at = np.searchsorted(hashes, word[a:b][~own[a:b]])
            first, n = offsets[at], offsets[at + 1] - offsets[at]
            sizes[a:b][~own[a:b]] = n
            parts.append(ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begin = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(own).tolist():
            begin[k], sizes[k] = len(flat), len(self.apart[word[k]])
            flat = np.concatenate([flat, self.apart[word[k]]])
        first, n = begin[place], sizes[place]
        return flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def encode(docs: DataFrame, ranks: RankMap | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the text's tokens.

    Each distinct word of all texts is encoded once, those of up to LONG bytes by a fold and longer ones, which cost
    it a copy of the word a merge, by a heap; documents look their words up by 64-bit hash, and words that
    share one have another each. Null texts have null ids, empty ones none; words of any length are
    taken whole; repeated rows agree; a column named ids is replaced, all others stay; no rows give none."""
    folder, bits, apart = word_table(docs, ranks or RankMap(load_ranks()), shard_words)

    @F.arrow_udf("array<int>")
    def look_up(hashes: pa.Array) -> pa.Array:
        words = once("bpe", folder, lambda: Words(folder, bits, apart))
        values, offsets = ragged(hashes)
        ids, n = words.encode(np.asarray(values).view(np.uint64))
        ends = np.concatenate([[0], np.cumsum(n)])[offsets]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    def known_by(w: Column) -> Column:
        out = word_hash(w)
        for word, (h, _) in apart.items():
            out = F.when(w == F.lit(word), F.lit(h)).otherwise(out)
        return out

    (i,) = fresh(docs, "ids_")
    hashes = F.transform(pieces(F.coalesce(F.col("text"), F.lit(""))), known_by)
    return put(docs.withColumn(i, look_up(hashes)), {"ids": F.when(F.col("text").isNotNull(), F.col(f"`{i}`"))}).drop(i)


def decode(ids: Column, ranks: RankMap) -> Column:
    """The text of tokens: their pieces' bytes one after another; null for null."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(ranks.hex, i)), "")).cast("string")
