"""LM scoring: an interpolated modified Kneser-Ney model of any order in sorted hash arrays, mapped by the workers."""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, load_array, once, posix, put, ragged, save_array, shared_folder, words
from quern.llm.lines import mix

#: Begin and end of a document, as if they were words' hashes.
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Words of the longest n-grams in op5_lm_scoring.
ORDER = 3
#: Tokens that a worker takes at a time.
SLICE = 1_000_000
#: N-grams whose middle words all have this share of all words are spread over all shards.
HOT = 0.001


# ---------------------------------------------------------------- numbers as bytes


def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed: what is mostly small takes few bits."""
    x = np.ascontiguousarray(x, "<u8")
    planes = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    body = x.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return struct.pack("<QB", len(x), planes) + (pa.compress(body, "zstd", asbytes=True) if body else b"")


def unpacked(blob: bytes) -> np.ndarray:
    n, planes = struct.unpack("<QB", blob[:9])
    out = np.zeros((n, 8), np.uint8)
    if n and planes:
        out[:, :planes] = np.frombuffer(pa.decompress(blob[9:], n * planes, "zstd", asbytes=True), np.uint8).reshape(planes, n).T
    return out.view("<u8").ravel()


def steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Each number less the one before it, but where a new run begins."""
    return x - np.where(new, 0, np.append(np.zeros(1, x.dtype), x[:-1]))


def from_steps(d: np.ndarray, new: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(new)
    total = np.cumsum(d, dtype=np.uint64)
    return total - np.repeat(total[at] - d[at], np.diff(np.append(at, len(d))))


def sort_order(k: int) -> list[int]:
    """The places of an n-gram's words in order of sorting: those in the middle, the first, the last."""
    return [*range(1, k - 1), 0, k - 1] if k > 1 else [0]


def gram_blobs(shard: np.ndarray, grams: list[np.ndarray], *counts: np.ndarray) -> pa.RecordBatch:
    """A row a shard, with its n-grams, which are sorted, and their counts, a column each."""
    order = np.argsort(shard.astype(np.min_scalar_type(int(shard.max(initial=0)))), kind="stable")
    shard, by = shard[order], sort_order(len(grams))
    grams, counts = [g[order] for g in grams], [c[order] for c in counts]
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    columns: list[list[bytes]] = [[] for _ in range(len(grams) + len(counts))]
    for a, z in zip(starts, np.append(starts[1:], len(shard))):
        new = np.arange(z - a) == 0
        for j, g in enumerate(by):
            x = grams[g][a:z]
            columns[j].append(packed(steps(x, new) if j < 2 else x))
            if j == 0:
                new = np.append(True, x[1:] != x[:-1])
        for j, c in enumerate(counts, len(grams)):
            columns[j].append(packed(c[a:z]))
    names = [f"b{j}" for j in range(len(columns))]
    return pa.RecordBatch.from_pydict({"shard": shard[starts].astype(np.int64)} | dict(zip(names, columns)), schema=pa.schema([("shard", pa.int64()), *[(n, pa.binary()) for n in names]]))


def gram_columns(table: pa.Table, k: int, counts: int) -> list[np.ndarray]:
    """What gram_blobs packed, of all rows, one after another."""
    by, out = sort_order(k), [[] for _ in range(k + counts)]
    for row in zip(*(table[f"b{j}"].to_pylist() for j in range(k + counts))):
        cols = [unpacked(b) for b in row]
        new = np.arange(len(cols[0])) == 0
        for j, g in enumerate(by):
            x = from_steps(cols[j], new) if j < 2 else cols[j]
            out[g].append(x)
            if j == 0:
                new = np.append(True, x[1:] != x[:-1]) if len(x) else new
        for j in range(counts):
            out[k + j].append(cols[k + j])
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def ordered(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by these columns; as one number a row if it fits, with the first column's ranks for its values if that helps."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    bits = [int(c.max()).bit_length() for c in columns]
    if sum(bits) > 64:
        values, ranks = np.unique(columns[0], return_inverse=True)
        columns, bits = [ranks.astype(np.uint64), *columns[1:]], [len(values).bit_length(), *bits[1:]]
    if sum(bits) > 64:
        return np.lexsort(columns[::-1])
    one = columns[0].astype(np.uint64)
    for c, b in zip(columns[1:], bits[1:]):
        one = (one << np.uint64(b)) | c
    return np.argsort(one)


def summed(grams: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order, their counts summed."""
    order = ordered([grams[j] for j in sort_order(len(grams))])
    grams = [g[order] for g in grams]
    first = starts_of(grams)
    return [g[first] for g in grams], np.add.reduceat(n[order], first).astype(np.int64) if len(first) else np.zeros(0, np.int64)


def counted(ids: np.ndarray, place: np.ndarray, starts: np.ndarray, order: int, pad: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order and their counts; the words are ``ids`` by ``place``, and each n-gram is one number if it can be."""
    by = np.argsort(ids)
    rank = np.empty(len(ids), np.uint64)
    rank[by] = np.arange(len(ids), dtype=np.uint64)
    ids = np.append(ids[by], np.uint64(pad))
    grams = ngrams(rank[place], starts, order, len(ids) - 1)
    bits = len(ids).bit_length()
    if order * bits > 64:
        grams, n = summed(grams, np.ones(len(grams[0]), np.int64))
        return [ids[g.astype(np.int64)] for g in grams], n
    one = np.zeros(len(grams[0]), np.uint64)
    for j in sort_order(order):
        one = (one << np.uint64(bits)) | grams[j]
    one.sort()
    first = starts_of([one])
    n, one = np.diff(np.append(first, len(one))), one[first]
    out: list[np.ndarray] = [one] * order
    for j in reversed(sort_order(order)):
        out[j] = ids[(one & np.uint64((1 << bits) - 1)).astype(np.int64)]
        one = one >> np.uint64(bits)
    return out, n


def starts_of(columns: list[np.ndarray]) -> np.ndarray:
    """Where any of the columns changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# ---------------------------------------------------------------- hash arrays


def key_of(grams: list[np.ndarray]) -> np.ndarray:
    """A hash of n-grams given word by word."""
    h = grams[0]
    with np.errstate(over="ignore"):
        for w in grams[1:]:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w, 5)
    return mix(h, 7)


HASH_PARTS = ("starts", "low", "lowest", "codes", "rare", "rarecodes", "values")


def save_hashed(path: str, keys: np.ndarray, values: np.ndarray) -> None:
    """Distinct keys in order, with their rows of values: buckets of about four by the first bits, of which the next 24 are kept.

    Values are coded by how frequent they are, in a byte; the codes of rarer ones lie apart."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    b = max(0, int(np.ceil(np.log2(max(1, len(keys)) / 4))))
    bucket = (keys >> np.uint64(64 - b)).astype(np.int64) if b else np.zeros(len(keys), np.int64)
    low = (keys >> np.uint64(40 - b)) & np.uint64(0xFFFFFF)
    bits = [int(values[:, j].max(initial=0)).bit_length() for j in range(values.shape[1])]
    row = values[:, 0].astype(np.uint64)
    for j, size in enumerate(bits[1:], 1):
        row = (row << np.uint64(size)) | values[:, j].astype(np.uint64)
    if sum(bits) > 64:
        row = key_of([values[:, j].astype(np.uint64) for j in range(values.shape[1])])
    if sum(bits) <= 20:  # few enough kinds to be counted in place
        n = np.bincount(row.astype(np.int64), minlength=1)
        place, n = (np.cumsum(n > 0) - 1)[row.astype(np.int64)], n[n > 0]
    else:
        _, place, n = np.unique(row, return_inverse=True, return_counts=True)
    at = np.empty(len(n), np.int64)
    at[place] = np.arange(len(place))
    by = np.argsort(-n, kind="stable")
    code = np.empty(len(by), np.int64)
    code[by] = np.arange(len(by))
    code = code[place]
    rare = np.flatnonzero(code >= 255)
    starts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1 << b))])
    arrays = (starts.astype(np.uint32), (low >> np.uint64(8)).astype(np.uint16), (low & np.uint64(255)).astype(np.uint8), np.minimum(code, 255).astype(np.uint8), rare, code[rare], values[at[by]])
    for name, x in zip(reversed(HASH_PARTS), reversed(arrays)):  # starts last: they say that the table is whole
        save_array(f"{path}.{name}.npy", x)


class Hashed:
    """What save_hashed wrote, mapped."""

    def __init__(self, path: str):
        self.starts, self.low, self.lowest, self.codes, self.rare, self.rarecodes, self.values = (np.asarray(load_array(f"{path}.{n}.npy")) for n in HASH_PARTS)
        self.b = (len(self.starts) - 1).bit_length() - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of values of keys; zeros for those that aren't there, but for one in some millions."""
        out = np.zeros((len(keys), self.values.shape[1]), np.int64)
        if not len(self.codes):
            return out
        bucket = (keys >> np.uint64(64 - self.b)).astype(np.int64) if self.b else np.zeros(len(keys), np.int64)
        low = (keys >> np.uint64(40 - self.b)) & np.uint64(0xFFFFFF)
        low, lowest = (low >> np.uint64(8)).astype(np.uint16), low.astype(np.uint8)
        at, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        who = np.flatnonzero(at < end)
        at, end, low, lowest = at[who], end[who], low[who], lowest[who]
        rows, places = [], []
        while len(who):
            hit = self.low[at] == low
            some = np.flatnonzero(hit)
            false = self.lowest[at[some]] != lowest[some]
            hit[some[false]] = False
            some = some[~false]
            rows.append(who[some]), places.append(at[some])
            at += 1
            left = np.flatnonzero(~hit & (at < end))
            who, at, end, low, lowest = who[left], at[left], end[left], low[left], lowest[left]
        row, place = np.concatenate(rows or [who]), np.concatenate(places or [at])
        code = self.codes[place].astype(np.int64)
        if len(self.rare):
            far = np.flatnonzero(code == 255)
            code[far] = self.rarecodes[np.searchsorted(self.rare, place[far])]
        out[row] = self.values[code]
        return out


# ---------------------------------------------------------------- words


def sequences(values: np.ndarray, offsets: np.ndarray, most: int):
    """Slices of whole documents, of up to ``most`` words unless one is longer: the first and last document, the words with begin and end, and where each document begins."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        n = offsets[a : b + 1] - offsets[a]
        starts = n[:-1] + 2 * np.arange(b - a)
        seq = np.empty(int(n[-1]) + 2 * (b - a), np.uint64)
        inner = np.ones(len(seq), bool)
        ends = n[1:] + 2 * np.arange(b - a) + 1
        seq[starts], seq[ends] = BEGIN, END
        inner[starts] = inner[ends] = False
        seq[inner] = values[offsets[a] : offsets[b]].view(np.uint64)
        yield a, b, seq, starts
        a = b


def tokens(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)).alias("h"))


class Dictionary:
    """Words' numbers, frequent ones first: the class of a word's count, its place among its shard's words of that class."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.maps = folder, bits, {}
        self.starts = np.load(f"{folder}/starts.npy")
        self.size = int(self.starts[-1, -1])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by hash; size + 1 for unknown ones."""
        ids, place = self.distinct(hashes)
        return ids[place]

    def distinct(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the distinct words, and which of these each word is."""
        word, place = np.unique(hashes, return_inverse=True)
        out = np.full(len(word), self.size + 1, np.uint64)
        shard = (word >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(word), np.int64)
        for s in np.unique(shard).tolist():
            a, z = np.searchsorted(shard, [s, s + 1])
            if s not in self.maps:
                known = os.path.exists(f"{self.folder}/w{s}.words.npy")
                self.maps[s] = [load_array(f"{self.folder}/w{s}.{n}.npy") for n in ("words", "classes", "places")] if known else None
            if self.maps[s] is None:
                continue
            words_, classes, places = self.maps[s]
            at = np.minimum(np.searchsorted(words_, word[a:z]), len(words_) - 1)
            hit = words_[at] == word[a:z]
            out[a:z][hit] = (self.starts[s, classes[at[hit]]] + places[at[hit]]).astype(np.uint64)
        return out, place


def dictionary(docs: DataFrame, folder: str, bits: int) -> tuple[int, int]:
    """Writes the dictionary of all words; how many there are, and how many of them, the first, have the share HOT.

    The driver gets a row a shard and class."""
    most = SLICE
    of = lambda x: (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)

    def count(batches):
        for batch in batches:
            values, offsets = ragged(batch.column(0))
            offsets = offsets[np.append(True, np.diff(offsets) > 0)]
            for _, _, seq, _ in sequences(values, offsets, most):
                word, n = np.unique(seq, return_counts=True)
                shard = of(word)
                starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                cuts = list(zip(starts, np.append(starts[1:], len(word))))
                yield pa.RecordBatch.from_pydict({"shard": shard[starts], "b0": [packed(steps(word[a:z], np.arange(z - a) == 0)) for a, z in cuts], "b1": [packed(n[a:z]) for a, z in cuts]}, schema=pa.schema([("shard", pa.int64()), ("b0", pa.binary()), ("b1", pa.binary())]))

    def save(key, table):
        s = key[0].as_py()
        word = np.concatenate([np.cumsum(unpacked(b), dtype=np.uint64) for b in table["b0"].to_pylist()])
        n = np.concatenate([unpacked(b) for b in table["b1"].to_pylist()]).astype(np.int64)
        (word,), n = summed([word], n) if len(word) else ([word], n)
        class_ = 63 - np.floor(np.log2(n)).astype(np.int64)
        order = np.argsort(class_, kind="stable")
        each = np.bincount(class_, minlength=64)
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n)) - np.repeat(np.cumsum(each) - each, each)
        os.makedirs(folder, exist_ok=True)
        for name, x in (("places", place.astype(np.uint32)), ("classes", class_.astype(np.uint8)), ("words", word)):
            save_array(f"{folder}/w{s}.{name}.npy", x)
        some = np.flatnonzero(each)
        return pa.table({"shard": np.full(len(some), s), "class": some, "n": each[some], "total": np.bincount(class_, n, 64)[some].astype(np.int64)})

    rows = tokens(docs).mapInArrow(count, "shard long, b0 binary, b1 binary").groupBy("shard").applyInArrow(save, "shard long, class long, n long, total long").collect()
    each = np.zeros((64, 1 << bits), np.int64)
    for r in rows:
        each[r["class"], r.shard] = r.n
    ends = np.cumsum(each.ravel()).reshape(each.shape)
    starts = np.concatenate([(ends - each).T, np.full((1 << bits, 1), ends[-1, -1])], axis=1)
    os.makedirs(folder, exist_ok=True)
    save_array(f"{folder}/starts.npy", starts)
    total = sum(r.total for r in rows)
    hot = int(np.floor(63 - np.log2(max(1.0, HOT * total))))  # classes of at least this share
    return int(ends[-1, -1]), int(ends[hot, -1])


# ---------------------------------------------------------------- the model


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from how many n-grams have count 1, 2, 3, 4; plain values where a count of counts is zero."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2) <= 0:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 > 0 else 2.0]
    return np.array([min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)])


def place_of(grams: list[np.ndarray], hot: int) -> np.ndarray:
    """The hash that chooses an n-gram's shard: that of its middle words, so that a shard has all n-grams with the words before and
    after the same middle; of a bigram that of its first word. N-grams whose middle, or first word, is hot go by all but
    the last word, and bigrams by both."""
    middle, spread = (grams[1:-1], grams[:-1]) if len(grams) > 2 else (grams[:1], grams)
    is_hot = np.logical_and.reduce([m < hot for m in middle])
    return mix(np.where(is_hot, key_of(spread), key_of(middle)), 11)  # another hash than the keys', so that a shard's keys are spread evenly


def ngrams(seq: np.ndarray, starts: np.ndarray, order: int, pad: int) -> list[np.ndarray]:
    """All n-grams inside documents, word by word; a document of fewer words gives one, filled up with ``pad``."""
    sizes = np.diff(np.append(starts, len(seq)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(seq))
    full, short = np.flatnonzero(left >= order), np.flatnonzero(sizes < order)
    filled = [np.where(k < sizes[short], seq[starts[short] + np.minimum(k, sizes[short] - 1)], np.uint64(pad)) for k in range(order)]
    return [np.concatenate([seq[full + k], filled[k]]) for k in range(order)]


def contexts_of(context: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct contexts, which lie together, and for each the sum of its n-grams' counts and how many are 1, 2 and more."""
    first = starts_of(context)
    each = np.stack([n, n == 1, n == 2, n >= 3], axis=1).astype(np.int64)
    return [c[first] for c in context], np.add.reduceat(each, first, axis=0) if len(first) else each


def train(docs: DataFrame, order: int) -> tuple[str, int, dict]:
    """The model's folder, the bits of a hash that name its shard, and its totals.

    One shuffle numbers the words, frequent ones first, so that n-grams pack into few bytes. One brings counts of the
    longest n-grams, summed slice by slice, to the shard of their middle; one for each shorter length from there down to
    bigrams brings how many words come before each, and plain counts at the documents' begin. As all n-grams
    with one middle are together, each shorter one is sent once, but for hot ones. A last, smaller one brings continuation
    counts to the shard of their word, and what the shards know of hot first words to one shard each. All carry packed
    arrays. The driver gets a row a shard."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    bits = max(0, int(np.ceil(np.log2(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))))
    folder = posix(shared_folder(spark, "lm"))
    size, hot = dictionary(docs, folder, bits)
    pad, most = size, SLICE
    of = lambda h: (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    known = lambda: once("lm-words", folder, lambda: Dictionary(folder, bits))

    def count(batches):
        for batch in batches:
            values, offsets = ragged(batch.column(0))
            some = np.flatnonzero(np.diff(offsets) > 0)
            offsets = np.append(offsets[some], offsets[-1])
            for _, _, seq, starts in sequences(values, offsets, most):
                grams, n = counted(*known().distinct(seq), starts, order, pad)
                yield gram_blobs(of(place_of(grams, hot)), grams, n)

    def sizes_of(table, n, k) -> bytes:
        """How many n-grams have count 1, 2, 3, 4, by length; ``table`` has those of longer ones."""
        sizes = np.zeros(4 * (order - 1), np.int64)
        for b in table["sizes"].to_pylist() if "sizes" in table.column_names else []:
            sizes += np.frombuffer(b, np.int64) if b else 0
        sizes[4 * (k - 2) : 4 * (k - 1)] = [(n == c).sum() for c in (1, 2, 3, 4)]
        return sizes.tobytes()

    def with_sizes(out: pa.Table, sizes: bytes) -> pa.Table:
        return out.append_column("sizes", pa.array([sizes] + [b""] * (out.num_rows - 1), pa.binary()))

    def longer(k):
        """Stores n-grams of ``k`` words, 3 or more, and gives the adjusted counts of those of one word less."""

        def run(key, table):
            s = key[0].as_py()
            begin = known().ids(np.array([BEGIN]))[0]
            *grams, n = gram_columns(table, k, 1)
            grams, n = summed(grams, n)
            whole, first = grams[-1] != pad, grams[0] == begin
            own = [g[whole] for g in grams]
            save_hashed(f"{folder}/{s}.g{k}", key_of(own), n[whole, None])
            context, stats = contexts_of(own[:-1], n[whole])
            save_hashed(f"{folder}/{s}.c{k}", key_of(context), stats)
            # each is another word before the rest; at the begin nothing is before, and all that begins so counts
            rest = [np.concatenate([own[j + 1], grams[j][first]]) for j in range(k - 1)]
            rest, m = summed(rest, np.concatenate([np.ones(int(whole.sum()), np.int64), n[first]]))
            return with_sizes(pa.Table.from_batches([gram_blobs(of(place_of(rest, hot)), rest, m)]), sizes_of(table, n[whole], k))

        return run

    def merge(key, table):
        s = key[0].as_py()
        *grams, n = gram_columns(table, 2, 1)
        grams, n = summed(grams, n)
        save_hashed(f"{folder}/{s}.g2", key_of(grams), n[:, None])
        (context,), stats = contexts_of(grams[:1], n)
        spread = context < hot
        save_hashed(f"{folder}/{s}.c2", key_of([context[~spread]]), stats[~spread])
        (word,), before = summed([grams[1]], np.ones(len(n), np.int64))
        # one kind of row: continuations of words have stats of zero, contexts no continuation
        names = np.concatenate([word, context[spread]])
        each = np.zeros((len(names), 5), np.int64)
        each[: len(word), 0], each[len(word) :, 1:] = before, stats[spread]
        order_ = np.argsort(names, kind="stable")
        names, each = names[order_], each[order_]
        return with_sizes(pa.Table.from_batches([gram_blobs(of(mix(key_of([names]), 11)), [names], *each.T)]), sizes_of(table, n, 2))

    def continuations(key, table):
        s = key[0].as_py()
        word, *each = gram_columns(table, 1, 5)
        order_ = np.argsort(word, kind="stable")
        word = word[order_]
        first = starts_of([word])
        each = np.add.reduceat(np.stack(each, axis=1)[order_].astype(np.int64), first, axis=0)
        word, before = word[first], each[:, 0]
        save_hashed(f"{folder}/{s}.u", key_of([word[before > 0]]), before[before > 0, None])
        some = each[:, 1] > 0
        save_hashed(f"{folder}/{s}.h2", key_of([word[some]]), each[some, 1:])
        before = before[before > 0]
        sizes = np.zeros(4 * (order - 1), np.int64)
        for b in table["sizes"].to_pylist():
            sizes += np.frombuffer(b, np.int64) if b else 0
        counts = [int((before == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({k: [int(x)] for k, x in zip(names, (len(before), before.sum(), *counts, (before >= 3).sum(), *sizes))})

    names = ("types", "total", "c1", "c2", "c3", "c4", "m3", *(f"n{k}_{c}" for k in range(2, order + 1) for c in (1, 2, 3, 4)))
    binary = lambda n: ", ".join(f"b{j} binary" for j in range(n))
    grams = tokens(docs).mapInArrow(count, f"shard long, {binary(order + 1)}")
    for k in range(order, 2, -1):
        grams = grams.groupBy("shard").applyInArrow(longer(k), f"shard long, {binary(k)}, sizes binary")
    merged = grams.groupBy("shard").applyInArrow(merge, f"shard long, {binary(6)}, sizes binary")
    sums = merged.groupBy("shard").applyInArrow(continuations, ", ".join(f"{n} long" for n in names)).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first().asDict()
    d = [discounts([sums[f"n{k}_{c}"] for c in (1, 2, 3, 4)]).tolist() for k in range(2, order + 1)]
    e = discounts([sums[f"c{k}"] for k in (1, 2, 3, 4)])
    rest = (e * [sums["c1"], sums["c2"], sums["m3"]]).sum() / max(1, sums["total"])
    return folder, bits, {"hot": hot, "d": d, "e": e.tolist(), "total": sums["total"], "base": rest / (sums["types"] + 1)}


class Model:
    """The arrays of a folder, each mapped when first looked at."""

    def __init__(self, folder: str, bits: int, known: dict):
        self.folder, self.bits, self.known, self.maps = folder, bits, known, {}
        self.words = Dictionary(folder, bits)
        self.e = np.array([0.0, *known["e"]])
        self.d = {k: np.array([0.0, *d]) for k, d in enumerate(known["d"], 2)}

    def find(self, name: str, place: np.ndarray, keys: np.ndarray, width: int = 1) -> np.ndarray:
        """Values of keys in the shards that their places choose, 0 where there are none."""
        shard = (place >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(place), np.int64)
        order = np.argsort(shard.astype(np.min_scalar_type(1 << self.bits)), kind="stable")
        out = np.zeros((len(keys), width), np.int64)
        sorted_shard = shard[order]
        starts = np.flatnonzero(np.append(True, sorted_shard[1:] != sorted_shard[:-1])) if len(order) else []
        for a, z in zip(starts, np.append(starts[1:], len(order)) if len(order) else []):
            which = int(sorted_shard[a]), name
            if which not in self.maps:
                path = f"{self.folder}/{which[0]}.{name}"
                self.maps[which] = Hashed(path) if os.path.exists(f"{path}.starts.npy") else None
            if self.maps[which] is not None:
                out[order[a:z]] = self.maps[which].find(keys[order[a:z]])
        return out if width > 1 else out[:, 0]

    def logs(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log P of each word after those before it in its document; that of the first is void."""
        word, place = self.words.distinct(hashes)
        seq, hot, key = word[place], self.known["hot"], key_of([word])
        shards = mix(key, 11)
        before = self.find("u", shards, key)
        p = ((before - self.e[np.minimum(before, 3)]) / max(1, self.known["total"]) + self.known["base"])[place]
        first = self.find("c2", shards, key, 4) + self.find("h2", shards, key, 4)
        at = np.arange(len(seq)) - np.repeat(starts, np.diff(np.append(starts, len(seq))))
        for k in range(2, max(self.d) + 1):
            own = np.flatnonzero(at >= k - 1)
            grams = [seq[own - k + 1 + j] for j in range(k)]
            n, d = self.find(f"g{k}", place_of(grams, hot), key_of(grams)), self.d[k]
            stats = first[place[own - 1]] if k == 2 else self.find(f"c{k}", place_of(grams, hot), key_of(grams[:-1]), 4)
            total = np.maximum(stats[:, 0], 1)
            spare = np.where(stats[:, 0] > 0, (stats[:, 1:] * d[1:]).sum(axis=1) / total, 1.0)
            p[own] = (n - d[np.minimum(n, 3)]) / total + spare * p[own]
        return np.log(p)


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """``docs`` with ``lm_words`` (long) and ``perplexity`` (double), by a model of all their own words.

    The model has n-grams of up to ``order`` words: words in lower case and the document's end, each after the words
    before it, as far back as the document's begin; modified Kneser-Ney discounts come from each length's counts of
    counts, and every n-gram is interpolated with the next shorter one, a word's continuation probability with a
    uniform one. Shorter n-grams count the words before them, at the begin their occurrences. Perplexity is over the
    words and the end. Texts that are null or without words have 0 words, a null perplexity and no part in the
    model. Every row counts, repeated ones too; ids aren't looked at; columns named as the results are
    replaced, all others stay; no rows give none. Words are known by 64-bit hashes, n-grams by hashes of 24 bits in a
    bucket of about four, so that one in some millions may be taken for another."""
    folder, bits, known = train(docs, order)
    most = SLICE

    @F.arrow_udf("double")
    def perplexity(hashes: pa.Array) -> pa.Array:
        model = once("lm-model", folder, lambda: Model(folder, bits, known))
        values, offsets = ragged(hashes)
        sizes = np.diff(offsets)
        some = np.flatnonzero(sizes > 0)
        out = np.full(len(sizes), np.nan)
        for a, b, seq, starts in sequences(np.asarray(values), np.append(offsets[some], offsets[-1]), most):
            logs = model.logs(seq, starts)
            logs[starts] = 0.0
            out[some[a:b]] = np.exp(-np.add.reduceat(logs, starts) / (sizes[some[a:b]] + 1))
        return pa.array(out, pa.float64(), mask=sizes == 0)

    h, p = fresh(docs, "hashes_", "perplexity_")
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.withColumn(h, F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))
    return put(hashed.withColumn(p, perplexity(F.col(f"`{h}`"))), {"lm_words": F.size(F.col(f"`{h}`")).cast("long"), "perplexity": F.col(f"`{p}`")}).drop(h, p)
