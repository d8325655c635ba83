"""MinHash near-dedup: one-bit signatures joined by multi-index Hamming search, and groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, let, ragged, slim, table, words
from quern.llm.components import components
from quern.llm.lines import mix

#: Signature bits, in chunks of 32; a chunk may differ in RADIUS bits: each side lists its chunk with up to one bit flipped.
BITS, CHUNKS, RADIUS = 128, 4, 2
#: The largest distance that the chunks guarantee: a pair that differs in 3 bits or more of all 4 chunks differs in 12.
DISTANCE = CHUNKS * (RADIUS + 1) - 1
#: Runs longer than this are joined to groups where they lie, not listed pair by pair.
RUN = 64
_rng = np.random.default_rng(20_240_607)
_A = (_rng.integers(0, 2**32, BITS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, BITS, dtype=np.uint64).astype(np.uint32)
_SHIFT = np.arange(32, dtype=np.uint64)


def shingles(text: Column) -> Column:
    """Hashes of the distinct words in lower case; of the whole text where it has no word; none for an empty one."""
    return let(F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))), lambda a: F.when(F.size(a) > 0, a).when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(a))


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n, 2) uint64: a bit of each of 128 minima."""
    minima = np.full((len(offsets) - 1, BITS), 0xFFFFFFFF, np.uint32)
    x = (values.view(np.uint64) >> np.uint64(16)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for s in range(a, b, 2048):
                block = np.multiply.outer(x[s : min(s + 2048, b)], _A)
                block += _B
                np.minimum(minima[k], block.min(axis=0), out=minima[k])
    bits = (mix(minima.ravel().astype(np.uint64), 77) >> np.uint64(63)).astype(np.uint8).reshape(minima.shape)
    return np.packbits(bits, axis=1).view(np.uint64)


def signed(hashes: pa.Array) -> pa.Array:
    values, offsets = ragged(hashes)
    out = signatures(np.asarray(values), offsets)
    none = np.diff(offsets) == 0
    slim()
    return pa.StructArray.from_arrays([pa.array(out[:, k].view(np.int64)) for k in (0, 1)], ["hi", "lo"], mask=pa.array(none))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int32) + np.bitwise_count(a[..., 1] ^ b[..., 1])


def chunk_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    low = np.uint64(0xFFFFFFFF)
    return np.stack([np.bitwise_count(x[:, 0] >> np.uint64(32)), np.bitwise_count(x[:, 0] & low), np.bitwise_count(x[:, 1] >> np.uint64(32)), np.bitwise_count(x[:, 1] & low)], axis=1)


def links_here(sig: np.ndarray, node: np.ndarray, tag: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """How many of the rows ``j`` of a run are near each of the rows ``i`` and meet it at this chunk and key by the rule of run_pairs."""
    first, fi, fj = node[i][:, None] < node[j][None], tag[i][:, None] % 33, tag[j][None] % 33
    here = (np.where(first, fi < fj, fj < fi) | ((fi == 0) & (fj == 0))) & (node[i][:, None] != node[j][None])
    a, b = np.nonzero(here & (distance(sig[i][:, None], sig[j][None]) <= most))
    a = a[np.argmax(chunk_distances(sig[i[a]], sig[j[b]]) <= RADIUS, axis=1) == tag[i[a]] // 33]
    return np.bincount(a, minlength=len(i))


def run_edges(sig: np.ndarray, node: np.ndarray, tag: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges that join the members of a run as all its pairs within ``most`` would, and how many of these pairs each member has that count here.

    ``tag`` says for each row which bit is flipped; of a pair that meets at several keys one key counts, that at which the
    node of lower number has the lower flip."""
    n = len(node)
    label, links = np.arange(n), np.zeros(n, np.int64)
    for a in range(0, n, 256):
        i = np.arange(a, min(a + 256, n))
        for b in range(0, n, 4096):
            links[i] += links_here(sig, node, tag, i, np.arange(b, min(b + 4096, n)), most)
    while True:
        before = label.copy()
        for s in range(0, n, 256):
            near = distance(sig[s : s + 256, None, :], sig[None, :, :]) <= most
            best = np.where(near, label[None, :], n).min(axis=1)
            label[s : s + 256] = np.minimum(label[s : s + 256], best)
            reached = np.where(near, best[:, None], n).min(axis=0)
            label = np.minimum(label, reached)
        label = label[label]
        if (label == before).all():
            other = label != np.arange(n)
            return node[other], node[label[other]], links


def run_pairs(keys: np.ndarray, sig: np.ndarray, node: np.ndarray, tag: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, links of u, links of v) among rows of equal key, which are sorted by it: a pair within ``most`` gives a row by one
    chunk and one key only, with a link for both; a run of over RUN rows gives edges without links, and its members' links."""
    us, vs, mine, theirs = [], [], [], []

    def add(u, v, m, t):
        us.append(u), vs.append(v), mine.append(np.broadcast_to(m, u.shape)), theirs.append(np.broadcast_to(t, u.shape))

    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(keys)))
    for s, n in zip(starts[lengths > RUN].tolist(), lengths[lengths > RUN].tolist()):
        u, v, links = run_edges(sig[s : s + n], node[s : s + n], tag[s : s + n], most)
        add(u, v, 0, 0)
        some = links > 0
        add(node[s : s + n][some], node[s : s + n][some], links[some], 0)
    short = (lengths <= RUN) & (lengths > 1)
    rank = np.arange(len(keys)) - np.repeat(starts, lengths)
    left = np.repeat(np.where(short, lengths, 0), lengths) - rank  # rows of the run from here on
    for lag in range(1, int(lengths[short].max(initial=1))):
        i = np.flatnonzero(left > lag)
        j = i + lag
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        fi, fj = tag[i] % 33, tag[j] % 33
        ok = (fi < fj) | ((fi == 0) & (fj == 0))
        i, j = i[ok], j[ok]
        ok = distance(sig[i], sig[j]) <= most
        i, j = i[ok], j[ok]
        ok = np.argmax(chunk_distances(sig[i], sig[j]) <= RADIUS, axis=1) == tag[i] // 33
        add(node[i[ok]], node[j[ok]], 1, 1)
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return join(us), join(vs), join(mine), join(theirs)


def signed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo), written; without documents of null id, and null for those without text."""
    sign = F.arrow_udf(signed, "struct<hi:bigint,lo:bigint>")
    s = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), sign(F.coalesce(shingles(F.col("text")), F.array().cast("array<long>"))).alias("s"))
    return table(s.select("doc_id", "s.hi", "s.lo"), "signatures")


def near_edges(nodes: DataFrame, most: int = DISTANCE) -> DataFrame:
    """(u, v, mine, theirs) between distinct signatures (node, hi, lo): edges that connect all pairs of distance up to ``most``, and
    shares of the number of such pairs that u and v are in; a row of u alone has shares only.

    Pigeonhole: such a pair differs in at most two bits of one of the four chunks. Both list each chunk as it is
    and with every single bit flipped, so they meet at a key whose chunk lies between theirs. Rows of one key
    come together in one shuffle; their true distance decides."""
    if most > DISTANCE:
        raise ValueError(f"the chunks guarantee distances up to {DISTANCE}")
    tag = "CAST(place % 256 AS INT)"
    chunk = F.expr(f"CASE CAST({tag} / 33 AS INT) WHEN 0 THEN shiftrightunsigned(hi, 32) WHEN 1 THEN hi & 4294967295L WHEN 2 THEN shiftrightunsigned(lo, 32) ELSE lo & 4294967295L END")
    flip = F.expr(f"CASE WHEN {tag} % 33 = 0 THEN 0L ELSE shiftleft(1L, {tag} % 33 - 1) END")
    key = F.expr(f"shiftleft(CAST({tag} / 33 AS BIGINT), 32)").bitwiseOR(chunk.bitwiseXOR(flip))
    # node and tag in one number and the signature are all that is shuffled; the key is made again from them
    tags = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(33 * CHUNKS - 1).cast("long")))
    rows = nodes.select("node", "hi", "lo", tags.alias("tag")).select((F.col("node") * 256 + F.col("tag")).alias("place"), "hi", "lo")
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * 33 * CHUNKS // 1_000_000)

    def join(batches):
        got = [[b.column(k).to_numpy() for k in range(4)] for b in batches]
        if not got:
            return
        place, hi, lo, keys = (np.concatenate([g[k] for g in got]) for k in range(4))
        del got
        node, tag = place >> 8, (place & 255).astype(np.int32)
        again = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        again[1:] |= same
        again[:-1] |= same
        sig = np.stack([hi[again].view(np.uint64), lo[again].view(np.uint64)], axis=1)
        u, v, mine, theirs = run_pairs(keys[again], sig, node[again], tag[again], most)
        del place, hi, lo, keys, node, tag, sig, again, same
        slim()
        yield pa.RecordBatch.from_pydict({"u": u, "v": v, "mine": mine, "theirs": theirs})

    return rows.repartition(parts, key).withColumn("key", key).sortWithinPartitions("key").mapInArrow(join, "u long, v long, mine long, theirs long")


def classes(docs: DataFrame, most: int = DISTANCE) -> DataFrame:
    """(doc_id, class_id, links, is_copy): one row a document.

    Two documents are near copies if their signatures, a bit of each of 128 minima over the distinct words in
    lower case, differ in at most ``most`` bits (11: a Jaccard index of about 0.83). Classes are the connected
    components, named by their least doc_id; the others are copies. ``links`` is how many other signatures are within
    the distance of the document's own, whether or not they are listed pair by pair. Equal signatures are one node, so exact
    copies cost nothing more, and neither do they count as links; the order of rows doesn't matter. A text without
    words is its own shingle; null and empty texts are classes of their own, without links, and rows of null id have no
    row. Rows of one doc_id are one document: it is in the class of least id, has the most links of its rows, and never is
    a copy of itself. Very long texts are taken whole; other columns don't matter. No rows give none."""
    signs = signed_documents(docs)
    nodes = table(signs.where("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = table(near_edges(nodes, most), "near")
    roots = components(edges)
    shares = edges.select("u", "mine").unionByName(edges.select(F.col("v").alias("u"), F.col("theirs").alias("mine"))).where("mine > 0")
    links = shares.groupBy(F.col("u").alias("node")).agg(F.sum("mine").alias("links"))
    rooted = nodes.join(roots, "node", "left").join(links, "node", "left").select("hi", "lo", "least", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    of = rooted.join(named, "root").select("hi", "lo", "class_id", "links")
    each = signs.join(of, ["hi", "lo"], "left").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
    return each.select("doc_id", F.least("doc_id", "class_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")).withColumn("is_copy", F.col("class_id") < F.col("doc_id"))


def duplicates(docs: DataFrame, most: int = DISTANCE) -> DataFrame:
    """(doc_id, kept_id): every copy that ``classes`` names, and the document of its class that stays."""
    return classes(docs, most).where("is_copy").select("doc_id", F.col("class_id").alias("kept_id"))


def kept(docs: DataFrame, most: int = DISTANCE) -> DataFrame:
    """``docs`` without the copies that ``classes`` names."""
    (g,) = fresh(docs, "gone_")
    gone = duplicates(docs, most).select(F.col("doc_id").alias(g))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(g), "left_anti")
