import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from quern.llm import bpe

PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def ranks():
    return bpe.RankMap(bpe.load_ranks())


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=PLAIN, mergeable_ranks=ranks.ranks, special_tokens={})


def test_same_ids_and_round_trip(spark, docs_of, ranks, theirs):
    texts = ["", "a", "hello world", "It's  a   test\n\n\tof spaces  ", "übergrößenträger naïve", "日本語のテキスト", "😀😀 emoji", "1234567 890", "<|endoftext|>", "x" * 300, "don't we'll I'd", "\r\n\r\n", "\x00\x01\x85  a", " " * 50, "aaaaaaaaaaaaaaa!!!!!!!!!!!!!!"]
    out = bpe.encode(docs_of(list(enumerate(texts))), ranks)
    rows = {r.doc_id: (r.ids, r.back) for r in out.select("doc_id", "ids", bpe.decode(F.col("ids"), ranks).alias("back")).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == (theirs.encode_ordinary(t), t)


def test_odd_rows(spark, odd, ranks, theirs):
    df = odd.withColumn("ids", F.lit("old")).withColumn("ids_", F.lit(1))
    out = bpe.encode(df, ranks, shard_words=4)  # several shards
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids_", "ids"] and out.count() == odd.count()
    for r in out.collect():
        assert r.ids == (None if r.text is None else theirs.encode_ordinary(r.text))


def test_empty_table(docs_of, ranks):
    assert bpe.encode(docs_of([]), ranks).collect() == []


def test_very_long_words(docs_of, ranks, theirs):
    """Letters, digits, marks and spaces without an end; above and below the length at which a heap takes over."""
    rng = random.Random(3)
    texts = [c * n for c in ("x", "7", "!", "ab", "e\u0301") for n in (999, 1000, 1001, 20_000)] + ["".join(rng.choice("aeinrst") for _ in range(20_000)), " " * 30_000 + "a", "b\n" + "\t" * 5_000, "x" * 500_000]
    for r in bpe.encode(docs_of(list(enumerate(texts))), ranks).collect():
        assert r.ids == (theirs.encode_ordinary(r.text) if " " * 2_000 not in r.text else [*bpe.heap_merged(r.text[:29_999].encode(), ranks.ranks), *theirs.encode_ordinary(" a")])


def test_heap_and_counts_agree(docs_of, ranks, theirs):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeinrst  \n19!'s") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " " * 4_000 + "end", "x\n" + "\r\n" * 3_000]
    assert all(bpe.heap_merged(w.encode(), ranks.ranks) == theirs._encode_single_piece(w) for t in texts[:300] for w in t.split())
    docs = docs_of(list(enumerate(texts)))
    counts = {r.doc_id: r.n for r in docs.select("doc_id", bpe.n_tokens(F.col("text"), ranks.ranks).alias("n")).collect()}
    assert counts == {r.doc_id: None if r.ids is None else len(r.ids) for r in bpe.encode(docs, ranks).collect()}


def test_words_that_share_a_hash(docs_of, monkeypatch, ranks, theirs):
    monkeypatch.setattr(bpe, "word_hash", lambda w, seed=0: F.pmod(F.xxhash64(w), F.lit(16)))
    texts = [" ".join(f"word{i} other{i * 7}" for i in range(k, k + 5)) for k in range(6)]
    for r in bpe.encode(docs_of(list(enumerate(texts))), ranks).collect():
        assert r.ids == theirs.encode_ordinary(r.text)
