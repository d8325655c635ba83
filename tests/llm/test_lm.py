import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import lm


def brute(texts):
    """Interpolated modified Kneser-Ney of bigrams by dictionaries."""
    seqs = {i: ["<s>", *re.findall(r"[^\W_]+", t.lower()), "</s>"] for i, t in texts.items() if t and re.search(r"[^\W_]", t)}
    pairs = Counter(p for s in seqs.values() for p in zip(s, s[1:]))
    total, kinds, before = Counter(), defaultdict(Counter), Counter()
    for (v, w), n in pairs.items():
        total[v] += n
        kinds[v][min(n, 3)] += 1
        before[w] += 1
    d = [0, *lm.discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)])]
    e = [0, *lm.discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)])]
    all_ = sum(before.values())
    base = sum(e[min(n, 3)] for n in before.values()) / all_ / (len(before) + 1)
    out = {}
    for i, s in seqs.items():
        logs = 0.0
        for v, w in zip(s, s[1:]):
            p = (before[w] - e[min(before[w], 3)]) / all_ + base
            spare = sum(d[k] * c for k, c in kinds[v].items()) / total[v]
            logs += math.log((pairs[v, w] - d[min(pairs[v, w], 3)]) / total[v] + spare * p)
        out[i] = math.exp(-logs / (len(s) - 1))
    return out


TEXTS = {i: " ".join(f"w{(i * k * k + k) % 23} the" if k % 3 else f"w{k % 5}" for k in range(1, 12 + i % 9)) for i in range(60)} | {60: None, 61: "", 62: "!!", 63: "w1", 64: "w1 w1 w1 w1"}


@pytest.mark.parametrize("size", [1_000_000, 50])
def test_brute_force(docs_of, monkeypatch, size):
    monkeypatch.setattr(lm, "SLICE", size)
    want = brute(TEXTS)
    got = {r.doc_id: r.perplexity for r in lm.score(docs_of(list(TEXTS.items()))).collect()}
    assert set(got) == set(TEXTS)
    for i, p in got.items():
        assert (p is None) == (i not in want) and (p is None or abs(p - want[i]) < 1e-9 * want[i])


def test_discounts_grow():
    import numpy as np

    d = lm.discounts(np.array([40, 12, 6, 3]))
    assert (d > 0).all() and d[0] < d[1] < d[2]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_sum_to_one(spark, docs_of, order):
    """Over all known words, the end and one unknown word, after known contexts and unknown ones."""
    import numpy as np

    docs = docs_of(list(TEXTS.items()))
    model = lm.Model(*lm.train(docs, order))
    known = sorted({w for t in TEXTS.values() if t for w in re.findall(r"[^\W_]+", t.lower())} | {"unheard"})
    hashes = dict(spark.createDataFrame([(w,) for w in known], "w string").select("w", F.xxhash64("w")).collect())
    words = [np.int64(h).view(np.uint64) for h in hashes.values()] + [lm.END]
    of = lambda *ws: [np.int64(hashes[w]).view(np.uint64) for w in ws]
    for context in ([lm.BEGIN], [lm.BEGIN, *of("w1")], of("w1", "the"), of("the", "w2", "the"), of("unheard", "the"), of("unheard", "unheard", "unheard")):
        total = sum(math.exp(model.logs(np.array([*context, w], np.uint64), np.array([0]))[-1]) for w in words)
        assert abs(total - 1) < 1e-9, context


def test_numbers_as_bytes():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        x = rng.integers(0, 1 << 40, n).astype(np.uint64) >> rng.integers(0, 40, n).astype(np.uint64)
        assert (lm.unpacked(lm.packed(x)) == x).all()
        for k in (1, 2, 3, 4):
            grams, c = lm.summed([rng.integers(0, 9, n).astype(np.uint64) for _ in range(k)], np.ones(n, np.int64))
            got = lm.gram_columns(__import__("pyarrow").Table.from_batches([lm.gram_blobs((grams[0] % 3).astype(np.int64), grams, c)]), k, 1)
            assert sorted(zip(*got)) == sorted(zip(*grams, c)) and c.sum() == n


def test_hash_arrays(tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        values = np.stack([rng.integers(0, 900, len(keys)), rng.integers(0, 2, len(keys))], axis=1)  # more kinds than a byte has
        lm.save_hashed(f"{tmp_path}/{n}", keys, values)
        got = lm.Hashed(f"{tmp_path}/{n}")
        assert (got.find(keys) == values).all() and not got.find(rng.integers(0, 2**64, 200, dtype=np.uint64)).any()


def test_odd_rows(odd, docs_of):
    df = odd.withColumn("perplexity", F.lit("x")).withColumn("lm_words", F.lit("y")).withColumn("hashes_", F.lit(1))
    out = lm.score(df).collect()
    assert len(out) == 10 and [r.perplexity for r in out if r.text in (None, "", "!!!")] == [None] * 4
    assert {r.lm_words for r in out if r.text in (None, "", "!!!")} == {0}
    assert len({r.perplexity for r in out if r.text and r.text.startswith("the cat")}) == 1
    assert next(r.lm_words for r in out if r.doc_id == 4) == 80_000
    assert lm.score(docs_of([])).collect() == [] and lm.score(docs_of([(1, None)])).first().perplexity is None


def test_hot_words_are_spread(docs_of, monkeypatch, tmp_path):
    """A word of a great share and the documents' begin are hot; the model is the same wherever their bigrams lie."""
    import numpy as np

    monkeypatch.setattr(lm, "HOT", 0.015)
    docs = docs_of(list(TEXTS.items()))
    size, hot = lm.dictionary(docs, f"{tmp_path}/words", 2)
    ids = lm.Dictionary(f"{tmp_path}/words", 2).ids(np.array([lm.BEGIN, lm.END, np.uint64(77)]))
    assert ids[0] < hot and ids[2] == size + 1 and 2 <= hot <= 67
    want = brute(TEXTS)
    got = {r.doc_id: r.perplexity for r in lm.score(docs).collect() if r.perplexity is not None}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 * want[i] for i in want)


@pytest.mark.parametrize("order", [2, 3, 5, 20])
def test_counted(order):
    """N-grams packed into one number, or too long for that, against a counter."""
    import numpy as np

    rng = np.random.default_rng(order)
    ids = rng.permutation(1000)[:40].astype(np.uint64)
    place, starts = rng.integers(0, 40, 500), np.array([0, 3, 4, 200])
    grams, n = lm.counted(ids, place, starts, order, 1000)
    seq, want = ids[place].tolist(), Counter()
    for a, z in zip([0, 3, 4, 200], [3, 4, 200, 500]):
        doc = seq[a:z] + [1000] * max(0, order - z + a)
        want.update(tuple(doc[k : k + order]) for k in range(len(doc) - order + 1))
    assert dict(zip(zip(*(g.tolist() for g in grams)), n.tolist())) == want
