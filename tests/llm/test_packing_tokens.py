import re
from collections import Counter

import corpus_pipeline
from quern.llm import bpe, queries

TEXTS = {1: "the cat sat on the mat", 2: "Überraschungsgäste fraßen Käsespätzle", 3: "x9 7f-$%& zqxj " * 3000, 4: "ééé 中文 \U0001f600", 5: None, 6: "", 7: "\n\n  a"}


def n_tokens(text, ranks):
    """Tokens of a text by plain byte-pair merges, and one for the end."""
    total = 1
    for word in re.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+", text):
        parts = [bytes([b]) for b in word.encode()]
        while True:
            best = min((ranks.get(a + b, 1 << 31), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (1 << 31, 0)
            if best[0] == 1 << 31:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        total += len(parts)
    return total


def test_lengths_are_those_of_the_tokenizer(spark, docs_of, tmp_path):
    """The query and the pipeline's stage fill windows with tokens, not with bytes over four."""
    docs = docs_of(list(TEXTS.items()))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ranks = bpe.load_ranks()
    want = {i: n_tokens(t, ranks) for i, t in TEXTS.items() if t}
    assert want[3] > 16384
    for out in (queries.op10_packing(spark, str(tmp_path)), corpus_pipeline.windows(spark, docs, str(tmp_path))):
        got = Counter()
        for r in out.collect():
            got[r.doc_id] += r.n_tokens
            assert r.offset + r.n_tokens <= r.tier
        assert got == want
