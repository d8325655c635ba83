import math
import re
from collections import Counter, defaultdict

import pytest

from quern.llm import lm, queries
from tests.llm.test_lm import TEXTS


def brute(texts, order):
    """Interpolated modified Kneser-Ney of n-grams of up to ``order`` words by dictionaries."""
    seqs = {i: ("<s>", *re.findall(r"[^\W_]+", t.lower()), "</s>") for i, t in texts.items() if t and re.search(r"[^\W_]", t)}
    plain = {k: Counter(s[a : a + k] for s in seqs.values() for a in range(len(s) - k + 1)) for k in range(1, order + 1)}
    counts = {order: plain[order]}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in plain[k + 1])
        counts[k].update({g: n for g, n in plain[k].items() if g[0] == "<s>" and k > 1})
    d = {k: [0, *lm.discounts([sum(n == c for n in counts[k].values()) for c in (1, 2, 3, 4)])] for k in counts}
    total, kinds = Counter(), defaultdict(Counter)
    for k in counts:
        for g, n in counts[k].items():
            total[k, g[:-1]] += n
            kinds[k, g[:-1]][min(n, 3)] += 1

    def p(context, w):
        k = len(context) + 1
        n, all_ = counts[k][(*context, w)], total[k, context]
        lower = p(context[1:], w) if context else 1 / (len(counts[1]) + 1)
        return (n - d[k][min(n, 3)]) / all_ + sum(d[k][c] * m for c, m in kinds[k, context].items()) / all_ * lower

    return {i: math.exp(-sum(math.log(p(s[max(0, a - order + 1) : a], s[a])) for a in range(1, len(s))) / (len(s) - 1)) for i, s in seqs.items()}


@pytest.mark.parametrize("order, size, hot", [(2, 1_000_000, 0.001), (3, 1_000_000, 0.001), (3, 50, 0.05), (5, 1_000_000, 0.05)])
def test_brute_force(docs_of, monkeypatch, order, size, hot):
    monkeypatch.setattr(lm, "SLICE", size)
    monkeypatch.setattr(lm, "HOT", hot)
    want = brute(TEXTS, order)
    got = {r.doc_id: r.perplexity for r in lm.score(docs_of(list(TEXTS.items())), order).collect() if r.perplexity is not None}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 * want[i] for i in want)


def test_query_sees_beyond_one_word(spark, docs_of, tmp_path):
    """The query scores by n-grams of three words or more."""
    docs_of(list(TEXTS.items())).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(TEXTS, lm.ORDER)
    got = {r.doc_id: r.perplexity for r in queries.op5_lm_scoring(spark, str(tmp_path)).collect() if r.perplexity is not None}
    assert lm.ORDER >= 3 and got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 * want[i] for i in want)
