import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import toxic


def corpus(docs_of, labels_of, n=160):
    rng = random.Random(3)
    plain = ["river", "stone", "walk", "green", "light", "morning", "letter", "window", "garden", "paper", "summer", "voice"]
    stems = ["grumblik", "sporvax", "dreknol"]
    ends = ["", "er", "est", "ing", "ly", "ish", "oid", "ant"]
    rows, marks = [], {}
    for i in range(n):
        words = [rng.choice(plain) + rng.choice(["", "s", "ed"]) for _ in range(60)]
        if marks.setdefault(i, i % 4 == 0):
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(stems) + rng.choice(ends)
        rows.append((i, " ".join(words)))
    return docs_of(rows), labels_of([(i, 1, int(marks[i])) for i in range(n // 2)]), marks


def test_held_out_accuracy(docs_of, labels_of):
    docs, labels, marks = corpus(docs_of, labels_of)
    got = {r.doc_id: r.toxic for r in toxic.toxicity(docs, labels).collect() if r.doc_id >= 80}
    assert sum(got[i] == marks[i] for i in got) / len(got) >= 0.95


def counted(words):
    """Counts of all grams of words with (toxic, ordinary) counts."""
    out = {}
    for w, (t, o) in words.items():
        m = f"^{w}$"
        for end in range(2, len(m) + 1):
            for n in range(1, min(end, toxic.ORDER) + 1):
                x = out.setdefault(m[end - n : end], [0, 0])
                x[0] += t
                x[1] += o
    return out


WORDS = {"grumble": (5, 0), "grumbler": (1, 0), "garden": (2, 40), "gate": (0, 9), "letter": (1, 30), "let": (3, 3)}


def test_probabilities_sum_to_one():
    """Of every context: what is left to letters unseen after it is the backoff weight times their shared probability."""
    c = counted(WORDS)
    m = toxic.class_models(pa.array(list(c)), *np.array(list(c.values())).T)
    seen, p = toxic.shared_model(pa.array(list(c)))
    for name in ("toxic", "ordinary"):
        got, base = np.bincount(m["of"], m[name]), np.bincount(m["of"], m["base"])
        assert np.allclose(got + m[f"{name}_weight"] * (1 - base), 1)
    by_context = {}
    for g, q in zip(seen.to_pylist(), p):
        by_context.setdefault(g[:-1], []).append(q)
    n = Counter(g[1:] for g in c if len(g) > 1)
    d = toxic.discount(np.array(list(n.values())))
    assert abs(sum(by_context[""]) + d * len(by_context[""]) / sum(1 for g in c if len(g) == 2) / (len(by_context[""]) + 1) - 1) < 1e-9


def by_counts(n, modified=True):
    """Kneser-Ney discounts from counts of counts."""
    n1, n2, n3, n4 = (sum(x == k for x in n) for k in (1, 2, 3, 4))
    if not modified:
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
    if not (n1 and n2):
        return [0, 0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))]


class Brute:
    """The two models and their shared backoff by dictionaries, from words with their counts of toxic and ordinary documents."""

    def __init__(self, words):
        self.c = counted(words)
        self.before = Counter(g[1:] for g in self.c if len(g) > 1)
        self.d = by_counts(list(self.before.values()), False)
        self.letters = sum(len(g) == 1 for g in self.before)
        whole = {g: x for g, x in self.c.items() if len(g) > 1 and (len(g) == toxic.ORDER or g[0] == "^")}
        self.of, self.by = {}, [by_counts([x[k] for x in whole.values()]) for k in (0, 1)]
        for g, x in whole.items():
            self.of.setdefault(g[:-1], {})[g] = x
        self.after = {}
        for g, n in self.before.items():
            self.after.setdefault(g[:-1], []).append(n)

    def shared(self, gram):
        """P of the last letter by continuation counts, backed off to one letter less, at last to all letters and one unknown."""
        below = self.shared(gram[1:]) if len(gram) > 1 else 1 / (self.letters + 1)
        n = self.after.get(gram[:-1])
        return below if n is None else (max(self.before.get(gram, 0) - self.d, 0) + self.d * len(n) * below) / sum(n)

    def ratio(self, word):
        total, marked = 0.0, f"^{word}$"
        for end in range(2, len(marked) + 1):
            gram = marked[max(0, end - toxic.ORDER) : end]
            if gram[:-1] not in self.of:
                continue  # nothing is left of the ratio
            p = []
            for k in (0, 1):
                n = [x[k] for x in self.of[gram[:-1]].values()]
                d = lambda x, k=k: self.by[k][min(x, 3)]
                mine = self.of[gram[:-1]].get(gram, (0, 0))[k]
                spare = sum(map(d, n)) / sum(n) if sum(n) else 1.0
                p.append((mine - d(mine)) / max(1, sum(n)) + spare * self.shared(gram[1:]))
            total += math.log(p[0] / p[1])
        return math.log(1 - toxic.SHARE + toxic.SHARE * math.exp(total))


def test_ratio_by_definition(tmp_path):
    c = counted(WORDS)
    toxic.save(pa.table({"gram": list(c), "t": [x[0] for x in c.values()], "o": [x[1] for x in c.values()]}), str(tmp_path / "m"))
    m, brute = toxic.Models.load(str(tmp_path / "m")), Brute(WORDS)
    for word in (*WORDS, "grumbling", "gardener", "zzz", "g", "le"):
        assert abs(m.ratio(word) - brute.ratio(word)) < 1e-9, word
    assert m.ratio("grumbling") > m.ratio("garden") and m.score(None) is None and m.score("!!") is None


def test_scores_by_brute_force(spark, docs_of, labels_of):
    """From labelled texts to every document's score."""
    docs, labels, _ = corpus(docs_of, labels_of)
    held = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(toxic.HELD_OUT)) == 0).collect()}
    mark, texts, words = {r.doc_id: r.toxic for r in labels.collect()}, {r.doc_id: r.text for r in docs.collect()}, {}
    for i in set(mark) - held:
        for w in set(texts[i].split()):
            words.setdefault(w, [0, 0])[1 - mark[i]] += 1
    brute = Brute(words)
    for r in toxic.toxicity(docs, labels).collect():
        each = [brute.ratio(w) for w in r.text.split()]
        assert abs(r.toxic_score - sum(each) / len(each)) < 1e-9


def test_far_scores_do_not_saturate():
    m = toxic.Models({"^a": 700.0, "^b": 800.0, "a$": 0.0})
    assert math.isfinite(m.ratio("a")) and m.ratio("b") > m.ratio("a") > 600


def test_odd_rows(odd, docs_of, labels_of):
    df = odd.withColumn("toxic", F.lit(5)).withColumn("toxic_score", F.lit("s")).withColumn("toxic_score_", F.lit(0))
    labels = labels_of([(1, 1, 1), (4, 1, 0), (None, 0, 1), (6, 1, None)])
    out = toxic.toxicity(df, labels).collect()
    assert len(out) == 10 and [(r.toxic, r.toxic_score) for r in out if r.text in (None, "", "!!!")] == [(False, None)] * 4
    assert len({r.toxic_score for r in out if r.text and r.text.startswith("the cat")}) == 1
    assert not any(r.toxic for r in toxic.toxicity(odd, labels_of([])).collect())
    assert toxic.toxicity(docs_of([]), labels).collect() == []
