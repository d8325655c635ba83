"""Toxicity: class-conditional Kneser-Ney models of words' letters, over shared backoff counts."""

from __future__ import annotations

import os
import re
import uuid
from math import exp, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, once, posix, put, shared_folder, words
from quern.llm.lm import discounts as kneser_ney
from quern.llm.quality import labelled_sample

#: Letters of a context and the one after it; contexts begin at the word's start, marked "^", and "$" ends it.
ORDER = 6
#: At most so many labelled documents, those of least hash, train the models and set the threshold.
LABELLED = 20_000
#: Share of a toxic document's words that its own model draws; the others are ordinary.
SHARE = 0.02
#: One labelled document of so many is held out from the models and sets the threshold.
HELD_OUT = 4
#: Words whose scores a worker remembers at once.
MEMORY = 300_000
_WORD = re.compile(r"[^\W_]+")


def discounts(c: np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney takes from each of these counts, by how many of them are 1, 2, 3 and 4."""
    d = kneser_ney(np.array([(c == k).sum() for k in (1, 2, 3, 4)]))
    return np.select([c == 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])


def discount(n: np.ndarray) -> float:
    """The one discount of plain Kneser-Ney, from how many counts are 1 and 2."""
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.75


def _cut(grams: pa.Array, first: int, last: int | None) -> pa.Array:
    return pc.utf8_slice_codeunits(grams, first, last) if last is not None else pc.utf8_slice_codeunits(grams, first)


def _codes(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = pc.dictionary_encode(strings)
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def shared_model(grams: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Grams of up to ORDER - 1 letters and the Kneser-Ney probabilities of their last ones, from both classes' continuation counts."""
    code, seen = _codes(_cut(grams.filter(pc.greater(pc.utf8_length(grams), 1)), 1, None))
    n = np.bincount(code, minlength=len(seen)).astype(float)  # distinct letters before each
    size = pc.utf8_length(seen).to_numpy(zero_copy_only=False)
    context, contexts = _codes(_cut(seen, 0, -1))
    total, types = np.bincount(context, n, len(contexts)), np.bincount(context, minlength=len(contexts))
    lower = pc.index_in(_cut(seen, 1, None), value_set=seen).fill_null(-1).to_numpy(zero_copy_only=False)
    p, d = np.zeros(len(seen)), discount(n)
    for length in range(1, ORDER):
        at = size == length
        below = p[lower[at]] if length > 1 else 1.0 / ((size == 1).sum() + 1)
        p[at] = (np.maximum(n[at] - d, 0) + d * types[context[at]] * below) / total[context[at]]
    return seen, p


def class_models(grams: pa.Array, t: np.ndarray, o: np.ndarray) -> dict:
    """Whole grams, of ORDER letters or from a word's start, with both classes' probabilities, and the contexts' backoff weights."""
    seen, shared = shared_model(grams)
    whole = pc.and_(pc.greater(pc.utf8_length(grams), 1), pc.or_(pc.equal(pc.utf8_length(grams), ORDER), pc.starts_with(grams, "^")))
    own, at = grams.filter(whole), whole.to_numpy(zero_copy_only=False)
    code, contexts = _codes(_cut(own, 0, -1))
    base = shared[pc.index_in(_cut(own, 1, None), value_set=seen).to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0)
    out = {"gram": own, "context": contexts, "base": base, "of": code}
    for name, count in (("toxic", t[at].astype(float)), ("ordinary", o[at].astype(float))):
        total, mass = np.bincount(code, count, len(contexts)), np.bincount(code, discounts(count), len(contexts))
        weight = np.where(total > 0, mass / np.maximum(total, 1), 1.0)
        out[name] = np.where(total[code] > 0, (count - discounts(count)) / np.maximum(total[code], 1), 0.0) + weight[code] * base
        out[f"{name}_weight"] = weight
    return out


class Models:
    """log P(letter | context, toxic) - log P(letter | context, ordinary): by gram where it is known, else by its context.

    A letter that neither class has seen after a known context has the shared model's probability times each
    class's backoff weight, so the shared part falls out of the ratio; after an unknown one nothing is left."""

    def __init__(self, steps: dict[str, float]):
        self.steps, self.known = steps, {}

    @classmethod
    def load(cls, path: str) -> Models:
        with pa.memory_map(path) as f:
            table = pa.ipc.open_file(f).read_all()
        return cls(dict(zip(table["key"].to_pylist(), table["ratio"].to_pylist())))

    def ratio(self, word: str) -> float:
        """log P(word | toxic document) - log P(word | ordinary one)."""
        marked, get, r = f"^{word}$", self.steps.get, 0.0
        for end in range(2, len(marked) + 1):
            gram = marked[max(0, end - ORDER) : end]
            s = get(gram)
            r += get(gram[:-1] + "\0", 0.0) if s is None else s
        a, b = log(1 - SHARE), log(SHARE) + r
        r = max(a, b) + log1p(exp(-abs(a - b)))
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[word] = r
        return r

    def score(self, text: str | None) -> float | None:
        """Difference of the two log-likelihoods a word; None without words."""
        if text is None or not (found := _WORD.findall(text.lower())):
            return None
        known, ratio = self.known.get, self.ratio
        total = 0.0
        for w in found:
            r = known(w)
            total += ratio(w) if r is None else r
        return total / len(found)


def save(table: pa.Table, path: str) -> None:
    m = class_models(table["gram"].combine_chunks(), table["t"].to_numpy(), table["o"].to_numpy())
    keys = pa.concat_arrays([m["gram"], pc.binary_join_element_wise(m["context"], "\0", "")])
    ratios = np.concatenate([np.log(m["toxic"]) - np.log(m["ordinary"]), np.log(m["toxic_weight"]) - np.log(m["ordinary_weight"])])
    out = pa.table({"key": keys, "ratio": ratios})
    part = f"{path}.{uuid.uuid4().hex[:8]}"
    with pa.OSFile(part, "wb") as f, pa.ipc.new_file(f, out.schema) as w:
        w.write_table(out)
    os.replace(part, path)


def threshold(scores: pd.DataFrame) -> float:
    """The score that best parts toxic from ordinary documents (true less false positive rate), midway to the next one below."""
    toxic, plain = (np.sort(scores.s[scores.toxic == k].to_numpy()) for k in (1, 0))
    if not len(toxic):
        return float("inf")
    if not len(plain):
        return float(toxic[0])
    at = np.unique(toxic)
    gain = (1 - np.searchsorted(toxic, at) / len(toxic)) - (1 - np.searchsorted(plain, at) / len(plain))
    best = at[int(np.flatnonzero(gain == gain.max())[-1])]
    below = plain[: np.searchsorted(plain, best)]
    return float((best + below[-1]) / 2 if len(below) else best)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[str, float]:
    """The file of the models and the threshold. Counts are made in Spark on the labelled sample; what the driver gets is bounded by ``labelled``."""
    sample = labelled_sample(labels, "toxic", labelled, docs).collect()
    known = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in sample], "__id long, toxic int")
    known = known.withColumn("held", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(HELD_OUT)) == 0)
    marked = docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("text")).join(F.broadcast(known), F.col("__doc") == F.col("__id")).select("__doc", "toxic", "held", "text")
    each = marked.where("not held").select("toxic", F.explode(F.array_distinct(words(F.lower("text")))).alias("word")).groupBy("word")
    each = each.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") == 0, 1)).alias("o"))
    word = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    ends = F.sequence(F.lit(2), F.length(word))
    grams = F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(1), F.least(e, F.lit(ORDER))), lambda n: F.substring(word, e - n + 1, n))))
    counted = each.select(F.explode(grams).alias("gram"), "t", "o").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    path = f"{posix(shared_folder(docs.sparkSession, 'toxic'))}/models.arrow"
    save(counted.toArrow(), path)
    # a row a labelled id, of several rows the least score; a filter on scores would go below the join and score every document
    scores = scored(marked, path, "s").groupBy("__doc", "toxic", "held").agg(F.min("s").alias("s")).toPandas().dropna()
    apart = scores[scores.held]
    return path, threshold(apart if (apart.toxic == 1).any() and (apart.toxic == 0).any() else scores)


def scored(docs: DataFrame, path: str, name: str) -> DataFrame:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        models = once("toxic", path, lambda: Models.load(path))
        return pa.array([models.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(name, score(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """``docs`` with ``toxic_score`` (double) and ``toxic`` (boolean).

    Each class has a model of words letter by letter, counted by the labelled documents that have a word; where
    a class has no counts both fall back to the same Kneser-Ney model of all counts, so that what neither class
    knows says nothing, and an inflected insult counts by its stem. A toxic document is taken as ordinary words
    with a SHARE of toxic ones. The score is the difference of the log-likelihoods divided by the number of
    words; from the threshold on, which documents held out from the models set, a document is toxic. The labels' ids
    and texts are a sample of at most ``labelled`` documents, those of least hash; all documents are scored.

    A text that is null or has no word has a null score and isn't toxic; equal texts score alike; ids matter for
    finding labels only. Without toxic labels nothing is toxic. Columns named as the results are replaced, all
    others stay; no rows give none."""
    path, least = fit(docs, labels, labelled)
    (s,) = fresh(docs, "toxic_score_")
    value = F.col(f"`{s}`")
    return put(scored(docs, path, s), {"toxic_score": value, "toxic": F.coalesce(value >= F.lit(least), F.lit(False))}).drop(s)
