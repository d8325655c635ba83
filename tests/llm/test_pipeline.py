import functools
import random
import re

import pytest

import corpus_pipeline
from quern.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, docs_of, labels_of, tmp_path_factory):
    """A small corpus whose results are known: prose, junk, repeated lines, near copies, private spans, odd rows."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000)]
    prose = lambda n=80: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose()) for i in range(60)]
    rows += [(100 + i, "win win win click click now now now " * 6) for i in range(12)]
    rows += [(200 + i, prose() + "\nthis very line is said by many of the documents in here") for i in range(5)]
    base = prose()
    rows += [(300, base), (301, base.replace(base.split()[40], "changedword")), (302, base)]
    rows += [(400, prose(60) + " mail jane.doe42@mail3.example.com " + prose(20)), (500, None), (501, "")]
    path = tmp_path_factory.mktemp("sf")
    docs_of(rows).write.parquet(f"{path}/documents.parquet")
    labels_of([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(6)]).write.parquet(f"{path}/labels.parquet")
    return str(path), dict(rows)


def staged(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        out.append((name, docs, {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else docs.collect()))
    return out


@functools.cache
def ranks():
    return bpe.load_ranks()


def bpe_ids(text):
    return [i for w in re.findall(r"'s| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+", text) for i in bpe.heap_merged(w.encode(), ranks())]


def test_stages(spark, folder):
    sf_dir, rows = folder
    quality, lines, near, pii, packed = [s[2] for s in staged(spark, sf_dir)]
    clean = {i for i, t in rows.items() if t and not 100 <= i < 112}
    assert set(quality) == clean
    # an exact copy says nothing new and goes; shared lines stay in the first document alone
    assert set(lines) == clean - {302} and lines[200] == rows[200] and all("\n" not in lines[i] for i in range(201, 205))
    assert set(near) == clean - {301, 302}
    assert set(pii) == set(near) and "jane" not in pii[400] and "<EMAIL>" in pii[400] and all(pii[i] == near[i] for i in pii if i != 400)
    assert {r.doc_id for r in packed} == set(pii) and all(sum(r.n_tokens for r in packed if r.doc_id == i) == len(bpe_ids(t)) + 1 for i, t in pii.items())


def test_columns_and_run(spark, folder):
    sf_dir, _ = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "pii", "packing"]
    for name, df, got in staged(spark, sf_dir)[:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in df.collect())
    want = staged(spark, sf_dir)[-1][2]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, want))


def test_stages_bear_odd_rows(spark, folder, odd, docs_of):
    from pyspark.sql import functions as F

    sf_dir, _ = folder
    wide = odd.withColumn("keep_", F.lit(1)).withColumn("pii_spans", F.lit("x")).withColumn("quality_score", F.lit(0)).withColumn("node", F.lit(2))
    for df in (wide, docs_of([])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf_dir)
            n = out.count()
            assert n == 0 or df is wide
            if name != "packing":
                assert out.columns == list(corpus_pipeline.COLUMNS), name


def test_names():
    assert all(re.fullmatch(r"[\w ]+", n) for n, _ in corpus_pipeline.STAGES)
