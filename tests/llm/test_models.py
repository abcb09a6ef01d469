"""Classifiers on held-out text, and the pipeline's stages on a small corpus."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import linear_text, quality_eb, toxicity

INSULTS = ["idiot", "moron", "scum"]


def corpus(n=600, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(3, 8))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        ws = [r.choice(vocab) for _ in range(r.randint(60, 150))]
        toxic, bad = r.random() < 0.2, r.random() < 0.25
        if toxic:
            for _ in range(2):
                ws.insert(r.randrange(len(ws)), r.choice(INSULTS))
        if bad:
            ws = [w + r.choice(["***", "###", "$$$"]) for w in ws]
        docs.append((i, " ".join(ws), "en", "good" if i % 3 else "bad", len(ws)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), {i: (q, t) for i, q, t in labels}


def test_toxicity_on_held_out_rows(spark, frames):
    docs, labels, truth = frames
    chain = {"unclean": 1 - F.col("quality"), "toxic": F.col("toxic")}
    out = toxicity.with_toxicity(docs.withColumn("kept", F.lit("x")), labels.where("doc_id < 400"), chain).collect()
    held = [r for r in out if r.doc_id >= 400]
    assert len(held) == 200
    hit = [(r.toxic, bool(truth[r.doc_id][1])) for r in held]
    assert sum(a == b for a, b in hit) >= 194 and sum(a and not b for a, b in hit) <= 2
    assert sum((r.p_unclean > 0.5) != bool(truth[r.doc_id][0]) for r in held) >= 196
    assert all(r.kept != r.toxic for r in out)


def test_edge_rows_and_one_class(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (3, "x " * 5000, "c")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], LABELS)
    chain = {"toxic": F.col("toxic")}
    rows = toxicity.with_toxicity(docs, none, chain).collect()
    assert len(rows) == 3 and all(r.p_toxic == pytest.approx(0.5) for r in rows)
    one = spark.createDataFrame([(3, 1, 0), (1, 1, 0), (9, 1, 0), (None, 1, 1), (4, 1, None)], LABELS)
    assert all(not r.toxic for r in toxicity.with_toxicity(docs, one, chain).collect())
    assert toxicity.with_toxicity(docs.limit(0), one, chain).count() == 0
    out = quality_eb.with_site_quality(docs, one, F.col("quality"), F.col("toxic"), F.lit(None).cast("string")).collect()
    assert len(out) == 3 and all(0 <= r.p_quality <= 1 for r in out)
    assert quality_eb.with_site_quality(docs.limit(0), none, F.col("quality"), F.col("toxic"), F.col("toxic")).count() == 0


def test_chain_is_fitted_in_a_task(spark, frames, monkeypatch):
    """The labelled rows do not go to the driver, and the models are those that it would fit."""
    docs, labels, _ = frames
    targets = {"unclean": 1 - F.col("quality"), "toxic": F.col("toxic")}
    known = linear_text.labelled_features(docs, labels, "doc_id", "text", targets)
    want, _ = toxicity.fit_chain(*known)
    driver, fit_chain = os.getpid(), toxicity.fit_chain

    def elsewhere(*args):
        assert os.getpid() != driver
        return fit_chain(*args)

    monkeypatch.setattr(toxicity, "fit_chain", elsewhere)
    got = toxicity.chain_of(linear_text.labelled_rows(docs, labels, "doc_id", "text", targets), list(targets))
    for a, b in zip(want, got, strict=True):
        assert a.words.tolist() == b.words.tolist() and a.weights == pytest.approx(b.weights) and a.bias == pytest.approx(b.bias)
    assert toxicity.with_toxicity(docs, labels, targets).count() == 600


def test_chain_feeds_out_of_fold_scores():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 50, 10)).astype(np.int32) for _ in range(400)]
    a = np.array([7 in x for x in rows])
    chain, oof = toxicity.fit_chain(list(range(400)), rows, np.zeros((400, linear_text.N_DENSE)), {"first": a, "second": a.copy()})
    assert len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0
    assert ((oof["first"] > 0) == a).mean() > 0.97


def test_site_quality_on_held_out_rows(spark, frames):
    docs, labels, truth = frames
    out = quality_eb.with_site_quality(docs, labels.where("doc_id < 400"), F.col("quality"), F.col("source"), F.col("lang")).collect()
    held = [r for r in out if r.doc_id >= 400]
    assert len(out) == 600 and sum(r.kept == bool(truth[r.doc_id][0]) for r in held) >= 196


def test_sparse_sites_shrink(spark):
    assert quality_eb.prior_strength(1000, 1000 * 10, 100, 0.0, 0.5) > quality_eb.prior_strength(1000, 1000 * 10, 100, 120.0, 0.5)
    rows = [(i, "w" * 3 + " good words here", "big" if i < 200 else f"s{i}") for i in range(220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(220)], LABELS)
    out = quality_eb.with_site_quality(docs, lab, F.col("quality"), F.col("source"), F.col("source")).collect()
    assert max(abs(r.p_path - 0.5) for r in out) < 0.1


def test_pipeline(spark, tmp_path):
    docs, labels = corpus(300, 9)
    bench = [(0, " ".join(f"bench{i}" for i in range(40)))]
    docs += [(1000, docs[5][1], "en", "good", 1), (1001, docs[6][1] + " end", "en", "good", 1), (1002, bench[0][1], "en", "good", 1), (1003, None, None, None, None), (1004, "", "en", "good", 0)]
    root = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{root}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, root)
        out.write.parquet(f"{root}/{k}")
        now = spark.read.parquet(f"{root}/{k}")
        kept.append([r[0] for r in now.select("doc_id").collect()])
        if k < 4:
            assert now.columns == [c.split()[0] for c in DOCS.split(", ")]
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & set(kept[0])) <= 2 and {1000, 1001, 1002, 1003, 1004} <= set(kept[0])
    assert {1000, 1004} <= set(kept[0]) - set(kept[1]) <= {1000, 1001, 1004}
    assert set(kept[1]) - set(kept[2]) == {1002}
    size = {i: len((t or "").split()) for i, t, *_ in docs}
    want = 1.5 * sum(size[i] for i in kept[2])
    assert abs(sum(size[i] for i in kept[3]) - want) <= 2 * max(size.values()) and set(kept[3]) <= set(kept[2])
    assert sorted(kept[4]) == sorted(kept[3])
    assert corpus_pipeline.run(spark, root).count() == len(kept[4])
