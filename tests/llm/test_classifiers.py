import zlib

import numpy as np
import pytest

from marketlens.llm import quality, toxicity
from tests.llm.helpers import docs_of, write_tables

SF = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("module,label,modulus,held,least", [(toxicity, "toxic", 4, 2, 0.85), (quality, "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, module, label, modulus, held, least):
    rows = {r.doc_id: r for r in module.query(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    test = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    assert auc(np.array([s for s, _ in test]), np.array([y for _, y in test])) >= least


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_nulls_and_no_labels(spark, tmp_path, module, label):
    docs = docs_of(spark, [None, "", "word " * 1000, "a\n\n|b", "x"]).selectExpr("*", "1 as score", "2 as held_out", "3 as words")
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", docs.doc_id.cast("string").cast("long") * None))
    path = write_tables(spark, tmp_path, docs, labels=spark.createDataFrame([], f"doc_id long, {label} int"))
    rows = module.query(spark, path).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and sum(r.doc_id is None for r in rows) == 1


def test_rules_compile_to_what_they_were(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    model = quality.fit(x, y)
    df = spark.createDataFrame([[float(v) for v in r] for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = np.array([r.s for r in df.select(model.column().alias("s")).collect()])
    z = model.intercept + sum(w * quality.holds(rule, x) for rule, w in model.rules)
    assert np.abs(got - 1 / (1 + np.exp(-z))).max() < 1e-9 and ((got > 0.5) == y).mean() > 0.97


def test_scorer_agrees_with_training_form():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "bad", "fine", "evil", "so", "very"], 12)) for _ in range(60)]
    y = np.array([float("evil" in t) for t in texts])
    hashed = [np.array([toxicity.word_features(w) for w in t.encode().split()]) for t in texts]
    model = toxicity._fit(hashed, y, 1, 4)
    scorer = toxicity.Scorer(model)
    assert np.allclose([scorer.logit(t) for t in texts], [toxicity._logit_of(model, h) for h in hashed], atol=1e-4)


def test_training_copies_share_one_array():
    """Small arrays would leave their memory with the driver's process."""
    texts = [np.arange(6).reshape(-1, 3) * k for k in range(4)] + [np.zeros((0, 3), np.int32)]
    kept = toxicity.in_one(texts, lambda t: t + 1)
    assert all((a == b + 1).all() and a.shape == b.shape for a, b in zip(kept, texts, strict=True))
    distinct = toxicity.in_one(texts, np.unique)
    assert [len(d) for d in distinct] == [len(np.unique(t)) for t in texts]
    assert len({id(a.base) for a in kept}) == len({id(a.base) for a in distinct}) == 1
