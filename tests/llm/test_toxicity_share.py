import random

from pyspark.sql import functions as F

from marketlens.llm import toxicity
from marketlens.llm.shared import labelled
from tests.llm.helpers import docs_of, write_tables


def test_scores_keep_the_share_of_all_labels_when_the_caps_bind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 250)
    monkeypatch.setattr(toxicity, "NEGATIVES", 250)
    rng = random.Random(1)
    texts, toxic = [], []
    for i in range(4000):
        texts.append(" ".join(rng.choices(["good", "fine", "so", "very", "plain", "text"], k=8)) + (" evil" if i % 5 == 0 else ""))
        toxic.append(int(i % 10 == 0))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    path = write_tables(spark, tmp_path, docs_of(spark, texts), labels=labels)
    mean = toxicity.query(spark, path).agg(F.avg("score")).first()[0]
    assert abs(mean - 0.1) < 0.04


def test_features_for_training_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 900)
    seen, fit = [], toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda texts, *a: seen.append([len(t) for t in texts]) or fit(texts, *a))
    sample = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int")
    toxicity.train(docs_of(spark, ["w x y z " * 10] * 60), sample)
    assert seen == [[40] * 7]


def test_of_several_labels_the_largest_counts(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (2, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    path = write_tables(spark, tmp_path, docs_of(spark, ["a"]), labels=labels)
    assert sorted(tuple(r) for r in labelled(spark, path, "toxic", 1, 5).collect()) == [(1, 1), (2, 0)]
