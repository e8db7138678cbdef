"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings (the word and its first four and five bytes). Filters over one, two and three
words are max-pooled over the whole text, and a logistic layer turns the pooled values into a score, which a held
part of the sample calibrates; thresholds are chosen for each language on that part. Both weight the classes to their
shares among all labels, as the sample takes so many rows of each class. Scoring needs no language.

Nulls and edges: null and empty texts get the score of a text without known words; a null id scores like any other
and is not held out; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import Scratch, bucket_of, give_back, labelled, labelled_sample, table

#: Rows of the labelled sample that the classifier is fitted on, at most, by class.
POSITIVES, NEGATIVES = 2500, 4500
#: Hashed features (three a word) of the texts that it is fitted on, at most; texts beyond, by a hash of the id, are left out whole.
MOST_FEATURES = 24_000_000
MODULUS, HELD, THRESHOLD = 4, 2, 0.3
BUCKETS, WIDTHS, DIM, FILTERS = 1 << 20, (1, 2, 3), 8, 8


def word_features(word: bytes) -> tuple[int, int, int]:
    """Buckets of a word and of its beginnings."""
    word = word.strip(b".,;:!?\"'()[]") or word
    return tuple(zlib.crc32(part, seed) & (BUCKETS - 1) for seed, part in ((1, word), (2, word[:4]), (3, word[:5])))


@dataclass
class Model:
    known: np.ndarray  # sorted buckets that have an embedding
    tables: list[list[np.ndarray]]  # for each width and offset: filter responses by embedding row, row 0 for none
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, buckets), len(self.known) - 1)
        return np.where(self.known[at] == buckets, at + 1, 0)

    def scores(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit + self.scale[1], -30, 30)))


class Scorer:
    """Scores texts; words already met keep the responses of their filters."""

    MOST_WORDS = 200_000

    def __init__(self, model: Model):
        self.model, self.seen = model, {}
        n = sum(map(len, model.tables))
        self.table = np.zeros((1024, n, FILTERS), np.float32)

    def _add(self, words: list[bytes]) -> None:
        at, model = len(self.seen), self.model
        rows = model.rows(np.array([word_features(w) for w in words]).reshape(-1, 3))
        while at + len(words) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        for k, t in enumerate(t for ts in model.tables for t in ts):
            self.table[at : at + len(words), k] = t[rows].sum(1)
        self.seen.update(zip(words, range(at, at + len(words)), strict=True))

    def logit(self, text: str) -> float:
        words, model = text.encode().lower().split(), self.model
        if len(self.seen) > self.MOST_WORDS:
            self.seen = {}
        if new := list(dict.fromkeys(w for w in words if w not in self.seen)):
            self._add(new)
        ids = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        pooled, k = [], 0
        for width, bias in zip(WIDTHS, model.bias, strict=True):
            z = np.zeros((max(len(ids), 1), FILTERS), np.float32)
            for j in range(width):
                if len(ids) > j:
                    z[: len(ids) - j] += self.table[ids[j:], k]
                k += 1
            pooled.append(np.maximum(z.max(0) + bias, 0))
        return float(np.concatenate(pooled) @ model.out + model.out_bias)


def in_one(texts: list[np.ndarray], of) -> list[np.ndarray]:
    """of(t) for each of texts, which has no more values than t, as views of one array: its memory goes back whole, that of many small ones stays with the process."""
    held, at, out = np.empty(sum(t.size for t in texts), np.int32), 0, []
    for t in texts:
        made = of(t)
        out.append(held[at : at + made.size].reshape(made.shape))
        out[-1][...] = made
        at += made.size
    return out


def _fit(texts: list[np.ndarray], y: np.ndarray, seed: int, epochs: int, rate: float = 0.01, least_docs: int = 4):
    """Adam on the pooled positions; texts are arrays (words, 3) of buckets. Returns the model and logits' parts."""
    rng = np.random.default_rng(seed)
    per_doc = in_one(texts, np.unique)
    known, n = np.unique(np.concatenate([*per_doc, np.zeros(1, np.int32)]), return_counts=True)
    pos = np.zeros(len(known))
    toxic, times = np.unique(np.concatenate([*[d for d, label in zip(per_doc, y, strict=True) if label], np.zeros(0, np.int32)]), return_counts=True)
    pos[np.searchsorted(known, toxic)] = times
    frequent = n >= least_docs
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((n - pos + 0.5) / ((1 - y).sum() + 1))
    known, odds = (known[frequent], odds[frequent]) if frequent.any() else (known[:1], odds[:1] * 0)
    e = rng.normal(0, 0.02, (len(known) + 1, DIM))
    e[1:, 0] += odds * 0.2
    e[0] = 0
    w = [rng.normal(0, 0.3, (k, DIM, FILTERS)) for k in WIDTHS]
    for x in w:
        x[:, 0] = np.abs(x[:, 0])
    model = Model(known, [], [np.zeros(FILTERS) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.3), float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))
    docs = in_one(texts, model.rows)
    del per_doc, n, pos, frequent
    params = [e, *w, *model.bias, model.out]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    out_bias, b1, b2 = model.out_bias, 0.9, 0.99
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for chunk in np.array_split(order, max(1, len(order) // 64)):
            pooled = np.zeros((len(chunk), len(WIDTHS), FILTERS))
            best = np.zeros((len(chunk), len(WIDTHS), FILTERS), int)
            for i, d in enumerate(chunk):
                x = e[docs[d]].sum(1) if len(docs[d]) else np.zeros((1, DIM))
                x = np.concatenate((x, np.zeros((max(WIDTHS) - 1, DIM))))
                for k, width in enumerate(WIDTHS):
                    z = sum(x[j : len(x) - max(WIDTHS) + 1 + j] @ w[k][j] for j in range(width))
                    best[i, k] = z.argmax(0)
                    pooled[i, k] = z[best[i, k], np.arange(FILTERS)] + model.bias[k]
            active = np.maximum(pooled, 0).reshape(len(chunk), -1)
            p = 1 / (1 + np.exp(-np.clip(active @ model.out + out_bias, -30, 30)))
            g = (p - y[chunk]) / len(chunk)
            grads = [np.zeros_like(q) for q in params]
            grads[-1] = active.T @ g + 1e-4 * model.out
            back = ((g[:, None] * model.out) * (active > 0)).reshape(pooled.shape)
            for k, width in enumerate(WIDTHS):
                grads[1 + len(WIDTHS) + k] = back[:, k].sum(0)
                for i, d in enumerate(chunk):
                    for j in range(width):
                        at = best[i, k] + j
                        inside = at < len(docs[d])
                        if inside.any():
                            r = docs[d][at[inside]]
                            grads[1 + k][j][:, inside] += e[r].sum(1).T * back[i, k][inside]
                            np.add.at(grads[0], r.ravel(), np.repeat(back[i, k][inside][:, None] * w[k][j][:, inside].T, 3, 0))
            grads[0][0] = 0
            step += 1
            for q, gr, a, b in zip(params, grads, m, v, strict=True):
                a *= b1
                a += (1 - b1) * gr
                b *= b2
                b += (1 - b2) * gr * gr
                q -= rate * (a / (1 - b1**step)) / (np.sqrt(b / (1 - b2**step)) + 1e-8)
            out_bias -= rate * 10 * g.sum()
    e[0] = 0
    model.tables, model.out_bias = [[(e @ w[k][j]).astype(np.float32) for j in range(width)] for k, width in enumerate(WIDTHS)], float(out_bias)
    return model


def _logit_of(model: Model, words: np.ndarray) -> float:
    rows, pooled = model.rows(words), []
    for k, width in enumerate(WIDTHS):
        z = np.zeros((max(len(rows), 1), FILTERS))
        for j in range(width):
            if len(rows) > j:
                z[: len(rows) - j] += model.tables[k][j][rows[j:]].sum(1)
        pooled.append(np.maximum(z.max(0) + model.bias[k], 0))
    return float(np.concatenate(pooled) @ model.out + model.out_bias)


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and shift of a logistic curve through the logits; w weights the rows."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        q = w * (p * (1 - p) + 1e-6)
        grad = np.array([(w * (p - y) * z).sum() + 1e-2 * (a - 1), (w * (p - y)).sum() + 1e-2 * b])
        hess = np.array([[(q * z * z).sum() + 1e-2, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-2]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -1, 1)
        a = max(a, 0.05)
    return float(a), float(b)


def _best_threshold(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The threshold with the best F1 of the weighted rows among round values; the higher one on ties."""
    return max((2 * (w * y)[score >= t].sum() / max(1e-9, w[score >= t].sum() + (w * y).sum()), t) for t in np.arange(0.2, 0.81, 0.05))[1]


def train(docs: DataFrame, sample: DataFrame, seed: int = 7, epochs: int = 6, calibrate: float = 0.2, prior: float | None = None) -> Model:
    """Fits on sample (doc_id, y), bounded by its caller, joined with the texts. Words are hashed on the executors.

    prior: the share of label 1 that the sample was drawn from; the calibrating rows are weighted to it.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple] = {}
        for batch in batches:
            lists = []
            for t in batch.column(1).to_pylist():
                words = (t or "").encode().lower().split()
                lists.append([b for x in words for b in memo.get(x) or memo.setdefault(x, word_features(x))])
            yield pa.record_batch([batch.column(0), pa.array(lists, pa.list_(pa.int32())), batch.column(2), batch.column(3)], names=["doc_id", "w", "lang", "y"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang")).join(F.broadcast(sample), "doc_id")
    scratch = Scratch(docs.sparkSession, "toxicity")
    saved = scratch.save(rows.select("doc_id", "text", "lang", "y").mapInArrow(hashed, "doc_id long, w array<int>, lang string, y int"))
    # the sample only, so few rows
    upto = F.sum(F.size("w")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    got = saved.withColumn("upto", upto).where(F.col("upto") <= MOST_FEATURES).drop("upto").toArrow()
    scratch.close()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")  # the words themselves are not sorted, which would copy them
    texts = [w.values.to_numpy().reshape(-1, 3) for w in got.column("w")]
    texts = [texts[i] for i in order]
    y, langs = np.array(got.column("y").to_pylist(), float)[order], np.array([x or "" for x in got.column("lang").to_pylist()], object)[order]
    if not len(y):
        return _fit([np.zeros((0, 3), np.int64)], np.zeros(1), seed, 0)
    held = np.random.default_rng(seed).random(len(y)) < calibrate
    held = held if len(y) >= 50 else np.zeros(len(y), bool)
    model = _fit([t for t, h in zip(texts, held, strict=True) if not h], y[~held], seed, epochs)
    if held.any():
        z = np.array([_logit_of(model, t) for t, h in zip(texts, held, strict=True) if h])
        share = y.mean()
        weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)) if prior and 0 < prior < 1 and 0 < share < 1 else np.ones(len(y))
        model.scale = _platt(z, y[held], weight[held])
        s = model.scores(z)
        for name in sorted(set(langs[held])):
            own = langs[held] == name
            if y[held][own].sum() >= 5:
                model.thresholds[name] = float(_best_threshold(s[own], y[held][own], weight[held][own]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score; the model travels with the function (a few MB, bounded by the sample)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shipped.value)
        for part in parts:
            yield pd.Series(shipped.value.scores(np.array([scorer.logit(t or "") for t in part], float)))

    return docs.withColumn("score", scored(F.col("text").cast("string")))


def trained(spark, sf_dir: str, docs: DataFrame) -> Model:
    share = labelled(spark, sf_dir, "toxic", MODULUS, HELD).where("y in (0, 1)").agg(F.avg("y")).first()[0]
    model = train(docs, labelled_sample(spark, sf_dir, "toxic", MODULUS, HELD, POSITIVES, NEGATIVES), prior=share)
    give_back()  # the pipeline's later stages run in this process
    return model


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained(spark, sf_dir, docs)
    out = score(docs.select("doc_id", "text", F.coalesce(bucket_of("doc_id", MODULUS) == HELD, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents below their language's threshold; other languages take the general one. Columns stay as they are."""
    limit = F.lit(0.5)
    for name, t in sorted(model.thresholds.items()):
        limit = F.when(F.coalesce(F.col("lang"), F.lit("")) == name, t).otherwise(limit)
    return score(docs, model).where(F.col("score") < limit).select(*docs.columns)
