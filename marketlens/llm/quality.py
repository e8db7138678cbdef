"""Quality by a sparse rule ensemble.

Statistics of the texts feed small boosted trees; every path from a root becomes a conjunctive rule; a lasso logistic
regression keeps few of the rules; the kept ones are compiled into one Spark column expression over the statistics.

Nulls and edges: null and empty texts have all statistics 0 and get the score of those; a null id is not held out;
repeated rows give repeated rows; other columns are ignored; without labels of both classes every score is one share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import bucket_of, labelled_sample, table

#: Rows of the labelled sample, at most, by class.
POSITIVES, NEGATIVES = 8000, 8000
MODULUS, HELD, THRESHOLD = 5, 0, 0.3
STATISTICS = ("words", "word_length", "upper", "digits", "marks", "bangs", "bars", "stops", "line_words", "repeated_lines", "distinct_words", "top_word", "long_words", "other_punctuation")
BINS = 32


def statistics_of(text: str) -> tuple[float, ...]:
    raw = text.encode()
    words, lines = raw.lower().split(), [x for x in raw.split(b"\n") if x.strip()]
    if not words:
        return (0.0,) * len(STATISTICS)
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda chars: float(n[list(chars)].sum())
    size, upper, count = float(len(raw)), of(range(65, 91)), Counter(words)
    return (
        float(len(words)), sum(map(len, words)) / len(words), upper / max(1.0, upper + of(range(97, 123))), of(range(48, 58)) / size,
        of(b"#$%&*") / size, of(b"!") / size, of(b"|") / size, of(b".") / size, len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        len(count) / len(words), count.most_common(1)[0][1] / len(words), sum(len(w) > 20 for w in count) / len(count), of(b"<>{}[]()\\/_=+;:~^@\"'") / size,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, one double for each statistic), one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics_of(t or "") for t in batch.column(1).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.record_batch([batch.column(0), *map(pa.array, np.ascontiguousarray(rows.T))], names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A condition: statistic, whether above (else at most), value.
Rule = tuple[tuple[int, bool, float], ...]


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, depth: int, out: list, leaf: np.ndarray, rate: float) -> None:
    """One regression tree on gradients; every node but the root is a rule; leaf gets the steps of the rows."""
    if path:
        out.append(path)
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, 0, 0)
    if depth and len(rows) >= 20:
        for f in range(binned.shape[1]):
            hg, hh = (np.cumsum(np.bincount(binned[rows, f], w[rows], BINS))[:-1] for w in (grad, hess))
            gain = hg**2 / (hh + 1) + (g - hg) ** 2 / (h - hh + 1) - g**2 / (h + 1)
            gain[(hh < 2) | (h - hh < 2)] = 0
            best = max(best, (float(gain.max()), f, int(gain.argmax())))
    if best[0] <= 1e-3:
        leaf[rows] = -rate * g / (h + 1)
        return
    _, f, at = best
    above = binned[rows, f] > at
    for side in (False, True):
        _grow(binned, edges, grad, hess, rows[above == side], (*path, (f, side, float(edges[f][at]))), depth - 1, out, leaf, rate)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    edges = [np.append(e, np.full(BINS - len(e), np.inf)) for e in edges]
    z, rules = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        _grow(binned, edges, p - y, p * (1 - p), np.arange(len(y)), (), depth, rules, step, rate)
        z += step
    return list(dict.fromkeys(tuple(sorted(r)) for r in rules if all(np.isfinite(c[2]) for c in r)))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] > v) if above else (x[:, f] <= v) for f, above, v in rule])


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute penalty by accelerated proximal gradient; the intercept is free."""
    n = len(y)
    x = np.concatenate((x, np.ones((n, 1))), 1)
    top = np.linalg.norm(x.T @ (x @ np.ones(x.shape[1]) / np.sqrt(x.shape[1]))) / n
    rate, w, v, t = 1 / max(0.25 * top * 1.5, 1e-6), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(rounds):
        new = v - rate * (x.T @ (1 / (1 + np.exp(-np.clip(x @ v, -30, 30))) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (last - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


@dataclass
class RuleModel:
    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self) -> Column:
        """The score as one expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            parts = [(F.col(STATISTICS[f]) > v) if above else (F.col(STATISTICS[f]) <= v) for f, above, v in rule]
            total = total + F.when(reduce(Column.__and__, parts), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, prior: float | None = None, penalty: float = 5e-4) -> RuleModel:
    """prior: the share of label 1 that the sample was drawn from; the intercept is moved to it."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    on = np.stack([holds(r, x) for r in rules], 1).astype(float)
    spread = np.sqrt(on.mean(0) * (1 - on.mean(0)))
    rules, on, spread = [r for r, s in zip(rules, spread, strict=True) if s > 0], on[:, spread > 0], spread[spread > 0]
    w, b = lasso(on / spread, y, penalty)
    w = w / spread
    if prior and 0 < prior < 1:
        b += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return RuleModel([(r, float(v)) for r, v in zip(rules, w, strict=True) if v], float(b))


def trained(spark, sf_dir: str) -> RuleModel:
    sample = labelled_sample(spark, sf_dir, "quality", MODULUS, HELD, POSITIVES, NEGATIVES)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    got = with_statistics(texts).join(F.broadcast(sample), "doc_id").toArrow().sort_by("doc_id")
    x = np.stack([got.column(s).to_numpy() for s in STATISTICS], 1) if len(got) else np.zeros((0, len(STATISTICS)))
    share = table(spark, sf_dir, "labels").where(bucket_of("doc_id", MODULUS) != HELD).agg(F.avg("quality")).first()[0]
    return fit(x, got.column("y").to_numpy().astype(float), share)


def query(spark, sf_dir: str) -> DataFrame:
    score = trained(spark, sf_dir).column()
    df = with_statistics(table(spark, sf_dir, "documents"))
    held = F.coalesce(bucket_of("doc_id", MODULUS) == HELD, F.lit(False))
    return df.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
