"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are lifted so that the largest inner product is the least Euclidean distance, and projected by a matrix of
normal variates. The squared projected distance of a pair is its squared distance times a chi-square variable, so the
search may stop when the next projected distance is above the k-th best distance so far times a quantile of it: a
closer vector would then have been met with that probability. A coarse kd-tree, fitted on a bounded sample, cuts the
rows into cells; a query is answered in its own cell first and then visits the cells whose box passes the same test.
Inside a block of a cell, a kd-tree orders its leaves by projected distance and the vectors of a leaf are verified.

Nulls and edges: null, zero or non-finite vectors and null ids take no part, as query or candidate; a repeated vec_id
is one candidate for each of its rows, never for itself; vectors only meet those of their own length; ties go to the
smaller vec_id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import Scratch, table
from marketlens.llm.vectors import matrix, prepared

K, EVERY = 20, 20
#: Dimensions of the projection, degree of certainty of the stopping test, vectors of a leaf.
PROJECTED, CERTAINTY, LEAF = 8, 0.98, 256
#: Rows of the sample that the coarse tree is fitted on, rows of a block, queries of a block.
SAMPLE, BLOCK, QUERIES = 20_000, 65_536, 4096


def chi_square_quantile(p: float, degrees: int) -> float:
    """By bisection on the closed form for an even number of degrees."""
    low, high = 0.0, 400.0
    for _ in range(80):
        x = (low + high) / 2
        term = total = np.exp(-x / 2)
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - total < p else (low, x)
    return high


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim + 1, PROJECTED))


def lift(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """Candidates get sqrt(top^2 - |x|^2) as a further coordinate; queries are scaled to the norm top and get 0."""
    if query:
        return np.concatenate((x * (top / np.linalg.norm(x, axis=1, keepdims=True)), np.zeros((len(x), 1))), 1)
    return np.concatenate((x, np.sqrt(np.maximum(top * top - (x * x).sum(1, keepdims=True), 0))), 1)


def split(points: np.ndarray, leaf: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """kd-tree leaves: row numbers, and lower and upper corners of their boxes (open outside for the outer ones)."""
    done, todo = [], [(np.arange(len(points)), np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf))]
    while todo:
        rows, low, high = todo.pop()
        if len(rows) > leaf:
            part = points[rows]
            axis = int((part.max(0) - part.min(0)).argmax())
            cut = float(np.median(part[:, axis]))
            left = part[:, axis] <= cut
            if 0 < left.sum() < len(rows):
                up, down = high.copy(), low.copy()
                up[axis], down[axis] = cut, cut
                todo += [(rows[left], low, up), (rows[~left], down, high)]
                continue
        done.append((rows, low, high))
    return [d[0] for d in done], np.array([d[1] for d in done]), np.array([d[2] for d in done])


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        p = points[:, axis : axis + 1]
        out += np.maximum(np.maximum(low[None, :, axis] - p, p - high[None, :, axis]), 0) ** 2
    return out


def search(ids, x, query_ids, q, top: float, start: np.ndarray | None = None, k: int = K):
    """The k best of a block for each query: (ids, scores), padded with -1. start: scores that are known to be reached."""
    both = projection(x.shape[1])
    points, aims = lift(x, top, False) @ both, lift(q, top, True) @ both
    leaves, low, high = split(points, LEAF)
    low, high = np.array([points[r].min(0) for r in leaves]), np.array([points[r].max(0) for r in leaves])
    far = box_distance(aims, low, high)
    order = far.argsort(1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
    best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
    known = np.full(len(q), -np.inf) if start is None else start
    quantile, norm = chi_square_quantile(CERTAINTY, PROJECTED), np.linalg.norm(q, axis=1)
    at, step = 0, 2
    while at < len(leaves):
        # squared distance to the lifted candidate: 2 top^2 - 2 top <q, x> / |q|
        reach = quantile * np.maximum(2 * top * top - 2 * top * np.maximum(best[:, -1], known) / norm, 0)
        now = (rank >= at) & (rank < at + step) & (far <= reach[:, None])
        if not now.any():
            break
        for leaf in np.flatnonzero(now.any(0)):
            asks, rows = np.flatnonzero(now[:, leaf]), leaves[leaf]
            # one order of summation for every pair: a matrix product's last bits depend on the shape of the batch
            s = np.einsum("id,jd->ij", q[asks], x[rows])
            s[query_ids[asks][:, None] == ids[rows][None, :]] = -np.inf
            better = (s >= best[asks, -1][:, None]).any(1)
            asks, s = asks[better], s[better]
            if len(asks):
                scores = np.concatenate((best[asks], s), 1)
                names = np.concatenate((who[asks], np.broadcast_to(ids[rows], s.shape)), 1)
                names = np.where(np.isneginf(scores), -1, names)
                pick = np.lexsort((names, -scores), axis=1)[:, :k]
                best[asks], who[asks] = np.take_along_axis(scores, pick, 1), np.take_along_axis(names, pick, 1)
        at, step = at + step, step * 2
    return who, best


def _answers(query_ids, dims, who, best) -> pd.DataFrame:
    i, j = np.nonzero(who >= 0)
    return pd.DataFrame({"query_id": query_ids[i], "dim": dims, "vec_id": who[i, j], "score": best[i, j]})


def _search_block(top: float):
    def run(key, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asks.empty:
            return pd.DataFrame({"query_id": [], "dim": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "dim": "int32", "vec_id": "int64", "score": "float64"})
        start = asks["reached"].fillna(-np.inf).to_numpy()
        who, best = search(rows["vec_id"].to_numpy(), matrix(rows["embedding"]), asks["query_id"].to_numpy(), matrix(asks["embedding"]), top, start)
        return _answers(asks["query_id"].to_numpy(), key[0], who, best)

    return run


def nearest(scratch: Scratch, vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by every."""
    rows = prepared(vectors.select("vec_id", "embedding").where("vec_id is not null")).withColumn("dim", F.size("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    stats = rows.agg(F.max(norm), F.count("*")).first()
    if not stats[1]:
        return scratch.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top, n = stats[0] * (1 + 1e-9), stats[1]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "embedding").toPandas()
    boxes = {}
    for dim, part in sample.groupby("dim"):
        points = lift(matrix(part["embedding"]), top, False) @ projection(dim)
        _, low, high = split(points, max(LEAF, int(np.ceil(len(points) * BLOCK / n))))
        boxes[int(dim)] = low, high

    def place(batches):
        for part in batches:
            out = np.zeros(len(part), np.int32)
            for dim, own in part.groupby("dim").indices.items():
                if dim in boxes:
                    points = lift(matrix(part["embedding"].iloc[own]), top, False) @ projection(dim)
                    out[own] = box_distance(points, *boxes[dim]).argmin(1)
            yield part.assign(cell=out)

    placed = scratch.save(rows.select("vec_id", "dim", "embedding").mapInPandas(place, "vec_id long, dim int, embedding array<double>, cell int"))
    sized = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    held = placed.join(sized, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    asked = scratch.save(placed.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id", "dim"]))
    asked = asked.withColumn("reached", F.lit(None).cast("double"))
    fields = "query_id long, dim int, vec_id long, score double"

    def answered(asks: DataFrame) -> DataFrame:
        """Queries (query_id, dim, cell, embedding, reached) against all blocks of the cell, some queries at a time."""
        per = asks.groupBy("dim", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
        spread = asks.join(sized, ["dim", "cell"]).join(per, ["dim", "cell"])
        spread = spread.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "share": F.pmod(F.xxhash64("query_id"), "shares").cast("int")})
        there = held.join(per, ["dim", "cell"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        key, of_query = ["dim", "cell", "part", "share"], ["query_id", "embedding", "reached"]
        spread = spread.select(*key, *of_query).toDF(*key, *of_query)  # columns of its own, as both sides come from one table
        return there.select(*key, "vec_id", "embedding").groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(_search_block(top), fields)

    best = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "vec_id")
    first = scratch.save(answered(asked).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    reached = first.where(F.col("rank") == k).select("query_id", "dim", F.col("score").alias("kth"))
    quantile = chi_square_quantile(CERTAINTY, PROJECTED)

    def visits(batches):
        """The other cells whose box passes the stopping test of a query."""
        for part in batches:
            out = []
            for dim, own in part.groupby("dim").indices.items():
                low, high = boxes.get(dim, (np.zeros((0, PROJECTED)),) * 2)
                mine = part.iloc[own]
                q = matrix(mine["embedding"])
                far = box_distance(lift(q, top, True) @ projection(dim), low, high)
                reach = quantile * np.maximum(2 * top * top - 2 * top * mine["kth"].fillna(-np.inf).to_numpy() / np.linalg.norm(q, axis=1), 0)
                i, cell = np.nonzero((far <= reach[:, None]) & (np.arange(len(low)) != mine["cell"].to_numpy()[:, None]))
                out.append(mine.iloc[i][["query_id", "dim", "embedding"]].assign(cell=cell.astype("int32"), reached=mine["kth"].to_numpy()[i]))
            yield pd.concat(out) if out else part.iloc[:0][["query_id", "dim", "embedding"]].assign(cell=0, reached=0.0)

    more = asked.drop("reached").join(reached, ["query_id", "dim"], "left")
    more = more.mapInPandas(visits, "query_id long, dim int, embedding array<double>, cell int, reached double")
    both = first.drop("rank").unionByName(answered(more))
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(Scratch(spark, "neighbours"), table(spark, sf_dir, "embeddings"))
