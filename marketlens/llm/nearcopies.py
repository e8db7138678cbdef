"""Embedding near-dedup: an exact metric range join.

Within a label, cosine >= t is a distance <= r = sqrt(2 - 2t) between unit vectors. Pivots partition the vectors; a
vector whose distance to the bounding hyperplane of a cell (a form of the triangle inequality) is at most r is
replicated into that cell, so that every cell sees all partners of its own vectors and is joined alone. Large cells
are joined in tiles of bounded size. Equal vectors are one vector with a weight.

Nulls and edges: rows with a null label, a null, zero or non-finite vector link with nothing and are their own
component; a repeated vec_id is a vector of its own weight in the counts and gives one row for each; vectors of
different lengths never link; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import Scratch, components, table
from marketlens.llm.vectors import blocks, matrix, prepared, usable

COSINE = 0.93
#: Vectors for each pivot, and pivots of a label at most (the cells then grow and are tiled).
PER_PIVOT, MOST_PIVOTS = 2000, 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(cosine: float):
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-7

    def run(key, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        pivots = pivots.sort_values("pivot")
        x, p = _unit(matrix(rows["embedding"])), _unit(matrix(pivots["embedding"]))
        d2, between = 2 - 2 * x @ p.T, np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
        home = d2.argmin(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = (d2 - d2[np.arange(len(x)), home][:, None]) / (2 * between[home])
        inside = ~(gap > radius)  # a pivot equal to the home pivot gives no number and takes part
        inside[np.arange(len(x)), home] = True
        i, cell = np.nonzero(inside)
        return rows.iloc[i].assign(cell=cell.astype("int32"), home=home[i] == cell)

    return run


def _tile(cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Own vectors against others: links of the own ones, and a spanning set of links."""
        own, other = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if own.empty or other.empty:
            return pd.DataFrame({"vec": [], "links": [], "root": []}).astype("int64")
        a, b = matrix(own["embedding"]), matrix(other["embedding"])
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        cos = (a @ b.T) / np.outer(na, nb)
        linked = cos >= cosine
        for i, j in zip(*np.nonzero(np.abs(cos - cosine) < 1e-12), strict=True):
            linked[i, j] = float(np.dot(a[i], b[j])) / float(na[i] * nb[j]) >= cosine
        x, y = own["vec"].to_numpy(), other["vec"].to_numpy()
        links = linked @ other["weight"].to_numpy()
        top = np.iinfo(np.int64).max
        left, right = x.copy(), y.copy()
        while True:  # least label among linked vectors, until it stands
            new_right = np.minimum(right, np.where(linked, left[:, None], top).min(0))
            new_left = np.minimum(left, np.where(linked, new_right[None, :], top).min(1))
            if (new_left == left).all() and (new_right == right).all():
                break
            left, right = new_left, new_right
        ids, roots = np.concatenate((x, y)), np.concatenate((left, right))
        return pd.DataFrame({"vec": ids, "links": np.concatenate((links, np.zeros(len(y), np.int64))), "root": roots})

    return run


def near_copies(scratch: Scratch, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label)."""
    everything = vectors.select("vec_id", "embedding", "label")
    rows = prepared(everything.where("label is not null and vec_id is not null")).withColumn("dim", F.size("embedding"))
    rows = rows.withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "embedding", "label")})
    classes = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("embedding").alias("embedding"))
    classes = scratch.save(classes)
    count = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    wanted = F.least(F.greatest(F.lit(1), F.ceil(F.col("n") / PER_PIVOT)), F.lit(MOST_PIVOTS))
    ranked = classes.withColumn("pivot", F.row_number().over(Window.partitionBy("label", "dim").orderBy("h1", "h2"))).where(f"pivot <= {MOST_PIVOTS}")
    pivots = ranked.join(count, ["label", "dim"]).where(F.col("pivot") <= wanted)
    sized = classes.join(count, ["label", "dim"]).withColumn("salt", F.pmod("h1", blocks(F.col("n"))).cast("int"))
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), blocks(F.col("n")) - 1))).select("label", "dim", "salt", "pivot", "embedding")
    key = ["label", "dim", "salt"]
    fields = "vec long, weight long, label int, dim int, salt int, embedding array<double>"
    sized = sized.select("vec", "weight", F.col("label").cast("int").alias("label"), "dim", "salt", "embedding")
    placed = sized.groupBy(*key).cogroup(pivots.toDF(*pivots.columns).groupBy(*key)).applyInPandas(_assign(cosine), f"{fields}, cell int, home boolean")
    placed = scratch.save(placed.drop("salt"))
    per_cell = placed.groupBy("label", "dim", "cell").agg(blocks(F.count_if("home")).alias("owns"), blocks(F.count("*")).alias("alls"))
    tiled = placed.join(per_cell, ["label", "dim", "cell"])
    salt = F.xxhash64("vec")
    own = tiled.where("home").withColumns({"side": F.lit(0), "i": F.pmod(salt, "owns").cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("alls") - 1))})
    other = tiled.withColumns({"side": F.lit(1), "j": F.pmod(salt, "alls").cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("owns") - 1))})
    cut = ["vec", "weight", "embedding", "side", "label", "dim", "cell", "i", "j"]
    tiles = own.select(*cut).unionByName(other.select(*cut)).groupBy("label", "dim", "cell", "i", "j")
    found = scratch.save(tiles.applyInPandas(_tile(cosine), "vec long, links long, root long"))
    comp = components(scratch, found.where("vec <> root").select(F.col("vec").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    # a class counts itself through its weight; each of its vectors links with all of them but itself
    of_class = classes.select("h1", "h2", "vec").join(links, "vec", "left").join(comp, F.col("vec") == F.col("node"), "left")
    of_class = of_class.select("h1", "h2", (F.col("links") - 1).alias("links"), F.coalesce("component", "vec").alias("component"))
    out = rows.select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    usable_ids = everything.where("label is not null and vec_id is not null")
    rest = everything.where("label is null or vec_id is null").select("vec_id").unionByName(usable_ids.where(~F.coalesce(usable(), F.lit(False))).select("vec_id"))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))




def query(spark, sf_dir: str) -> DataFrame:
    return near_copies(Scratch(spark, "nearcopies"), table(spark, sf_dir, "embeddings"))
