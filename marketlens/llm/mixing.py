"""Mixing sources to target weights by the cube method.

Every source gets a number of words to contribute. Its documents start with the same fractional inclusion
probability and are then moved, three at a time and large ones first, through the null space of the balancing
constraints (words and documents of the source stay constant) until a probability reaches 0 or 1. Blocks of bounded
size do this independently; the at most two units that a block leaves go on to the next level. The last flight of a
source leaves HELD units out, spread evenly over the order of sizes; of all choices of these and the two that remain the
one nearest to the totals of words and documents is taken (landing).

Nulls and edges: a null or empty text counts 0 words, is taken as often as is certain and never selected beyond it; a null source is a source of its own and comes last;
repeated rows are units of their own, dealt to blocks apart; rows that share an id only are different units; an empty
table gives no rows; other columns are ignored. Only the totals of the sources, one row for each, are sorted in one
task. Reruns agree (where rows repeat an id, a text and a source: over the same files and settings).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import WORD, Scratch, table

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET, CAP = 1.5, 2.0
#: Units that one task balances at once.
BLOCK = 20_000
#: Units of a source that wait for the landing, and what a document off weighs in it, as a share of their mean size.
HELD, DOCUMENT = 12, 0.02


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, of, source, size): of is a hash of the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("of"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(units: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, target): the budget shared by weight, no source above cap times its size.

    Resharing an excess until none is above ends at one level: target = least(level * weight, cap * size). Sources
    sorted by the level at which they hit their cap give that level by running sums. Only one row per source is sorted.
    """
    per = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("hits"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumn("hits", F.col("source_size") * cap / F.col("weight"))
    per = per.withColumn("capped", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", (F.sum("source_size").over(whole) * budget - F.col("capped")) / F.col("open"))
    # the first source that its level does not cap gives the level of all later ones
    per = per.withColumn("final", F.min(F.when(F.col("level") <= F.col("hits"), F.struct("hits", "level"))).over(whole)["level"])
    target = F.when(F.col("final").isNull(), F.col("source_size") * cap).otherwise(F.least(F.col("final") * F.col("weight"), F.col("source_size") * cap))
    return per.select("source", "source_size", "n", target.cast("double").alias("target"))


def _direction(s: np.ndarray) -> np.ndarray:
    """A vector that keeps the sum and the size-weighted sum of up to three units."""
    if len(s) == 3:
        u = np.array([s[1] - s[2], s[2] - s[0], s[0] - s[1]])
        return u if u.any() else np.array([1.0, -1.0, 0.0])
    return np.array([1.0, -1.0]) if len(s) == 2 and s[0] == s[1] else np.zeros(len(s))


def flight(x: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves x inside [0, 1] until at most two entries are fractional; keeps sum(x) and sum(x * size)."""
    x, todo, hold = x.copy(), iter(np.flatnonzero((x > 1e-9) & (x < 1 - 1e-9))), []
    draws, at = rng.random(len(x) + 3), 0
    while True:
        while len(hold) < 3 and (i := next(todo, None)) is not None:
            hold.append(i)
        u = _direction(size[hold])
        if not u.any():
            return x
        y = x[hold]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - y) / u, np.where(u < 0, -y / u, np.inf)).min()
            down = np.where(u > 0, y / u, np.where(u < 0, (y - 1) / u, np.inf)).min()
        y = y + up * u if draws[at % len(draws)] * (up + down) < down else y - down * u
        at += 1
        y[y < 1e-9], y[y > 1 - 1e-9] = 0, 1
        x[hold] = y
        hold = [i for i in hold if 0 < x[i] < 1]


def landing(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the last HELD + 2 fractional units at most: the choice nearest to the totals of words and documents."""
    free = np.flatnonzero((x > 0) & (x < 1))
    options = (np.arange(2 ** len(free))[:, None] >> np.arange(len(free))) & 1
    off = options - x[free]
    cost = np.abs(off @ size[free]) + DOCUMENT * size[free].mean() * np.abs(off.sum(axis=1)) if len(free) else np.zeros(1)
    x = x.copy()
    x[free] = options[cost.argmin()]
    return x


def selected(x: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Takes every unit or none, near the totals of x and x * size: a flight without the held units, then the landing."""
    free = np.flatnonzero((x > 0) & (x < 1))
    rest = np.ones(len(x), bool)
    rest[free[np.linspace(0, len(free) - 1, min(HELD, len(free))).astype(int)]] = False
    y = x.copy()
    y[rest] = flight(x[rest], size[rest], rng)
    return landing(y, size)


def _balance(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "of"], ascending=[False, True, True], kind="stable")
        name = rows["source"].iloc[0]
        rng = np.random.default_rng([zlib.crc32(str(name).encode()), int(rows["block"].iloc[0]), int(rows["level"].iloc[0])])
        size = rows["size"].to_numpy("float64")
        x = rows["x"].to_numpy("float64")
        return rows.assign(x=selected(x, size, rng) if last else flight(x, size, rng))

    return run


def mix(scratch: Scratch, docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """(doc_id, of, source, size, source_size, target, copies, taken): how often the mix takes each document.

    A document is taken floor(target / source_size) times for certain and once more if the cube method selects it.
    """
    units = scratch.save(sizes(docs).withColumn("row", F.monotonically_increasing_id()))
    per = targets(units, weights, budget, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = units.join(per, units["source"].eqNullSafe(per["source"])).drop(per["source"])
    sure = F.floor(ratio + 1e-9).cast("int")
    rows = rows.withColumn("sure", sure).withColumn("x", F.when(F.col("size") > 0, F.greatest(ratio - sure, F.lit(0.0))).otherwise(0.0))
    repeated = units.groupBy(F.col("doc_id").alias("id"), F.col("of").alias("text")).agg(F.count("*").alias("held")).where("held > 1")
    rows = rows.join(repeated, rows["doc_id"].eqNullSafe(repeated["id"]) & (rows["of"] == repeated["text"]), "left").drop("id", "text")
    # equal rows differ in their number only
    rows = scratch.save(rows.withColumn("salt", F.when(F.col("held").isNotNull(), F.col("row")).otherwise(F.lit(0).cast("long"))).drop("held", "row"))
    done, left = [rows.where("x <= 1e-9").withColumn("x", F.lit(0.0))], rows.where("x > 1e-9")
    for level in range(12):
        per_source = left.groupBy("source").agg(F.count("*").alias("units"))
        most = per_source.agg(F.max("units")).first()[0] or 0
        if not most:
            break
        last = most <= block
        blocks = left.join(per_source, left["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
        blocks = blocks.withColumn("block", F.pmod(F.xxhash64("doc_id", "of", "salt"), F.ceil(F.col("units") / block)).cast("long")).withColumn("level", F.lit(level)).drop("units")
        out = scratch.save(blocks.groupBy("source", "block").applyInPandas(_balance(last), blocks.schema).drop("block", "level"))
        done.append(out if last else out.where("x = 0 or x = 1"))
        if last:
            break
        left = out.where("x > 0 and x < 1")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    copies = (F.col("sure") + F.round("x").cast("int")).cast("int")
    return whole.select("doc_id", "of", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(Scratch(spark, "mix"), table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
