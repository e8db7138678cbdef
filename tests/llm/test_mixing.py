import re

import numpy as np
import pytest

from marketlens.llm import mixing
from marketlens.llm.shared import Scratch
from tests.llm.helpers import docs_of


def targets(sizes):
    """Resharing done step by step: sizes by source, in order of weights."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def check(spark, docs, block=mixing.BLOCK):
    rows = docs.collect()
    out = mixing.mix(Scratch(spark, "t"), docs, block=block)
    got = sorted(((r.doc_id, r.source or "", r.size, r.taken, r.target, r.source_size) for r in out.collect()))
    again = sorted(((r.doc_id, r.source or "", r.size, r.taken, r.target, r.source_size) for r in mixing.mix(Scratch(spark, "t"), docs, block=block).collect()))
    assert got == again and len(got) == len(rows)
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = {s or "": t for s, t in targets(size).items()}
    taken = {}
    for _, s, n, t, target, total in got:
        assert t <= 2 * n and total == {k or "": v for k, v in size.items()}[s] and abs(target - want[s]) < 1e-6 * max(1, want[s])
        taken[s] = taken.get(s, 0) + t
    return taken, want, got


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf, folder):
    taken, want, _ = check(spark, spark.read.parquet(f"{sf}/../{folder}/documents.parquet"))
    assert all(abs(taken[s] - want[s]) <= max(60, 0.02 * want[s]) for s in want)


def test_blocks_nulls_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    texts = [None, ""] + ["w " * int(n) for n in rng.integers(1, 60, 600)]
    docs = docs_of(spark, texts, ["big" if i % 3 else None if i % 2 else "é" for i in range(len(texts))]).selectExpr("*", "1 as size", "2 as block", "3 as target")
    taken, want, _ = check(spark, docs.unionByName(docs.limit(40)), block=50)
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert mixing.mix(Scratch(spark, "t"), docs.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    size, x = rng.integers(1, 500, 400).astype(float), rng.random(400)
    y = mixing.flight(x, size, rng)
    assert ((y > 0) & (y < 1)).sum() <= 2 and abs(y.sum() - x.sum()) < 1e-6 and abs(y @ size - x @ size) < 1e-4
    for _ in range(20):
        z = mixing.selected(x, size, rng)
        assert set(z.tolist()) <= {0.0, 1.0} and abs(z @ size - x @ size) <= 3 and abs(z.sum() - x.sum()) <= 1.5


def test_few_units_are_landed_by_all_choices():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 12, 13):
        size, x = rng.integers(1, 9, n).astype(float), rng.random(n)
        z = mixing.selected(x, size, rng)
        assert set(z.tolist()) <= {0.0, 1.0} and abs(z @ size - x @ size) <= max(size, default=0)


def test_repeated_rows_are_dealt_apart(spark):
    docs = docs_of(spark, ["w " * 7] * 3).limit(1)
    for _ in range(7):
        docs = docs.unionByName(docs)
    out = mixing.mix(Scratch(spark, "t"), docs, block=20).collect()
    assert len(out) == 128 and abs(sum(r.taken for r in out) - 1.5 * 128 * 7) <= 7 and {r.copies for r in out} == {1, 2}
