import numpy as np
import pytest

from marketlens.llm import nearcopies, neighbours
from marketlens.llm.shared import Scratch
from tests.llm.helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int, dim int"


def vectors(spark):
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(6, 8))
    for i in range(240):
        v = base[i % 6] + rng.normal(size=8) * (0.02 if i % 4 else 0.5)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3, 1))
    rows += [(300, None, 1, 1), (301, [0.0] * 8, 1, 1), (302, [float("nan")] * 8, 1, 1), (303, rows[0][1], None, 1), (304, [1.0, None], 0, 1), (305, [1.0, 2.0], 0, 1)]
    rows += [(306 + k, rows[5][1], rows[5][2], 1) for k in range(4)]
    return spark.createDataFrame(rows, SCHEMA), rows


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("per_pivot", [2000, 10])
def test_near_copies(spark, monkeypatch, per_pivot):
    monkeypatch.setattr(nearcopies, "PER_PIVOT", per_pivot)
    df, rows = vectors(spark)
    ok = {i: (np.array(v, float), g) for i, v, g, _ in rows if good(v) and g is not None}
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.93]
    comp = components([r[0] for r in rows], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nearcopies.near_copies(Scratch(spark, "t"), df).collect()}
    assert len(links) > 100
    assert got == {i: (sum(i in e for e in links), comp[i], comp[i] == i) for i in comp}


def test_empty_tables(spark):
    df, _ = vectors(spark)
    assert nearcopies.near_copies(Scratch(spark, "t"), df.limit(0)).count() == 0
    assert neighbours.nearest(Scratch(spark, "t"), df.limit(0)).count() == 0


def recall(spark, df, every):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if good(r.embedding)]
    got: dict = {}
    for r in neighbours.nearest(Scratch(spark, "t"), df, every).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q, v in rows:
        if q % every == 0:
            true = sorted((-float(v @ x), i) for i, x in rows if i != q and len(x) == len(v))[:20]
            found = [got[q][k] for k in range(1, len(got[q]) + 1)]
            assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == min(20, len(true)) and q not in {f[0] for f in found}
            hits += len({i for _, i in true} & {f[0] for f in found})
            total += len(true)
    return hits / total


def test_neighbours_recall(spark, sf, monkeypatch):
    df, _ = vectors(spark)
    assert recall(spark, df.where("vec_id not in (304, 305)"), 7) >= 0.9
    assert recall(spark, spark.read.parquet(f"{sf}/embeddings.parquet"), 20) >= 0.9
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 8)
    assert recall(spark, spark.read.parquet(f"{sf}/embeddings.parquet"), 20) >= 0.9


def test_ties_over_blocks_go_to_the_smaller_id(spark, monkeypatch):
    """Vectors that 24 rows share, dealt to several blocks and leaves: tied scores are equal to the last bit."""
    monkeypatch.setattr(neighbours, "BLOCK", 500)
    rng = np.random.default_rng(3)
    kinds = rng.normal(size=(60, 16)).astype("float32")
    of = rng.permutation(np.repeat(np.arange(60), 24))
    rows = [(i, kinds[k].tolist(), 0) for i, k in enumerate(of)]
    found: dict = {}
    for r in neighbours.nearest(Scratch(spark, "ties"), spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = kinds[of].astype("float64")
    scores = np.einsum("id,jd->ij", x, x)
    assert len(found) == 72
    missed = 0
    for at, got in found.items():
        order = [j for j in np.lexsort((np.arange(len(x)), -scores[at])) if j != at][:20]
        missed += len(set(order) - {v for _, v, _ in got})
        ranked = sorted(got)
        assert [(-s, v) for _, v, s in ranked] == sorted((-s, v) for _, v, s in ranked)
        assert all(s == scores[at, v] for _, v, s in ranked)
    assert missed <= 0.1 * 72 * 20
