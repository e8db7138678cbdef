import hashlib
import re
import zlib

import pytest

from marketlens.llm import merkle
from marketlens.llm.shared import Scratch
from tests.llm.helpers import docs_of


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(part(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(digests):
    """(root, siblings before and after each digest, level by level)."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + 16] for i in range(0, len(digests), 16)]
        for k, p in enumerate(at):
            run = runs[p // 16]
            paths[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        at, digests = [p // 16 for p in at], [sha("".join(r)) for r in runs]
    return digests[0], paths


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s] = sorted(sources[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    low = {s: tree([leaf(r, r.text) for r in sources[s]]) for s in names}
    root, high = tree([low[s][0] for s in names])
    out = []
    for s, above in zip(names, high, strict=True):
        for r, below in zip(sources[s], low[s][1], strict=True):
            path = below + above
            lower = r.text and "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            folded = leaf(r, lower if bad else r.text)
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((r.doc_id, leaf(r, r.text), low[s][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, docs):
    out = merkle.audit(Scratch(spark, "t"), docs)
    assert out.columns == COLUMNS
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == brute(docs.select("doc_id", "source", "lang", "n_chars", "text").collect())
    return got


def test_whole_table(spark, sf):
    got = check(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_one_source(spark, n):
    check(spark, docs_of(spark, [f"Text {i}" for i in range(n)], ["only"] * n))


def test_sources_of_all_sizes_nulls_repeats_and_extra_columns(spark):
    texts, sources = [], []
    for i, n in enumerate([1, 1, 2, 15, 16, 17, 31, 257, 3, 1, 1, 1, 5, 1, 1, 1, 1, 40, 1]):
        texts += [None if k % 7 == 3 else "" if k % 7 == 5 else f"Some TEXT é {k}" for k in range(n)]
        sources += [None if i == 3 else "" if i == 4 else f"{'é' if i % 2 else 'Z'}{i}"] * n
    docs = docs_of(spark, texts, sources)
    odd = docs.where("doc_id % 9 = 0").selectExpr("cast(null as long) doc_id", "text", "cast(null as string) lang", "source", "cast(null as long) n_chars")
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id % 11 = 0")).selectExpr("*", "1 as rank", "2 as n", "3 as leaf", "4 as tree")
    check(spark, docs)


def test_empty_table_and_long_text(spark):
    assert merkle.audit(Scratch(spark, "t"), docs_of(spark, ["a"]).limit(0)).count() == 0
    check(spark, docs_of(spark, ["A" * 2_000_000, "b"]))


def test_equal_rows_and_hot_nodes(spark, monkeypatch):
    """All leaves climb through the nodes near the root, which are dealt over copies."""
    monkeypatch.setattr(merkle, "HOT", 16)
    docs = spark.range(1000).selectExpr("cast(7 as long) doc_id", "'same' text", "'en' lang", "'s' source", "cast(4 as long) n_chars")
    check(spark, docs)


def test_proofs_verify_by_themselves(spark, sf):
    """The siblings of a proof and the leaf's place give the root without the tree."""
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = merkle.build(scratch, docs)
    ranks = {r.doc_id: (r.rank, r.n) for r in made.leaves.collect()}
    tops = sorted(r.source for r in made.roots.collect())
    for r in merkle.prove(scratch, made).collect():
        assert r.folded_root == made.root
        rank, n = ranks[r.doc_id]
        left, now = re.findall("(?s).{64}", r.proof.hex()), r.leaf.hex()
        for at, size in ((rank, n), (tops.index(r.source), len(tops))):
            while size > 1:
                many = min(16, size - at // 16 * 16) - 1
                run, left = left[:many], left[many:]
                now = sha("".join(run[: at % 16]) + now + "".join(run[at % 16 :]))
                at, size = at // 16, -(-size // 16)
        assert not left and now == made.root.hex()
