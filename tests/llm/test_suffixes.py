import hashlib
import random

import pytest

from marketlens.llm import suffixes
from marketlens.llm.shared import Scratch
from tests.llm.helpers import docs_of, read_texts


def brute(texts):
    """What must be left, from all 200-byte strings of all texts."""
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen: dict = {}
    for b in raw.values():
        for p in range(len(b) - 199):
            k = b[p : p + 200]
            seen[k] = seen.get(k, 0) + 1
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def check(spark, docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup_substrings(Scratch(spark, "t"), docs).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("alphabet,length", [(2, 40), (3, 7), (1, 12), (5, 1)])
def test_suffix_order(spark, alphabet, length):
    rng = random.Random(alphabet)
    strings = {c: [rng.randrange(alphabet) for _ in range(rng.randrange(length))] + [-2 - c] for c in range(12)}
    rows = [(c, i, s, 1) for c, t in strings.items() for i, s in enumerate(t)]
    df = spark.createDataFrame(rows, "cid long, i long, s long, b long")
    got = [(r.cid, r.i) for r in suffixes.suffix_order(Scratch(spark, "t"), df).orderBy("rank").collect()]
    assert got == sorted(((c, i) for c, t in strings.items() for i in range(len(t))), key=lambda x: strings[x[0]][x[1] :])


def test_whole_table(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"), read_texts(spark, sf))


def test_edges(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(300), prose(60)
    changed = base[:700] + "X" + base[701:]
    texts = [None, "", "short", base, base, changed, prose(50) + passage + prose(40), passage + prose(30), prose(30) + passage, "ab" * 400, "ab" * 99, "z" * 900, prose(80), passage[:199], passage[:230] + "!", base[100:420], "c" * 199 + "d", "d" + "c" * 199]
    texts += [base[k : k + 260] + prose(3) for k in (0, 13, 77)]
    check(spark, docs_of(spark, texts).selectExpr("*", "1 as doc", "2 as uid", "3 as x"), dict(enumerate(texts)))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = docs_of(spark, ["q" * 50 + "w" * 400, "unlike " * 3])
    assert suffixes.dedup_substrings(Scratch(spark, "t"), docs.limit(0)).count() == 0
    twice = docs.limit(1).unionByName(docs.limit(1)).unionByName(docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    assert sorted((r.doc_id is None, r.n_removed) for r in suffixes.dedup_substrings(Scratch(spark, "t"), twice).collect()) == [(False, 450), (False, 450), (True, 0), (True, 450)]


def test_ids_with_several_texts(spark):
    rng = random.Random(3)
    s, x = "".join(rng.choice("abcdefgh") for _ in range(419)), "".join(rng.choice("ijkl") for _ in range(300))
    docs = spark.createDataFrame([(5, s + "a"), (7, "b" + s), (3, x), (5, x), (None, s + "a"), (None, "c" + s[:250])], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.dedup_substrings(Scratch(spark, "t"), docs).collect())
    assert got == sorted([(5, 420, 420), (7, 420, 419), (3, 300, 300), (5, 300, 300), (0, 420, 420), (0, 251, 250)])


def test_the_order_of_suffixes_decides(spark, monkeypatch):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(330))
    texts = ["".join(rng.choice("stuvw") for _ in range(50 + k)) + passage + "".join(rng.choice("xyz") for _ in range(60)) for k in range(40)]
    check(spark, docs_of(spark, texts), dict(enumerate(texts)))
    order = suffixes.suffix_order

    def disturbed(scratch, symbols):
        return scratch.save(order(scratch, symbols).selectExpr("cid", "i", "s", "xxhash64(cid, i) as rank"))

    monkeypatch.setattr(suffixes, "suffix_order", disturbed)
    with pytest.raises(AssertionError):
        check(spark, docs_of(spark, texts), dict(enumerate(texts)))


def test_windows_are_cut_for_a_whole_batch(spark):
    """Each window with its run and its bytes before the anchor; no loop over windows in Python."""
    rows = [(7, 3, 5, b"abcdefgh", list(range(100, 156))), (8, 1, 0, b"xyz", list(range(200, 256))), (9, 2, 55, bytes(range(60)), list(range(56)))]
    strings = spark.createDataFrame(rows, "cid long, n int, left int, raw binary, runs array<long>").coalesce(1)
    got = [(r.run, bytes(r.before), r.cid, r.at) for r in suffixes.windows(strings).collect()]
    assert sorted(got, key=str) == sorted(((of[left - at], raw[at:left], cid, at) for cid, n, left, raw, of in rows for at in range(n)), key=str)
    assert suffixes.windows(strings.limit(0)).count() == 0
    assert not [c for c in suffixes.windows.__code__.co_consts if getattr(c, "co_name", "") == "run" and "to_pylist" in c.co_names]


def test_common_prefixes(spark):
    pairs = [(b"abc", b"abd"), (b"abc", b"abc"), (b"abc", b"ab"), (b"", b"x"), (b"\x00\x00a", b"\x00\x00b"), (b"x", None), (b"a" * 300, b"a" * 299 + b"b")]
    rows = spark.createDataFrame([(i, i, 0, *p) for i, p in enumerate(pairs)], "cid long, place long, part long, tail binary, before binary")
    assert {r.cid: r.lcp for r in suffixes.common_prefixes(rows).collect()} == dict(enumerate([2, 3, 2, 0, 2, 0, 299]))
