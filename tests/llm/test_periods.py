import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import periods
from tests.llm.helpers import docs_of


def brute(words):
    """Runs by trying every period; a stretch whose smallest period divides it further is listed with that one."""
    out, seen, n = [], set(), len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q) and (s, i + q) not in seen:
                seen.add((s, i + q))
                out.append((s, i + q - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


def expand(symbol, base, left, right):
    todo, out = [symbol], []
    while todo:
        s = todo.pop()
        todo += [right[s - base], left[s - base]] if s >= base else []
        out += [s] if s < base else []
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_grammar_derives_the_words(words):
    symbols, places, left, right = periods.repair(np.array(words, np.int64))
    base = max(words, default=-1) + 1
    texts = [expand(s, base, left, right) for s in symbols.tolist()]
    assert [w for t in texts for w in t] == words and places.tolist() == [sum(map(len, texts[:k])) for k in range(len(texts))]
    pairs = list(zip(symbols.tolist(), symbols[1:].tolist()))  # noqa: B905
    assert all(pairs.count(p) < 2 or p[0] == p[1] for p in pairs)


block = st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.integers(1, 30))


@settings(max_examples=400, deadline=None)
@given(st.lists(block, max_size=8), st.integers(0, 8))
def test_runs_of_nested_repeats(blocks, cut):
    words = [w for b, n in blocks for w in (b * n)[: -cut or None]]
    words += words[: len(words) // 2] * 3
    assert [tuple(r) for r in periods.runs(np.array(words, np.int64), np.zeros(len(words), np.int64)).tolist()] == brute(words)


def test_runs_do_not_leave_their_part():
    words, part = np.array([1, 2, 3] * 40), np.repeat([0, 1, 2], [30, 20, 70])
    assert periods.runs(words, part).tolist() == [[0, 30, 3], [50, 70, 3]]


def test_a_wrong_hash_is_noticed(monkeypatch):
    """With hashes that call everything equal the stretches are compared, and other hashes are taken."""
    right = periods.Hashes.__call__
    seeds = []

    def wrong(self, at, size):
        return right(self, at, size) * np.uint64(self.seed > 0)

    made = periods.Hashes.__init__

    def init(self, words, seed):
        made(self, words, seed)
        self.seed = seed
        seeds.append(seed)

    monkeypatch.setattr(periods.Hashes, "__init__", init)
    monkeypatch.setattr(periods.Hashes, "__call__", wrong)
    words = np.array([*range(10), *[20, 21, 22] * 10, *range(10)])
    assert periods.runs(words, np.zeros(len(words), np.int64)).tolist() == [[10, 30, 3]] and seeds == [0, 1]


TEXTS = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "x " + "a b c d e f g h " * 3, "a b c d e f g h i " * 2 + "a b c d e f g h", "é ß\x0bé ß\x0c" * 30, "w " * 50_000, "a b " * 30 + "a c " * 30, " ".join(f"u{i}" for i in range(3000)), " ".join(f"v{i}" for i in range(700)) * 1 + " " + " ".join([" ".join(f"z{i}" for i in range(500))] * 7)]


def rows_of(df):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in df.collect()), key=str)


def test_edges_and_extra_columns(spark):
    docs = docs_of(spark, TEXTS).selectExpr("*", "1 as words", "2 as start", "3 as runs")
    small = [i for i in range(len(TEXTS)) if i != 9]
    got = rows_of(periods.digests(docs))
    want = {}
    for i in small:
        r = brute(re.findall(rb"[^\x20\x09-\x0D]+", (TEXTS[i] or "").encode()))
        want[i] = r
    assert {g[0]: g[1] for g in got if g[0] != 9} == {i: len(r) for i, r in want.items()}
    runs = {r.doc_id: ([(x.start, x.length, x.period) for x in r.runs], r.text) for r in periods.find_runs(docs).collect()}
    assert {i: runs[i][0] for i in small} == want and runs[9] == ([(0, 50_000, 1)], "w") and runs[5][1] == "a" and runs[0][1] == ""
    assert periods.digests(docs.limit(0)).count() == 0
    null = docs_of(spark, ["a " * 30] * 2).selectExpr("cast(null as long) doc_id", "text")
    assert [r[:5] for r in rows_of(periods.digests(periods.planted(null)))] == [(None, 1, 0, 30, 1)] * 2


def test_contract_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *contract(r.doc_id, r.text)) for r in docs), key=str)
    got = rows_of(periods.query(spark, sf))
    assert got == want and sum(r[1] > 0 for r in got) >= 10


def test_calls_do_not_change_results(monkeypatch):
    texts = [t for t in TEXTS if len(t or "") < 20_000] * 3
    whole = [[r.tolist() for r in periods._runs_of(part)] for _, part in periods._calls(texts)]
    monkeypatch.setattr(periods, "CALL_WORDS", 60)
    parts = [[r.tolist() for r in periods._runs_of(part)] for _, part in periods._calls(texts)]
    assert len(whole) == 1 and len(parts) > 5 and sum(parts, []) == whole[0]
