"""Periodic runs of words, found in a grammar-compressed text.

A run is a maximal stretch of words with smallest period q, at least three periods and LEAST words long. Re-Pair turns
the words into a grammar: the most frequent pair of neighbours becomes a nonterminal until no pair repeats. Every run
crosses the boundary between the two halves of exactly one lowest node of the derivation, so the runs that cross a
nonterminal's boundary are computed once, at one of its places, and translated to all places where it is derived; what
no rule covers is a balanced tree whose nodes occur once. Pieces of a run that lower nodes see are parts of the whole
one that a higher node sees, so the maximal intervals of each period are the runs. A stretch in which every window of
WINDOW words occurs once in its document can't lie in a run and is not compressed.

Nulls and edges: a null text has no words and no runs; texts of any length are taken whole, each by one task, in memory
that follows its words; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import WORD, table

LEAST, PERIODS = 24, 3
#: A run has LEAST words and three periods, so its first LEAST - LEAST / 3 words occur once more, a period later.
WINDOW = LEAST - LEAST // PERIODS
#: Words that are worked on at once, if one text has not more.
CALL_WORDS = 300_000
#: Arrow and Spark types of the columns.
RUN = {"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}
KINDS = {"long": (pa.int64(), "long"), "string": (pa.string(), "string"), "runs": (pa.list_(pa.struct(RUN.items())), "array<struct<start:long,length:long,period:long>>")}


def repair(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """(start symbols, their places, left and right halves of the rules) of the Re-Pair grammar of word numbers.

    Rule r is nonterminal base + r, where base is one more than the largest word. Among equally frequent pairs the
    older goes first, which keeps derivations shallow.
    """
    n, base = len(words), int(words.max(initial=-1)) + 1
    seq, after, before = words.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    wide = base + n + 1
    codes = words[:-1].astype(np.int64) * wide + words[1:]
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    groups = [g for g in np.split(order, cuts) if len(g) > 1]
    where = {int(codes[g[0]]): g.tolist() for g in groups}
    count = {pair: len(at) for pair, at in where.items()}
    heap = [(-len(at), at[0], pair) for pair, at in where.items()]
    heapify(heap)
    left, right, age = [], [], n
    while heap:
        much, since, pair = heappop(heap)
        held = count[pair]
        if held != -much:
            if held > 1:
                heappush(heap, (-held, since, pair))
            continue
        a, b = divmod(pair, wide)
        new, fresh, used = base + len(left), {}, False
        for i in where.pop(pair):
            if seq[i] != a or (j := after[i]) >= n or seq[j] != b:
                continue
            k, h, used = after[j], before[i], True
            seq[i], seq[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
                if (old := b * wide + seq[k]) in count:
                    count[old] -= 1
                fresh.setdefault(new * wide + seq[k], []).append(i)
            if h >= 0:
                if (old := seq[h] * wide + a) in count:
                    count[old] -= 1
                fresh.setdefault(seq[h] * wide + new, []).append(h)
        count[pair] = 0
        if used:
            left.append(a)
            right.append(b)
        for made, at in fresh.items():
            if len(at) > 1:
                where[made], count[made], age = at, len(at), age + 1
                heappush(heap, (-len(at), age, made))
    seq = np.array(seq, np.int64)
    at = np.flatnonzero(seq >= 0)
    return seq[at], at, left, right


class Hashes:
    """Hashes of stretches of a word sequence: equal stretches have equal ones, others almost never."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        factor = rng.integers(0, 1 << 63, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        value = rng.integers(0, 1 << 63, int(words.max(initial=0)) + 1, dtype=np.uint64)[words]
        inverse = np.uint64(pow(int(factor), -1, 1 << 64))
        powers = lambda f: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(words), f, np.uint64))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * powers(factor)[:-1])))
        self.back, self.n = powers(inverse), len(words)

    def __call__(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def agree(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many words from i and j on (way 1) or before them (way -1) are equal, at most so many."""
        done = np.zeros(len(i), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            more = done + (1 << bit)
            can = np.flatnonzero(more <= most)
            step, p, q = more[can], i[can], j[can]
            same = self(p, step) == self(q, step) if way > 0 else self(p - step, step) == self(q - step, step)
            done[can[same]] = step[same]
        return done


def crossing(hashes: Hashes, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the stretches of [low, high) that cross mid and are runs, or parts of one, there.

    Of a run of period q, one side of mid has 1.5 q words at least, so as many words as q / 2 (or four) from mid on, or
    up to it, occur once more q places on, or before. Periods are tried by powers of two, each with that many words.
    """
    found = []
    level = 0
    while PERIODS << level <= int((high - low).max(initial=0)):
        size = max(LEAST // 6, 1 << level - 1 if level else 0)
        grams = np.unique(hashes(np.arange(hashes.n - size + 1), size), return_inverse=True)[1].astype(np.int64)
        keys = grams * (hashes.n + 1) + np.arange(len(grams))
        keys.sort()
        for way in (1, -1):
            at = mid if way > 0 else mid - size
            ok = np.flatnonzero((high - low >= max(LEAST, PERIODS << level)) & (at >= low) & (at + size <= high))
            near, far = 1 << level, np.minimum((2 << level) - 1, (high - low)[ok] // PERIODS)
            base = grams[at[ok]] * (hashes.n + 1) + at[ok]
            first = np.searchsorted(keys, base + near if way > 0 else base - far, "left")
            last = np.searchsorted(keys, base + far if way > 0 else base - near, "right")
            many = np.maximum(last - first, 0)
            node = np.repeat(ok, many)
            other = keys[np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] % (hashes.n + 1)
            period = np.abs(other - at[node])
            i, j = (mid[node], mid[node] + period) if way > 0 else (mid[node] - period, mid[node])
            inside = np.flatnonzero((i >= low[node]) & (j <= high[node]))
            node, period, i, j = node[inside], period[inside], i[inside], j[inside]
            start = i - hashes.agree(i, j, i - low[node], -1)
            end = j + hashes.agree(i, j, high[node] - j, 1)
            whole = (start < mid[node]) & (end > mid[node]) & (end - start >= np.maximum(LEAST, PERIODS * period))
            found.append(np.stack((node, start, end, period))[:, whole])
        level += 1
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 4


def _tree(places: np.ndarray, ends: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, mid, high) of the nodes of a balanced tree over the start symbols of each part."""
    out = [np.zeros((3, 0), np.int64)]
    while len(part) and (part[1:] == part[:-1]).any():
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        index = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
        even = index % 2 == 0
        paired = np.flatnonzero(even & np.append(part[1:] == part[:-1], False))
        out.append(np.stack((places[paired], places[paired + 1], ends[paired + 1])))
        ends = ends.copy()
        ends[paired] = ends[paired + 1]
        places, ends, part = places[even], ends[even], part[even]
    return tuple(np.concatenate(out, axis=1))


def runs(words: np.ndarray, part: np.ndarray, seed: int = 0) -> np.ndarray:
    """(start, length, period) rows, by start and period, of the runs of word numbers inside stretches of one part each."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    # a word of its own between two parts
    gaps = np.flatnonzero(part[1:] != part[:-1]) + 1
    base = int(words.max()) + 1
    text = np.insert(words, gaps, base + np.arange(len(gaps)))
    parts = np.insert(part, gaps, -1)
    symbols, places, left, right = repair(text)
    base += len(gaps)
    size = np.ones(base + len(left), np.int64)
    for r, (a, b) in enumerate(zip(left, right, strict=True)):
        size[base + r] = size[a] + size[b]
    long = np.flatnonzero(size[base:] >= LEAST)
    place = np.full(len(size), -1, np.int64)
    place[symbols] = places
    for r in long[::-1].tolist():
        at = place[base + r]
        place[left[r]], place[right[r]] = at, at + size[left[r]]
    halves = np.array(left, np.int64)[long] if len(long) else np.zeros(0, np.int64)
    low = place[base + long]
    inner = symbols[parts[places] >= 0]
    where = places[parts[places] >= 0]
    top = _tree(where, where + size[inner], parts[where])
    low, mid, high = np.append(low, top[0]), np.append(low + size[halves], top[1]), np.append(low + size[base + long], top[2])
    node, start, end, period = crossing(Hashes(text, seed), low, mid, high)
    # all derivations of the nonterminals that have pieces
    once = node >= len(long)
    pieces = [np.stack((start, end, period))[:, once]]
    mine = {}
    for k, s, e, q in zip(*(x[~once].tolist() for x in (node, start, end, period)), strict=True):
        mine.setdefault(int(long[k]), []).append((s - low[k], e - s, q))
    needed = {base + r for r in mine}
    for r in long.tolist():
        if left[r] in needed or right[r] in needed:
            needed.add(base + r)
    derived = {}
    for s, at in zip(symbols.tolist(), places.tolist(), strict=True):
        if s in needed:
            derived.setdefault(s, []).append(np.array([at]))
    for r in long[::-1].tolist():
        if base + r in needed:
            at = np.concatenate(derived.pop(base + r))
            for child, shift in ((left[r], 0), (right[r], size[left[r]])):
                if child in needed:
                    derived.setdefault(child, []).append(at + shift)
            for offset, length, q in mine.get(r, ()):
                pieces.append(np.stack((at + offset, at + offset + length, np.full(len(at), q))))
    out = _maximal(np.concatenate(pieces, axis=1))
    for s, e, q in out.T.tolist():
        if not np.array_equal(text[s : e - q], text[s + q : e]):
            return runs(words, part, seed + 1)  # two different stretches had one hash
    shift = np.searchsorted(gaps + np.arange(len(gaps)), out[0])
    out = np.stack((out[0] - shift, out[1] - out[0], out[2]), axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _maximal(pieces: np.ndarray) -> np.ndarray:
    """(start, end, period) columns: the intervals of each period that no other one contains, with their smallest period."""
    start, end, period = pieces[:, np.lexsort((-pieces[1], pieces[0], pieces[2]))]
    if not len(start):
        return pieces
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(period * wide + end)
    keep = np.concatenate(([True], (period * wide + end)[1:] > reach[:-1]))
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
    return np.stack((start, end, period))[:, first]


def _runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text of a list of word lists."""
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    hashed = np.fromiter((hash(w) for t in texts for w in t), np.int64, sizes.sum()).view(np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if len(hashed) < LEAST:
        return out
    # windows that occur again in their text; a hash that two of them share only adds stretches
    factors = np.random.default_rng(1).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(hashed) - WINDOW + 1
    mixed = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        mixed += (hashed[k : k + n] ^ hashed[k : k + n] >> np.uint64(29)) * factors[k]
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again &= doc[:n] == doc[WINDOW - 1 :]
    change = np.zeros(len(hashed) + 1, np.int64)
    change[:n] += again
    change[WINDOW : n + WINDOW] -= again
    kept = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    if not len(kept):
        return out
    gap = np.concatenate(([0], (kept[1:] != kept[:-1] + 1) | (doc[kept[1:]] != doc[kept[:-1]])))
    numbers, ids = {}, np.empty(len(kept), np.int64)
    for k, (d, i) in enumerate(zip(doc[kept].tolist(), (kept - begin[doc[kept]]).tolist(), strict=True)):
        ids[k] = numbers.setdefault(texts[d][i], len(numbers))
    found = runs(ids, np.cumsum(gap))
    found[:, 0] = kept[found[:, 0]]
    of = doc[found[:, 0]]
    for d in np.unique(of):
        out[d] = found[of == d] - [begin[d], 0, 0]
    return out


def _calls(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Word lists of some texts at a time, with the place of the first one."""
    part, first, held = [], 0, 0
    for i, text in enumerate(texts):
        part.append((text or "").encode().split())
        held += len(part[-1])
        if held >= CALL_WORDS:
            yield first, part
            part, first, held = [], i + 1, 0
    if part:
        yield first, part


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words, joined by blanks, without what a run has after its first period."""
    if not len(found):
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found.tolist():
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _mapped(docs: DataFrame, row, fields: dict[str, str]) -> DataFrame:
    """row(words, runs) for each document, as the fields (arrow types by name) behind its doc_id."""
    kinds = [KINDS[k][0] for k in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _calls(batch.column(1).to_pylist()):
                rows = [row(words, found) for words, found in zip(texts, _runs_of(texts), strict=True)]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([batch.column(0)[at : at + len(rows)], *columns], names=["doc_id", *fields])

    schema = ", ".join(f"{name} {KINDS[k][1]}" for name, k in {"doc_id": "long", **fields}.items())
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, text): all runs of each document (word number, words, period) and its text without their repeats."""
    row = lambda words, found: ([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()], collapsed(words, found).decode())
    return _mapped(docs, row, {"runs": "runs", "text": "string"})


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): what find_runs() gives, as digests."""

    def row(words: list[bytes], found: np.ndarray) -> tuple:
        all_runs = found.tolist()
        best = min(all_runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in all_runs)
        most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return len(all_runs), *most, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest()

    return _mapped(docs, row, dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), "long") | dict.fromkeys(("runs_sha256", "collapsed_sha256"), "string"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each document whose crc32 of the id ends in 0 repeats a stretch of its words up to its end.

    With g, the other digits of the crc32, words from a = g mod n on have the period 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10).cast("long"), F.size("words").cast("long")

    def word(i: Column) -> Column:
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.get("words", F.when(i < a, i).otherwise(a + (i - a) % period).cast("int"))

    chosen = F.when((h % 10 == 0) & F.col("text").rlike(WORD), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    cut = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("words", chosen)
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return cut.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(text).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(planted(table(spark, sf_dir, "documents")))
