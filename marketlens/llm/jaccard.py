"""N-gram Jaccard join by partitioning the universe of shingles.

Documents become sets of word shingles (64-bit hashes). Equal sets are one class. For each size band the hash range is
cut into segments, more than the largest symmetric difference that two linked sets of the band may have, so that linked
sets agree on at least one segment (pigeonhole), and on one that is not empty where segments are to spare. Sets are indexed by the subset that falls into each segment.
Where the counts over all documents show a segment to be far more crowded than others of its band, the allocation
moves its share to uncrowded ones, which then also index their one-deletion neighbourhoods and so tolerate one
difference. Candidates pass an exact lower bound of the difference (parity sketches) and are verified on the sets.

Sets that share a segment are first joined with the least and the largest of them only. What is then still in
different components is compared pair by pair; pairs inside a component could not change it. So no group of near
copies is expanded into all its pairs, and no link between components is lost.

Nulls and edges: null and empty texts have the empty set, which links with nothing; a null id is its own component
(null); rows with the same id are taken to have the same text and all come back; very long texts have as many segments
as their size asks for; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import Scratch, connect, if_small, sharing, table

U = np.uint64
MOST_MEMO = 300_000
#: A segment is crowded if its pairs are so many times the median of its band and outweigh what is indexed instead.
CROWDED = 8
#: Parity sketch of a set: 1,024 bits.
SKETCH = [f"s{i}" for i in range(16)]


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


class Shingler:
    """Sorted distinct hashes of the word shingles of a text; a shorter text is one shingle."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, U)
        memo = self.memo
        if len(memo) > MOST_MEMO:
            memo.clear()
        try:
            ids = [memo[w] for w in words]
        except KeyError:
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            ids = [memo[w] for w in words]
        w = np.array(ids, U)
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, U(k))
        for j in range(k):
            h = mix(h * U(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j])
        return np.unique(h)


class Bands:
    """Size bands for links of at least num / den: linked sets lie in one band or in adjacent ones."""

    def __init__(self, num: int, den: int, most: int = 1 << 31):
        self.num, self.den, self.edges, self.cut = num, den, [1], {}
        while self.edges[-1] < most:
            self.edges.append(self.edges[-1] * den // num + 1)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def difference(self, total: int) -> int:
        """The largest symmetric difference of linked sets with so many elements in total."""
        return total * (self.den - self.num) // (self.den + self.num)

    def segments(self, tag: int) -> int:
        """Segments for pairs whose larger set is in band tag; 1 means that only equal sets link.

        One more than the largest difference, and as many more as are likely to be empty where a third more will do.
        """
        if tag not in self.cut:
            least = self.difference(2 * (self.edges[tag + 1] - 1)) + 1
            empty = lambda m: m * math.exp(-self.edges[tag] / m)
            enough = (m for m in range(least, least * 4 // 3 + 2) if m - least >= empty(m) + 2 * math.sqrt(empty(m)) - 0.1)
            self.cut[tag] = 1 if least == 1 else next(enough, least)
        return self.cut[tag]

    def spare(self, n: int, tag: int) -> int:
        """Segments beyond one more than the largest difference that a set of n elements can have to one it links with."""
        other = min(self.edges[tag + 1] - 1, n * self.den // self.num)
        return self.segments(tag) - 1 - self.difference(n + other)


def signatures(h: np.ndarray, bands: Bands, doubled: dict[int, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, cells) of a set; a cell is a band and a segment. doubled: only these segments, with deletions.

    Empty segments are alike in many sets. They are left out of sets that have no more of them than spare segments, as
    such a set and one it links with still agree on another segment.
    """
    sums, found, cells = np.concatenate((np.zeros(1, U), np.cumsum(mix(h + U(1)), dtype=U))), [], []
    own = bands.of(len(h))
    for tag in (own, own + 1):
        m = bands.segments(tag)
        if m == 1 or doubled is not None and tag not in doubled:
            continue
        segment = ((h >> U(32)) * U(m)) >> U(32)
        at = np.searchsorted(segment, np.arange(m + 1, dtype=U))
        n, total, cell = np.diff(at), sums[at[1:]] - sums[at[:-1]], np.arange(m) + (tag << 32)
        if doubled is None and 0 < np.count_nonzero(n == 0) <= bands.spare(len(h), tag):
            n, total, cell = n[n > 0], total[n > 0], cell[n > 0]
        if doubled is not None:
            chosen = np.array(doubled[tag], np.int64)
            inside = [np.arange(at[s], at[s + 1]) for s in chosen]
            size = n[chosen]
            less = [total[s] - mix(h[i] + U(1)) for s, i in zip(chosen, inside, strict=True)]
            total = np.concatenate((total[chosen], *less))
            n = np.concatenate((size, np.repeat(size - 1, size)))
            cell = np.concatenate((cell[chosen], np.repeat(cell[chosen], size)))
        found.append(mix(mix(total + cell.astype(U) * U(0x9E3779B97F4A7C15)) + n.astype(U)))
        cells.append(cell)
    return (np.concatenate(found), np.concatenate(cells)) if found else (np.zeros(0, U), np.zeros(0, np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _describe(words: int, with_set: bool):
    """(doc_id, n, two fingerprints of the set, its parity sketch, and the set itself if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            n, prints, sets = [], [], []
            for t in batch.column(1).to_pylist():
                h = shingler(t)
                n.append(len(h))
                parity = np.packbits((np.bincount((h & U(64 * len(SKETCH) - 1)).astype(np.int64), minlength=64 * len(SKETCH)) & 1).astype(np.uint8)).view(np.int64)
                prints.append([*_signed(np.array([mix(h + U(2)).sum(dtype=U), mix(h + U(3)).sum(dtype=U)])), *parity])
                if with_set:
                    sets.append(_signed(h))
            parts = np.array(prints, np.int64).reshape(-1, 2 + len(SKETCH)).T
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *map(pa.array, np.ascontiguousarray(parts)), *([pa.array(sets, pa.list_(pa.int64()))] if with_set else [])], names=["doc_id", "n", "f1", "f2", *SKETCH, *["tokens"] * with_set])

    return run


FIELDS = "doc_id long, n long, f1 long, f2 long, " + ", ".join(f"{s} long" for s in SKETCH)


def described(docs: DataFrame, words: int, with_set: bool = False) -> DataFrame:
    return docs.mapInArrow(_describe(words, with_set), FIELDS + ", tokens array<long>" * with_set)


def indexed(docs: DataFrame, words: int, bands: Bands, doubled: dict[int, list[int]] | None = None) -> DataFrame:
    """(sig, doc, cell): the index entries of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sigs, cells, ids, held = [], [], [], 0
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingler(t)
                if len(h):
                    s, c = signatures(h, bands, doubled)
                    sigs.append(_signed(s))
                    cells.append(c)
                    ids.append(np.full(len(s), doc, np.int64))
                    held += len(s)
                if held > 100_000:
                    yield pa.record_batch(list(map(pa.array, map(np.concatenate, (sigs, ids, cells)))), names=["sig", "doc", "cell"])
                    sigs, cells, ids, held = [], [], [], 0
            if held:
                yield pa.record_batch(list(map(pa.array, map(np.concatenate, (sigs, ids, cells)))), names=["sig", "doc", "cell"])

    return docs.mapInArrow(run, "sig long, doc long, cell long")


def allocate(cells, bands: Bands, docs_of_band: dict[int, int]) -> tuple[list[int], dict[int, list[int]]]:
    """Which cells (cell, pairs) to leave out and which segments of each band to double instead.

    Leaving a cell out saves its pairs; doubling one costs, for each document of the two bands, an entry for each
    element of a segment, and about doubles its pairs.
    """
    out, doubled = [], {}
    for tag, part in cells.groupby(cells["cell"].to_numpy() >> 32):
        m = bands.segments(int(tag))
        pairs = np.zeros(m)
        pairs[part["cell"].to_numpy() & 0xFFFFFFFF] = part["pairs"]
        each = bands.edges[int(tag)] / m + 1
        entries = each * (docs_of_band.get(int(tag), 0) + docs_of_band.get(int(tag) - 1, 0))
        order = np.argsort(pairs, kind="stable")
        for hot, cold in zip(order[::-1], order, strict=True):
            if pairs[hot] <= CROWDED * max(np.median(pairs), 1) or pairs[hot] <= entries + 2 * pairs[cold] or hot == cold:
                break
            out.append((int(tag) << 32) + int(hot))
            doubled.setdefault(int(tag), []).append(int(cold))
    return out, doubled


class Join:
    def __init__(self, scratch: Scratch, docs: DataFrame, words: int, num: int, den: int):
        self.scratch, self.words, self.num, self.den, self.bands = scratch, words, num, den, Bands(num, den)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(all documents described, one row for each different set with its least id)."""
        full = self.scratch.save(described(self.docs, self.words))
        per = full.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("held"), *[F.first(c).alias(c) for c in SKETCH])
        return full.select("doc_id", "n", "f1", "f2"), self.scratch.save(per)

    def index(self, features: DataFrame, classes: DataFrame) -> DataFrame:
        copies = features.join(classes, ["f1", "f2", "n"]).where("doc_id <> rep").select("doc_id").distinct()
        docs = self.docs.where("doc_id is not null").join(if_small(self.scratch.save(copies)), "doc_id", "left_anti")
        held, cell = F.count("*").alias("n"), F.max("cell").alias("cell")
        raw = self.scratch.save(indexed(docs, self.words, self.bands))
        entries, per = sharing(self.scratch, raw, held, cell)
        self.scratch.drop(raw)
        pairs = per.groupBy("cell").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
        cells = pairs.where(f"pairs > {CROWDED}").toPandas()  # at most as many as the largest document has segments, by band
        sizes = classes.groupBy("n").count().toPandas()
        per_band: dict[int, int] = {}
        for n, count in zip(sizes["n"], sizes["count"], strict=True):
            per_band[self.bands.of(n)] = per_band.get(self.bands.of(n), 0) + int(count)
        left_out, doubled = allocate(cells, self.bands, per_band)
        if left_out:
            raw = self.scratch.save(indexed(docs, self.words, self.bands, doubled))
            more, _ = sharing(self.scratch, raw)
            self.scratch.drop(raw)
            out = self.docs.sparkSession.createDataFrame([(c,) for c in left_out], "cell long")
            entries = entries.join(F.broadcast(out), "cell", "left_anti").unionByName(more)
        self.scratch.drop(per)
        return entries.select("sig", "doc", "low", "high")

    def bound(self, a: str, b: str):
        """False if the parity sketches show the difference to be too large for a link."""
        apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
        return apart * (self.den + self.num) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (self.den - self.num)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets link. Only the texts of these pairs are cut into shingles again."""
        pairs = self.scratch.save(pairs)
        ids = self.scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        there = self.docs.join(if_small(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        sets = self.scratch.save(described(there, self.words, True).select("doc_id", "tokens"))
        of = lambda name: sets.select(F.col("doc_id").alias(f"{name}_id"), F.col("tokens").alias(name))
        both = pairs.join(of("x"), F.col("a") == F.col("x_id")).join(of("y"), F.col("b") == F.col("y_id"))
        common = F.size(F.array_intersect("x", "y"))
        linked = self.scratch.save(both.where(common * self.den >= (F.size("x") + F.size("y") - common) * self.num).select("a", "b"))
        self.scratch.drop(pairs, ids, sets)
        return linked

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), one row for each row."""
        save = self.scratch.save
        features, classes = self.classes()
        entries = self.index(features, classes)
        brief = classes.select(F.col("rep").alias("doc_id"), "n", *SKETCH).join(entries.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
        brief = save(brief)
        final = connect(self.scratch, entries, brief, self.bound, self.verified)
        self.scratch.drop(brief)
        of_class = classes.join(final, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id"))
        out = features.join(of_class, ["f1", "f2", "n"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def groups(scratch: Scratch, docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of at least num / den."""
    return Join(scratch, docs, words, num, den).run()


def query(spark, sf_dir: str) -> DataFrame:
    return groups(Scratch(spark, "jaccard"), table(spark, sf_dir, "documents"), 3, 90, 100)
