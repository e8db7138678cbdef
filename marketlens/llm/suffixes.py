"""Suffix-array dedup by a distributed difference-cover algorithm.

Texts are sampled at content-defined anchors (minimisers), the same wherever the same bytes stand. Every window of 200
bytes holds an anchor and a stretch of CORE bytes behind it, so stretches that occur once cannot lie in a repeat (exact
prefilter). The windows of an anchor and all their bytes are its neighbourhood; equal neighbourhoods are copies of each
other and are one from here on, as equal texts are. What is left are neighbourhoods at the edges of repeats.

Their suffixes from the anchor on are sorted, in symbols of SYMBOL bytes that are named in the order of their bytes, by
the difference-cover algorithm: triples at positions 1 and 2 modulo 3 are sorted and named, the string of names is
sorted by recursion, the remaining suffixes are placed by their first symbol and the rank behind it, and all are merged.
The bytes of adjacent suffixes are then compared. For each length the order falls into runs of suffixes that agree so
far; a window repeats if another one has the same bytes before the anchor and lies in the same run.

Equality of stretches and neighbourhoods is that of 64-bit hashes, that of texts of 128-bit ones; what the order of
suffixes decides is compared byte by byte. Nulls and edges: a null text counts as empty; texts of fewer than 200 bytes
lose nothing; rows that repeat an id and a text are copies of each other; a null id is a document; an id with several
texts is as many documents; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import Scratch, if_small, table

U = np.uint64
LENGTH, GRAM, SPAN = 200, 8, 56
#: Bytes behind an anchor that all windows of the anchor have.
CORE = LENGTH - SPAN + 1
#: Bytes of a symbol of the sorted strings.
SYMBOL = 64


# --- difference cover ---------------------------------------------------------------------------------------------


def suffix_order(scratch: Scratch, symbols: DataFrame) -> DataFrame:
    """(cid, i, s, rank) of symbols (cid, i, s): ranks sort the suffixes of the strings cid.

    Each string must end with a symbol that occurs nowhere else.
    """
    symbols = scratch.save(symbols.select("cid", "i", "s"))
    ahead = Window.partitionBy("cid").orderBy("i")
    lead = lambda c, k: F.coalesce(F.lead(c, k).over(ahead), F.lit(-1).cast("long"))
    full = symbols.withColumns({"s1": lead("s", 1), "s2": lead("s", 2), "n": F.count("*").over(Window.partitionBy("cid"))})
    sample = full.where("i % 3 <> 0")
    triple = ["s", "s1", "s2"]
    names = sample.groupBy(*triple).agg(F.count("*").alias("held")).sort(*triple)
    names = scratch.save(names.withColumn("name", F.monotonically_increasing_id()))  # the order of the ids is that of the triples
    # reduced string: positions 1 modulo 3, then positions 2 modulo 3
    place = F.when(F.col("i") % 3 == 1, (F.col("i") - 1) / 3).otherwise(F.floor((F.col("n") + 1) / 3) + (F.col("i") - 2) / 3).cast("long")
    named = scratch.save(sample.join(names.select(*triple, "name"), triple).select("cid", "i", place.alias("at"), "name"))
    if names.where("held > 1").isEmpty():
        ranks = named.select("cid", "i", F.col("name").alias("r"))
    else:
        inner = suffix_order(scratch, named.select("cid", F.col("at").alias("i"), F.col("name").alias("s")))
        ranks = named.join(inner.select("cid", F.col("i").alias("at"), "rank"), ["cid", "at"]).select("cid", "i", F.col("rank").alias("r"))
    known = symbols.join(ranks, ["cid", "i"], "left")
    known = scratch.save(known.withColumns({"r1": lead("r", 1), "s1": lead("s", 1), "r2": lead("r", 2)}))
    rest = F.col("i") % 3 == 0
    out = scratch.save(_merged(known, rest))
    scratch.drop(symbols, names, named, known)
    return out


def _merged(known: DataFrame, rest) -> DataFrame:
    """The remaining suffixes of known (cid, i, s, r, r1, s1, r2) among the sampled ones.

    A remaining suffix meets those of 1 modulo 3 by (symbol, rank behind), those of 2 modulo 3 by one symbol more.
    """
    before = Window.partitionBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda m: F.max(F.when(F.col("i") % 3 == m, F.col("r")))
    one = known.where("i % 3 <> 2").withColumn("p1", of(1).over(before.orderBy("r1", rest))).where(rest).select("cid", "i", "s", "r1", "p1")
    two = known.where("i % 3 <> 1").withColumn("p2", of(2).over(before.orderBy("s1", "r2", rest))).where(rest).select("cid", "i", "p2")
    placed = one.join(two, ["cid", "i"]).select("cid", "i", "s", F.greatest(F.coalesce("p1", F.lit(-1)), F.coalesce("p2", F.lit(-1))).alias("place"), F.lit(1).alias("late"), "r1")
    sampled = known.where(~rest).select("cid", "i", "s", F.col("r").alias("place"), F.lit(0).alias("late"), F.lit(0).cast("long").alias("r1"))
    return placed.unionByName(sampled).sort("s", "place", "late", "r1").select("cid", "i", "s", F.monotonically_increasing_id().alias("rank"))


# --- phrases and windows ------------------------------------------------------------------------------------------


def minima(raw: bytes) -> np.ndarray:
    """For each start of a span of SPAN eight-byte strings, the place of the leftmost with the least hash."""
    a = np.frombuffer(raw, np.uint8)
    n = len(a) - GRAM + 1
    if n < SPAN:
        return np.zeros(0, np.int64)
    g = np.zeros(n, U)
    for j in range(GRAM):
        g |= a[j : j + n].astype(U) << U(8 * j)
    g *= U(0x9E3779B97F4A7C15)
    g ^= g >> U(29)
    g *= U(0xBF58476D1CE4E5B9)
    key = (g >> U(32) << U(32)) | np.arange(n, dtype=U)
    width = 1
    while width * 2 <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = SPAN - width
    key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
    return (key & U(0xFFFFFFFF)).astype(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bytes(texts: pa.Array) -> list[bytes]:
    """The texts as they are in memory, without a string of each."""
    return texts.cast(pa.binary()).to_pylist()


def stretches(units: DataFrame) -> DataFrame:
    """(h, doc, at) of units (doc, text): the hash of the stretch behind each anchor and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_digest as digest

        def batch_of(docs, spots, hs):
            hashes = np.frombuffer(b"".join(hs), ">i8").astype(np.int64)
            return pa.record_batch([pa.array(hashes), pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(spots), pa.int32())], names=["h", "doc", "at"])

        for batch in batches:
            docs, spots, hs = [], [], []
            for doc, raw in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                at = minima(raw)
                if not len(at):
                    continue
                x = at[np.concatenate(([True], np.diff(at) > 0))]
                x = x[x + CORE <= len(raw)]
                hs += [digest(raw[p : p + CORE]) for p in x.tolist()]
                spots.append(x)
                docs.append(np.full(len(x), doc))
                if len(hs) > 200_000:
                    yield batch_of(docs, spots, hs)
                    docs, spots, hs = [], [], []
            if hs:
                yield batch_of(docs, spots, hs)

    return units.mapInArrow(run, "h long, doc long, at int")


def recurring(scratch: Scratch, units: DataFrame) -> DataFrame:
    """(doc, spots): the places of the anchors of each document whose stretch occurs elsewhere.

    Stretches are counted before they are joined, so that one that very many documents hold is split among tasks.
    """
    raw = scratch.save(stretches(units))
    twice = scratch.save(raw.groupBy("h").agg(F.count("*").alias("held")).where("held > 1").select("h"))
    spots = scratch.save(raw.join(twice, "h").groupBy("doc").agg(F.collect_list("at").alias("spots")))
    scratch.drop(raw, twice)
    return spots


def neighbourhoods(units: DataFrame) -> DataFrame:
    """(doc, first, n, left, u, core) of units (doc, text, spots): the first and number of an anchor's windows, its distance from the first, hashes of all their bytes and of the stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for doc, raw, spots in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                at = minima(raw)[: len(raw) - LENGTH + 1]
                spots = np.sort(np.array(spots, np.int64))
                begin, end = np.searchsorted(at, spots), np.searchsorted(at, spots, "right")
                for x, first, after in zip(spots.tolist(), begin.tolist(), end.tolist(), strict=True):
                    if first < after:
                        u = xxhash.xxh3_64_intdigest(raw[first : after - 1 + LENGTH], x - first)
                        rows.append((doc, first, after - first, x - first, _signed(u), _signed(xxhash.xxh3_64_intdigest(raw[x : x + CORE]))))
                if len(rows) > 200_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc", "first", "n", "left", "u", "core"])

    return units.mapInArrow(run, "doc long, first int, n int, left int, u long, core long")


def cut_out(units: DataFrame) -> DataFrame:
    """(doc, first, n, left, held, raw) of units (doc, text, parts): the bytes of all windows of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw, parts in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rows += [(doc, p["first"], p["n"], p["left"], p["held"], raw[p["first"] : p["first"] + p["n"] - 1 + LENGTH]) for p in parts]
            if rows:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc", "first", "n", "left", "held", "raw"])

    return units.mapInArrow(run, "doc long, first int, n int, left int, held long, raw binary")


def common_prefixes(rows: DataFrame) -> DataFrame:
    """(cid, place, part, lcp) of rows (cid, place, part, tail, before): how many bytes tail and before have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                n = min(len(a), len(b or b""))
                differ = int.from_bytes(a[:n]) ^ int.from_bytes((b or b"")[:n])
                out.append(n - (differ.bit_length() + 7) // 8)
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.int32())], names=["cid", "place", "part", "lcp"])

    return rows.select("cid", "place", "part", "tail", "before").mapInArrow(run, "cid long, place long, part long, lcp int")


def runs_of(scratch: Scratch, strings: DataFrame) -> DataFrame:
    """(cid, runs) of strings (cid, left, raw): for each distance d of a window from its anchor, the run of the order of suffixes from the anchor on that agree over the window's other LENGTH - d bytes."""
    tail = F.expr("substring(raw, left + 1)")
    tails = scratch.save(strings.select("cid", tail.alias("tail")))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("tail") - 1) / SYMBOL)), lambda k: F.substring(F.col("tail"), (k * SYMBOL + 1).cast("int"), F.lit(SYMBOL)))
    pieces = scratch.save(tails.select("cid", F.posexplode(cut).alias("i", "piece")))
    names = scratch.save(pieces.select("piece").distinct().sort("piece").withColumn("s", F.monotonically_increasing_id()))
    symbols = pieces.join(names, "piece").select("cid", F.col("i").cast("long").alias("i"), "s")
    ends = pieces.groupBy("cid").agg((F.max("i") + 1).cast("long").alias("i")).withColumn("s", -2 - F.col("cid"))
    order = suffix_order(scratch, symbols.unionByName(ends))
    ranked = order.where("i = 0").select("cid", "rank").join(tails, "cid").sort("rank")
    ranked = scratch.save(ranked.select("cid", "tail", F.monotonically_increasing_id().alias("place")).withColumn("part", F.shiftright("place", 33)))
    # the first suffix of each part of the order meets the last one of the part before
    by_part = Window.partitionBy("part").orderBy("place")
    lasts = ranked.groupBy("part").agg(F.max_by("tail", "place").alias("last"))
    lasts = lasts.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"))  # one row for each part
    pairs = ranked.withColumn("before", F.lag("tail").over(by_part)).join(F.broadcast(lasts), "part")
    lcps = scratch.save(common_prefixes(pairs.withColumn("before", F.coalesce("before", "last"))))
    breaks = [F.when(F.col("lcp") < LENGTH - d, F.col("place")) for d in range(SPAN)]
    upto = by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = lcps.select("cid", "part", F.array(*[F.max(b).over(upto) for b in breaks]).alias("own"))
    ends = lcps.groupBy("part").agg(*[F.max(b).alias(f"b{d}") for d, b in enumerate(breaks)])
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("part").alias("of"), F.array(*[F.max(f"b{d}").over(so_far) for d in range(SPAN)]).alias("carried"))
    both = own.join(F.broadcast(carried), F.col("part") == F.col("of"))
    out = scratch.save(both.select("cid", F.zip_with("own", "carried", lambda a, b: F.coalesce(a, b, F.lit(-1).cast("long"))).alias("runs")))
    scratch.drop(tails, pieces, names, order, ranked, lcps)
    return out


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the values of each row of a column of binaries or lists begin in all of them."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column)].astype(np.int64)


def windows(strings: DataFrame) -> DataFrame:
    """(run, before, cid, at): each window of strings (cid, n, left, raw, runs) with its run and its bytes before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 2000) for whole in batches for k in range(0, whole.num_rows, 2000)):
            cid, n, left = (batch.column(k).to_numpy() for k in range(3))
            raw, runs = batch.column(3), batch.column(4)
            n = n.astype(np.int64)
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            size = left[of] - at
            # the bytes of all windows before their anchors, one behind the other
            ends = np.cumsum(size)
            starts = _offsets(raw)[of] + at
            places = np.repeat(starts - (ends - size), size) + np.arange(size.sum())
            held = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[places]
            before = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(held)])
            run = runs.values.to_numpy()[_offsets(runs)[of] + size]
            yield pa.record_batch([pa.array(run), before, pa.array(cid[of]), pa.array(at.astype(np.int32))], names=["run", "before", "cid", "at"])

    return strings.select("cid", "n", "left", "raw", "runs").mapInArrow(run, "run long, before binary, cid long, at int")


def repeated(scratch: Scratch, units: DataFrame) -> DataFrame:
    """(doc, ranges): inclusive ranges of starts of windows that occur elsewhere, for units (doc, text) of different texts."""
    spots = recurring(scratch, units)
    near = scratch.save(neighbourhoods(units.join(if_small(spots, "spots"), "doc")))
    # of equal neighbourhoods one stands for all: the first that its smallest document has
    same = near.groupBy("u").agg(F.count("*").alias("held"), F.min("doc").alias("doc"), F.min_by("first", "doc").alias("first"), *[F.first(c).alias(c) for c in ("n", "left", "core")])
    same = scratch.save(same)
    whole = near.join(same.where("held > 1").select("u"), "u").select("doc", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    # a stretch in different neighbourhoods of which one occurs once: parts of that one may still repeat
    edges = scratch.save(same.groupBy("core").agg(F.count("*").alias("kinds"), F.min("held").alias("least")).where("kinds > 1 and least = 1").select("core"))
    parts = same.join(edges, "core").groupBy("doc").agg(F.collect_list(F.struct("first", "n", "left", "held")).alias("parts"))
    strings = scratch.save(cut_out(units.join(if_small(scratch.save(parts), "parts"), "doc")).withColumn("cid", F.monotonically_increasing_id()))
    cut = scratch.save(windows(strings.join(runs_of(scratch, strings), "cid")))
    twice = cut.groupBy("run", "before").agg(F.count("*").alias("times")).where("times > 1").select("run", "before")
    found = cut.join(scratch.save(twice), ["run", "before"]).join(strings.where("held = 1").select("cid", "doc", "first"), "cid")
    starts = found.select("cid", "doc", (F.col("first") + F.col("at")).alias("p"), (F.col("at") - F.row_number().over(Window.partitionBy("cid").orderBy("at"))).alias("run"))
    joined = starts.groupBy("cid", "doc", "run").agg(F.min("p").alias("first"), F.max("p").alias("last")).select("doc", "first", "last")
    out = scratch.save(whole.unionByName(joined).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))
    scratch.drop(spots, near, same, edges, strings, cut)
    return out


def removal(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of docs (doc_id, text, copies, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw, copies, ranges in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                spans: list[list[int]] = []
                if copies > 1 and len(raw) >= LENGTH:
                    spans = [[0, len(raw)]]
                elif ranges:
                    for first, last in sorted((r["first"], r["last"] + LENGTH) for r in ranges):
                        if spans and first <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], last)
                        else:
                            spans.append([first, last])
                kept, at = [], 0
                for first, last in spans:
                    kept.append(raw[at:first])
                    at = last
                kept.append(raw[at:])
                rows.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
            yield pa.record_batch([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_substrings(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """What is left of each document without the bytes of 200-byte strings that start anywhere else."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"doc": F.xxhash64("text"), "twin": F.xxhash64(F.lit(1), "text")})
    places = scratch.save(docs.where(F.octet_length("text") >= LENGTH).select("doc", "twin", "doc_id"))
    copies = scratch.save(places.groupBy("doc", "twin").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    held = places.join(copies, ["doc", "twin"]).groupBy("doc", "twin", "doc_id").agg(F.count("*").alias("rows"), (~F.col("doc_id").eqNullSafe(F.first("rep"))).alias("other"))
    held = scratch.save(held.where("other or rows > 1").select(F.col("doc").alias("d"), F.col("twin").alias("t"), F.col("doc_id").alias("of"), "other"))
    match = lambda df: (docs["doc"] == df["d"]) & (docs["twin"] == df["t"]) & docs["doc_id"].eqNullSafe(df["of"])
    units = docs.where(F.octet_length("text") >= LENGTH).join(if_small(held), match(held), "left_anti").select("doc", "text")
    rows = held.where("not other")  # a text and its smallest id stand in several rows
    if not rows.isEmpty():
        units = units.unionByName(docs.join(if_small(rows), match(rows), "left_semi").dropDuplicates(["doc", "twin"]).select("doc", "text"))
    found = repeated(scratch, units)
    both = docs.join(if_small(found, "ranges"), "doc", "left").join(if_small(copies.drop("rep")), ["doc", "twin"], "left")
    return removal(both.select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "ranges"))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(Scratch(spark, "suffixes"), table(spark, sf_dir, "documents"))
