"""Token ids in binary files, coded by a range asymmetric numeral system (rANS) with one shared frequency table.

Documents are dealt by ranges of doc_id, encoded once with a byte-level tokenizer, ended by an id and put one behind the
other into sections of whole documents, which are kept until the frequencies of all ids are known and then coded. A file
has a header and sections that follow each other; a section has blocks of BLOCK ids, a block the
lengths of the documents that begin in it, LANES interleaved coder states, a checkpoint (states and place) every STEPS
steps, and the coded words, all under a checksum. Blocks are coded independently, and every checkpoint starts a unit of
its own, so a reader decodes thousands of lanes side by side. The coding follows the published rANS construction with
64-bit states and 32-bit words.

Each task writes files under names of its own into the shared folder and reports their sections; that table is written
by Spark, which keeps the rows of one attempt of each task only, so files of lost or repeated attempts are never read.
The first position of a section is the sum of all ranges before its own, one row each, and of the sections before it.

Nulls and edges: a null text is an empty one and has the end id only; rows with null ids come first; rows that share an
id are ordered by their text's hash; texts of any length are taken whole; other columns are ignored; an empty table
writes no file and gives no rows. A damaged block raises an error.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import Scratch, table

MODEL, END = "byte_bpe_50k.json", 0
LANES, STEPS, BLOCK = 32, 256, 16_384
#: A section ends with the document that fills so many ids; so many blocks, or units, are coded side by side.
SECTION, SIDE = 1_000_000, 64
#: Bits of the frequency table's total.
SCALE = 20
LOW, WORD_BITS = np.uint64(1 << 31), np.uint64(32)
MAGIC = b"MLTOKEN1"
HEADER, BLOCK_HEADER = struct.Struct("<8s6I"), struct.Struct("<4I")
#: Characters of text that are encoded by one call, and pieces of text whose ids are remembered in each of two generations.
CALL_CHARS, KNOWN, KNOWN_LENGTH = 4_000_000, 700_000, 64
PLAIN = "part int, section int, names array<bigint>, sizes array<bigint>, ids binary, wide boolean, counts binary"
PLACED = "part int, section int, file string, at long, bytes long, n_docs long, n_tokens long"
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}

#: A byte-level tokenizer never joins a character that is no white space to a blank or line end behind it.
PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Where a text has none of these, each of its blanks and line ends starts a piece.
DOUBLE = ("  ", "\n\n", " \n", "\n ")
#: Marks that end a word.
MARKS = ".,;:!?"
#: White space of other kinds, and characters that some pattern libraries count as such.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + list("\u180e\u200b\ufeff")


class Known(dict):
    """Ids by piece of text, asked for where they are missing."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.ask(piece)
        return ids


class Memory:
    """Ids of pieces of text by a library call, kept as long as they are met again before so many others."""

    def __init__(self, library):
        self.library = library
        self.known = Known(self._find)
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []

    def _find(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = self.library(piece)
            if len(piece) > KNOWN_LENGTH:
                self.long.append(piece)
        return ids

    def __call__(self, lists: list[list[str]]) -> list[bytes]:
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in lists]
        for p in self.long:
            del self.known[p]
        self.long.clear()
        if len(self.known) > KNOWN:
            self.older, self.known = self.known, Known(self._find)
        return out


class Characters(dict):
    """What the model sees for a character, by its code: the characters that stand for its bytes."""

    def __init__(self, before):
        self.before = before

    def __missing__(self, code: int) -> str:
        self[code] = self.before.pre_tokenize_str(chr(code))[0][0]
        return self[code]


class Encoder:
    """Texts to ids by the tokenizers library, which sees each different piece of text once as long as it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        added = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.in_pieces = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not added
        self.pieces, self.words = Memory(self._library), Memory(self._spaced)
        if self.in_pieces:
            self.marks = {m: self._library(m) for m in (*MARKS, "\n")}
            self.characters = Characters(self.tokenizer.pre_tokenizer)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast((text,), add_special_tokens=False)[0].ids).tobytes()

    def _spaced(self, word: str) -> bytes:
        """The ids of a word with the blank before it, or the line end that it starts with.

        Letters, and one mark behind them, are tokens apart, so such a word goes to the library's model at once.
        """
        core, tail = word, b""
        if word and word[-1] in MARKS:
            core, tail = word[:-1], self.marks[word[-1]]
            if core.isalpha() and (met := self.words.known.get(core) or self.words.older.get(core)):
                return met + tail
        lead, body = (self.marks["\n"], core[1:]) if core[:1] == "\n" else (b"", core)
        if body.isalpha() and (body.isascii() or max(body) < "\u2000"):
            shown = body.translate(self.characters)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(shown if lead else self.characters[32] + shown)]).tobytes()
            return lead + found + tail
        return self._library(word if word[:1] == "\n" else " " + word)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as native 32-bit integers: of its first pieces, then of the words behind a blank or line end."""
        first, rest = [], []
        for t in texts:
            words = []
            if not self.in_pieces or any(c in t for c in OTHER_SPACE):
                start = [t]
            else:
                words = t.replace("\n", " \n").split(" ")
                start = words[:1]
                del words[:1]
                # an empty word or a bare line end is left where a text has two blanks or line ends together, or ends
                if ("" in words or "\n" in words or start == ["\n"]) and any(d in t for d in DOUBLE):
                    start, words = PIECE.findall(t), []
            first.append(start)
            rest.append(words)
        return [a + b for a, b in zip(self.pieces(first), self.words(rest), strict=True)]


_encoder = cache(Encoder)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(names of documents, their token ids without the end) of (doc_id, text) batches, some documents at a time."""
    encode = _encoder(path)
    for batch in batches:
        names, texts, first, held = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= CALL_CHARS or i + 1 == len(texts):
                yield names[first : i + 1], [np.frombuffer(b, np.uint32) for b in encode(texts[first : i + 1])]
                first, held = i + 1, 0


class Table:
    """Frequencies of ids, scaled to a total of 2 ** SCALE; each id that occurs has one at least."""

    def __init__(self, counts: np.ndarray):
        present = counts > 0
        total, spare = int(counts.sum()), (1 << SCALE) - int(present.sum())
        if spare < 0:
            raise ValueError("more different ids than the table's total can hold")
        freq = np.array([int(c) * spare // max(total, 1) for c in counts.tolist()], np.uint64) + present.astype(np.uint64)
        if total:
            freq[counts.argmax()] += np.uint64((1 << SCALE) - int(freq.sum()))
        self.freq, self.most = freq, int(counts.argmax()) if total else 0
        self.low = np.concatenate((np.zeros(1, np.uint64), np.cumsum(freq)[:-1])).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @property
    def symbols(self) -> np.ndarray:
        if not hasattr(self, "_symbols"):
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._symbols


def code(ids: np.ndarray, model: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(states, words before, words) of each block of ids [blocks, steps, lanes]: states and words before its units."""
    blocks, steps, _ = ids.shape
    shift, x = np.uint64(63 - SCALE), np.full((blocks, LANES), LOW, np.uint64)
    words, owner, emitted, marks = [], [], np.zeros(blocks, np.int64), []
    for t in reversed(range(steps)):
        f, c = model.freq[ids[:, t]], model.low[ids[:, t]]
        full = np.flatnonzero(x >= f << shift)
        if len(full):
            flat, block = x.reshape(-1), full // LANES
            large = flat[full]
            words.append(large.astype(np.uint32))
            owner.append(block)
            emitted += np.bincount(block, minlength=blocks)
            flat[full] = large >> WORD_BITS
        whole = x // f
        x = (whole << np.uint64(SCALE)) + (x - whole * f) + c
        if t % STEPS == 0:
            marks.append((x.copy(), emitted.copy()))
    states, sent = np.stack([m[0] for m in marks[::-1]], axis=1), np.stack([m[1] for m in marks[::-1]], axis=1)
    words = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    owner = np.concatenate(owner[::-1]) if owner else np.zeros(0, np.int64)
    words = np.split(words[np.argsort(owner, kind="stable")], np.cumsum(emitted)[:-1])
    return [(states[b], emitted[b] - sent[b], words[b]) for b in range(blocks)]


def decode(states: np.ndarray, at: np.ndarray, steps: np.ndarray, words: np.ndarray, model: Table) -> np.ndarray:
    """ids [units, STEPS, lanes] of units, those of most steps first: their states, first words and numbers of steps."""
    x, at, out = states.copy(), at.copy(), np.zeros((len(states), STEPS, LANES), np.uint32)
    mask, scale, symbols = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), model.symbols
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    for t in range(int(steps.max(initial=0))):
        n = int(np.searchsorted(-steps, -t, "left"))
        slot = x[:n] & mask
        s = symbols[slot.astype(np.int64)]
        out[:n, t] = s
        y = model.freq[s] * (x[:n] >> scale) + slot - model.low[s]
        low = y < LOW
        each, small, flat = np.count_nonzero(low, axis=1), np.flatnonzero(low), y.reshape(-1)
        # the words of a unit follow each other from its place on
        place = np.repeat(at[:n] - np.cumsum(each) + each, each) + np.arange(len(small))
        flat[small] = (flat[small] << WORD_BITS) | words[place]
        x[:n] = y
        at[:n] += each
    return out


def packed(ids: np.ndarray, names: list, sizes: np.ndarray, model: Table) -> bytes:
    """A section: blocks of the ids of whole documents with these names (None: null) and sizes."""
    if (model.freq[np.minimum(ids, len(model.freq) - 1)] == 0).any() or ids.max(initial=0) >= len(model.freq):
        raise ValueError("an id has no frequency in the table")
    begin = np.cumsum(sizes) - sizes
    null = np.array([n is None for n in names])
    number = np.array([n or 0 for n in names], "<i8")
    out = []
    for first in range(0, len(ids), BLOCK * SIDE):
        part = ids[first : first + BLOCK * SIDE]
        whole = len(part) // BLOCK * BLOCK
        shaped = [part[:whole].reshape(-1, BLOCK // LANES, LANES)] if whole else []
        if whole < len(part):
            rest = part[whole:]
            shaped.append(np.pad(rest, (0, -len(rest) % LANES), constant_values=model.most).reshape(1, -1, LANES))
        at = first
        for states, before, words in chain.from_iterable(code(s, model) for s in shaped):
            n = min(BLOCK, len(ids) - at)
            low, high = np.searchsorted(begin, (at, at + n))
            body = b"".join((number[low:high].tobytes(), null[low:high].tobytes(), sizes[low:high].astype("<u8").tobytes(), before.astype("<u4").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes()))
            out += [BLOCK_HEADER.pack(n, len(words), high - low, zlib.crc32(body)), body]
            at += n
    return b"".join(out)


def unpacked(blob: bytes, model: Table) -> Iterator[tuple[list, list[int], np.ndarray]]:
    """(names and sizes of the documents that begin there, ids) of some blocks of a section at a time."""
    at, group = 0, []

    def decoded() -> tuple[list, list[int], np.ndarray]:
        base, offset = [], 0
        for block in group:
            base.append(offset + block[4])
            offset += len(block[6])
        steps = np.concatenate([block[2] for block in group])
        order = np.argsort(-steps, kind="stable")
        states, first = np.concatenate([block[5] for block in group]), np.concatenate(base)
        made = decode(states[order], first[order], steps[order], np.concatenate([block[6] for block in group]), model)
        units = np.empty_like(made)
        units[order] = made
        out, unit = [], 0
        for block in group:
            n = len(block[2])
            out.append(units[unit : unit + n].reshape(-1)[: block[3]])
            unit += n
        return [n for block in group for n in block[0]], [n for block in group for n in block[1]], np.concatenate(out)

    while at < len(blob):
        n, n_words, n_docs, crc = BLOCK_HEADER.unpack_from(blob, at)
        at += BLOCK_HEADER.size
        steps = -(-n // LANES)
        units = -(-steps // STEPS)
        sizes = (8 * n_docs, n_docs, 8 * n_docs, 4 * units, 8 * LANES * units, 4 * n_words)
        body = blob[at : at + sum(sizes)]
        if len(body) < sum(sizes) or zlib.crc32(body) != crc:
            raise ValueError("a block of token ids is damaged")
        cut = np.cumsum((0, *sizes)).tolist()
        names, null, lengths, before, states, words = (np.frombuffer(body[a:b], kind) for a, b, kind in zip(cut, cut[1:], ("<i8", bool, "<u8", "<u4", "<u8", "<u4"), strict=False))
        each = np.minimum(STEPS, steps - STEPS * np.arange(units))
        group.append(([None if x else v for v, x in zip(names.tolist(), null.tolist(), strict=True)], lengths.tolist(), each, n, before.astype(np.int64), states.reshape(units, LANES), words))
        at += sum(sizes)
        if len(group) == SIDE or at >= len(blob):
            yield decoded()
            group.clear()


def documents_of(blob: bytes, model: Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """(name, ids) of the documents of a section."""
    todo: list[tuple[int | None, int]] = []
    held, have = [], 0
    for names, sizes, ids in unpacked(blob, model):
        todo += zip(names, sizes, strict=True)
        held.append(ids)
        have += len(ids)
        if todo and have >= todo[0][1]:
            ids, at, done = np.concatenate(held), 0, 0
            for name, size in todo:
                if at + size > have:
                    break
                yield name, ids[at : at + size]
                at, done = at + size, done + 1
            todo, held, have = todo[done:], [ids[at:]], have - at


def store(uri: str) -> tuple[FileSystem, str]:
    """The file system of a shared folder's address and the path in it."""
    return FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _rows(rows: list[tuple], fields: str) -> pa.RecordBatch:
    schema = pa.schema([(f.split()[0], KINDS[f.split()[1]]) for f in fields.split(", ")])
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sections(scratch: Scratch, docs: DataFrame, model_path: str | None = None, end: int = END) -> DataFrame:
    """The ids of docs in the order of doc_id, as stored sections (part, section, names, sizes, ids): ids are little-endian
    integers of 16 bits, of 32 where wide; parts are ranges in their order. The last section of a part has the numbers
    of all its ids in counts, integers of 64 bits by id, so that no second pass over the ids counts them."""
    path = model_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, names, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        counts, last = np.zeros(0, np.int64), None

        def row() -> tuple:
            nonlocal counts
            ids = np.concatenate(texts)
            counts = _added(counts, np.bincount(ids))
            wide = bool(ids.max() > 0xFFFF)
            return part, number, names, [len(t) for t in texts], ids.astype("<u4" if wide else "<u2").tobytes(), wide

        for some, ids in encoded(batches, path):
            for doc, inner in zip(some, ids, strict=True):
                names.append(doc)
                texts.append(np.append(inner, np.uint32(end)))
                held += len(texts[-1])
                if held >= SECTION:
                    if last:
                        yield _rows([(*last, None)], PLAIN)
                    last = row()
                    number, names, texts, held = number + 1, [], [], 0
        if names:
            if last:
                yield _rows([(*last, None)], PLAIN)
            last = row()
        if last:
            yield _rows([(*last, counts.astype("<i8").tobytes())], PLAIN)

    keys = ("doc_id", "__of", "__row")
    numbered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("__of"), F.monotonically_increasing_id().alias("__row"))
    ordered = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return scratch.save(ordered.mapInArrow(run, PLAIN))


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays, of which the shorter one counts as filled with zeros."""
    a, b = (a, b) if len(a) >= len(b) else (b.copy(), a)
    a[: len(b)] += b
    return a


def _ids(blob: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if wide else "<u2").astype(np.uint32, copy=False)


def frequencies(plain: DataFrame) -> Table:
    """The table of all ids of stored sections; what is collected has one row an id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                counts = _added(counts, np.frombuffer(blob, "<i8"))
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["token", "n"])

    rows = plain.select("counts").where("counts is not null").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.token for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r.token] = r.n
    return Table(counts)


def write(scratch: Scratch, plain: DataFrame, model: Table) -> DataFrame:
    """Codes stored sections into files of the shared folder; gives their places, with start, the number of ids before each."""
    folder = f"{scratch.base}/tokens-{uuid.uuid4().hex}"
    files, place = store(folder)
    files.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, last, rows = None, "", 0, None, []
        try:
            for batch in batches:
                for part, number, names, sizes, blob, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if last != (part, number - 1):  # sections of a file follow each other
                        if out:
                            out.close()
                        name = f"{folder}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.tokens"
                        out, at = _opened(name, model)
                    ids = _ids(blob, wide)
                    coded = packed(ids, names, np.array(sizes, np.int64), model)
                    out.write(coded)
                    rows.append((part, number, name, at, len(coded), len(names), len(ids)))
                    at, last = at + len(coded), (part, number)
        finally:
            if out:
                out.close()
        yield _rows(rows, PLACED)

    placed = scratch.save(plain.select("part", "section", "names", "sizes", "ids", "wide").mapInArrow(run, PLACED))
    parts = placed.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before("all", Window.orderBy("part")).alias("earlier"))
    own = placed.withColumn("own", before("n_tokens", Window.partitionBy("part").orderBy("section")))
    return scratch.save(own.join(parts, "part").withColumn("start", F.col("earlier") + F.col("own")).drop("earlier", "own"))


def _opened(name: str, model: Table):
    """A new file with its header, and the place behind it."""
    files, place = store(name)
    out = files.open_output_stream(place)
    return out, out.write(HEADER.pack(MAGIC, SCALE, LANES, STEPS, BLOCK, model.crc, 0))


def _bytes_of(name: str, at: int, size: int, model: Table) -> bytes:
    """A section of a file, once its header is seen to fit."""
    files, place = store(name)
    with files.open_input_file(place) as f:
        if HEADER.unpack(f.read(HEADER.size)) != (MAGIC, SCALE, LANES, STEPS, BLOCK, model.crc, 0):
            raise ValueError(f"{name} has another format or table")
        f.seek(at)
        return f.read(size)


def _read(placed: DataFrame, model: Table, row, fields: str, kinds: list) -> DataFrame:
    """row(start, ids) of every document of the placed sections, behind its doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, held = [], 0
                for doc, ids in documents_of(_bytes_of(name, at, size, model), model):
                    out.append((doc, *row(start, ids)))
                    start, held = start + len(ids), held + len(ids)
                    if held >= SECTION:
                        yield _batch(out, fields, kinds)
                        out, held = [], 0
                if out:
                    yield _batch(out, fields, kinds)

    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("file", "at", "bytes", "start").repartition(tasks, "file", "at")
    return dealt.mapInArrow(run, f"doc_id long, {fields}")


def _batch(rows: list[tuple], fields: str, kinds: list) -> pa.RecordBatch:
    names = ["doc_id", *(f.split()[0] for f in fields.split(", "))]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), *kinds), strict=True)], names=names)


def read(placed: DataFrame, model: Table) -> DataFrame:
    """(doc_id, start, ids) of the documents of the sections, from their files."""
    return _read(placed, model, lambda start, ids: (start, ids.astype(np.int64)), "start long, ids array<bigint>", [pa.int64(), pa.list_(pa.int64())])


def digests(placed: DataFrame, model: Table) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): what read() gives, as digests made where the files are read."""
    return _read(placed, model, lambda start, ids: (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "start long, n_tokens long, ids_crc32 long", [pa.int64()] * 3)


def query(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    plain = sections(scratch, table(spark, sf_dir, "documents"))
    model = frequencies(plain)
    return digests(write(scratch, plain, model), model)
