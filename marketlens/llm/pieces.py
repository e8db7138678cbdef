"""SentencePiece encoding and decoding with original byte spans.

The normaliser of the model is applied here as well as in the library: the longest prefix that the compiled character
map holds is replaced, every normalised byte remembers the original byte it came from, and the spans of the pieces,
which tile the normalised text, are projected through that alignment.

Nulls and edges: a null text counts as empty and gives only the begin and end ids; repeated rows give repeated rows;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁".encode()
#: Bytes of text that are encoded by one library call.
CALL_BYTES = 4_000_000


class CharacterMap:
    """The compiled character map of a model: a double-array trie over byte strings, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that starts at a position."""
        found, node = None, 0
        if self.units:
            unit = self.units[0]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            for end in range(at, len(text)):
                node ^= text[end]
                unit = self.units[node]
                if unit & 0x800000FF != text[end]:
                    break
                node ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    start = self.units[node] & 0x7FFFFFFF
                    found = end + 1 - at, self.texts[start : self.texts.index(0, start)]
        return found


class Normaliser:
    """Text bytes to normalised bytes with, for each, the original position; one more position marks the end."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, source = (np.frombuffer(text, np.uint8), np.arange(len(text) + 1)) if not self.map.units else self._mapped(text)
        if self.squeeze:
            blank = out == 32
            keep = ~blank | np.concatenate(([False], ~blank[:-1])) if len(out) else blank
            while len(keep) and (last := np.flatnonzero(keep)).size and blank[last[-1]]:
                keep[last[-1]] = False
            out, source = out[keep], np.append(source[:-1][keep], source[-1])
        if self.prefix and len(out):
            out, source = np.concatenate(([np.uint8(32)], out)), np.concatenate((source[:1], source))
        if not self.escape:
            return out.tobytes(), source
        width = np.where(out == 32, len(SPACE), 1)
        return out.tobytes().replace(b" ", SPACE), np.append(np.repeat(source[:-1], width), source[-1])

    def _mapped(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        out, source, at = bytearray(), [], 0
        while at < len(text):
            step, new = self.map.longest(text, at) or (1 + sum(b >> 6 == 2 for b in text[at + 1 : at + 4 if text[at] > 127 else at + 1]), None)
            if new is None:
                while step > 1 and any(b >> 6 != 2 for b in text[at + 1 : at + step]):
                    step -= 1
                new = text[at : at + step]
            out += new
            source += [at] * len(new)
            at += step
        return np.frombuffer(bytes(out), np.uint8), np.array([*source, len(text)])


@cache
def _model(path: str):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        blob = f.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(blob)
    # bytes of normalised text that a piece stands for; -1: the unknown piece, whose length only the text tells
    width = np.array([{3: 0, 6: 1, 2: -1}.get(p.type, len(p.piece.encode())) for p in proto.pieces])
    return sentencepiece.SentencePieceProcessor(model_proto=blob), Normaliser(proto.normalizer_spec), width


def spans(ids: np.ndarray, text: bytes, normalise: Normaliser, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (original bytes) of every piece."""
    plain, source = normalise(text)
    size = width[ids]
    if (unknown := size < 0).any():
        if unknown.sum() > 1:
            raise ValueError("spans of several unknown pieces in one text can't be told apart")
        size = np.where(unknown, len(plain) - size[~unknown].sum(), size)
    ends = np.cumsum(size)
    if ends[-1] != len(plain):
        raise ValueError("the pieces don't tile the normalised text")
    return source[ends - size], source[ends]


def _calls(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CALL_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded): ids with begin and end, the original byte span of each, and the text back."""
    path = model_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, normalise, width = _model(path)
        for batch in batches:
            at = 0
            for texts in _calls([t or "" for t in batch.column(1).to_pylist()]):
                ids = model.encode(texts, add_bos=True, add_eos=True, num_threads=1)
                both = [spans(np.array(i), t.encode(), normalise, width) for i, t in zip(ids, texts, strict=True)]
                yield pa.record_batch([batch.column(0)[at : at + len(texts)], pa.array(ids, pa.list_(pa.int32())), pa.array([b[0] for b in both], pa.list_(pa.int64())), pa.array([b[1] for b in both], pa.list_(pa.int64())), pa.array(model.decode(ids, num_threads=1))], names=["doc_id", "ids", "starts", "ends", "decoded"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string")


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, spans_sha256): what encode() gives, as digests made where it is made.

    spans_sha256 is over the starts and ends of the pieces as little-endian 64-bit integers.
    """
    path = model_path or default_path()
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, normalise, width = _model(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            at = 0
            for texts in _calls([t or "" for t in batch.column(1).to_pylist()]):
                rows = []
                for t in texts:
                    ids = model.encode(t, add_bos=True, add_eos=True)
                    raw, back = t.encode(), model.decode(ids)
                    all_ids = np.array(ids, "<u4")
                    start, end = spans(all_ids, raw, normalise, width)
                    rows.append((len(ids), sha(all_ids.tobytes()), sha(back.encode()), len(raw), sha(np.stack((start, end)).astype("<i8").tobytes())))
                yield pa.record_batch([batch.column(0)[at : at + len(texts)], *map(pa.array, zip(*rows, strict=True))], names=[f.split()[0] for f in fields.split(", ")])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
