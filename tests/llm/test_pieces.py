import hashlib

import numpy as np
import pytest
import sentencepiece

from marketlens.llm import pieces
from tests.llm.helpers import docs_of, read_texts

TEXTS = [None, "", " ", "  two  blanks ", "a\tb\nc", "é ß ½ ﬁ 🙂", "a\x00b", "▁ own mark ▁", "x" * 30_000, " "]


def rows_of(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = {}
    for i, t in texts.items():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        out[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode()))
    return out


def test_digests(spark, sf):
    for docs, texts in ((docs_of(spark, TEXTS).selectExpr("*", "1 as n_tokens"), dict(enumerate(TEXTS))), (spark.read.parquet(f"{sf}/documents.parquet"), read_texts(spark, sf))):
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs).collect()} == rows_of(texts)


def test_spans_tile_the_text(spark):
    for r in pieces.encode(docs_of(spark, TEXTS)).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        inner = list(zip(r.starts, r.ends, strict=True))[1:-1]
        assert all(a <= b for a, b in inner) and all(p[1] == q[0] for p, q in zip(inner, inner[1:]))  # noqa: B905
        assert not raw or (inner[0][0], inner[-1][1]) == (0, len(raw))
    assert pieces.encode(docs_of(spark, []).limit(0)).count() == 0


def test_character_map_takes_the_longest_prefix():
    """A map with the keys a -> X and ab -> Y, built as a double array by hand."""
    import struct

    # unit 0: root with offset 256, so that node ^ label is the child
    units = [0] * 1024
    def put(node, label, offset, leaf): units[node] = (offset << 10) | (int(leaf) << 8) | label  # noqa: E704
    put(0, 0, 256, False)
    a = 256 ^ ord("a")
    put(a, ord("a"), 512 ^ a, True)
    units[512] = 0x80000000 | 0
    b = 512 ^ ord("b")
    put(b, ord("b"), 768 ^ b, True)
    units[768] = 0x80000000 | 2
    blob = struct.pack("<I", len(units) * 4) + np.array(units, "<u4").tobytes() + b"X\0Y\0"
    m = pieces.CharacterMap(blob)
    assert m.longest(b"abc", 0) == (2, b"Y") and m.longest(b"ac", 0) == (1, b"X") and m.longest(b"c", 0) is None

    class Spec:
        precompiled_charsmap, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = blob, False, False, True

    out, source = pieces.Normaliser(Spec)(b"cab a\xc3\xa9")
    assert out == b"cY\xe2\x96\x81X\xc3\xa9" and source.tolist() == [0, 1, 3, 3, 3, 4, 5, 5, 7]


def test_unknown_pieces_must_be_told_apart():
    with pytest.raises(ValueError):
        pieces.spans(np.array([0]), b"ab", lambda t: (t, np.arange(3)), np.array([1]))
