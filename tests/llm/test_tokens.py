import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketlens.llm import tokens
from marketlens.llm.shared import Scratch
from tests.llm.helpers import docs_of, read_texts

LIBRARY = Tokenizer.from_file(tokens.default_path())


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def contract(rows):
    """rows (doc_id, text) in order."""
    out, start = [], 0
    for doc, text in rows:
        ids = [*whole(text), 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(spark, docs):
    scratch = Scratch(spark, "t")
    plain = tokens.sections(scratch, docs)
    model = tokens.frequencies(plain)
    return sorted((tuple(r) for r in tokens.digests(tokens.write(scratch, plain, model), model).collect()), key=lambda r: r[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sé1 2  \n\t\r.,!?\u00a0\u0301\u02b0\u2028\u180e\u200b\ufeff\x1c\x85日😀<|endoftext|>"), max_size=40), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(texts):
    encode = tokens._encoder(tokens.default_path())
    texts = [*texts, *(re.sub(r"\s+", " ", t) for t in texts), *(re.sub(r"\s+", "\n", t) for t in texts), *(t + " <|endoftext|>x\n\n y" for t in texts)]
    assert encode.in_pieces and [np.frombuffer(b, np.uint32).tolist() for b in encode(texts)] == [whole(t) for t in texts]


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 50)
    encode = tokens.Encoder(tokens.default_path())
    for k in range(20):
        text = ("  " if k % 2 else "") + " ".join(f"w{k}x{i}" for i in range(40)) + "\nline " + "y" * 500
        assert np.frombuffer(encode([text])[0], np.uint32).tolist() == whole(text)
        for memory in (encode.pieces, encode.words):
            assert len(memory.known) <= 50 and len(memory.older) <= 92 and all(len(p) <= 64 for p in {**memory.known, **memory.older})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 400), st.integers(0, 2**32 - 1))
def test_sections_come_back(sizes, scale, seed):
    rng = np.random.default_rng(seed)
    sizes = np.array(sizes) * scale + 1
    ids = (rng.zipf(1.3, sizes.sum()) % 3000).astype(np.uint32)
    model = tokens.Table(np.bincount(ids))
    names = [None if i % 5 == 4 else i - 3 for i in range(len(sizes))]
    back = list(tokens.documents_of(tokens.packed(ids, names, sizes, model), model))
    assert [n for n, _ in back] == names and [x.tolist() for _, x in back] == [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.2, 400_000) % 50_000).astype(np.uint32)
    counts = np.bincount(ids)
    model = tokens.Table(counts)
    share = counts[counts > 0] / len(ids)
    bits = 8 * len(tokens.packed(ids, [1], np.array([len(ids)]), model)) / len(ids)
    assert bits < 1.06 * -(share * np.log2(share)).sum() and int(model.freq.sum()) == 1 << tokens.SCALE and (model.freq[counts > 0] > 0).all()


def test_one_id_damage_and_unknown_ids():
    ids = np.full(70_000, 7, np.uint32)
    model = tokens.Table(np.bincount(ids))
    blob = tokens.packed(ids, [1], np.array([len(ids)]), model)
    assert len(blob) < 10_000 and next(tokens.documents_of(blob, model))[1].tolist() == ids.tolist()
    for bad in (blob[:200] + bytes([blob[200] ^ 1]) + blob[201:], blob[:-3]):
        with pytest.raises(ValueError, match="damaged"):
            list(tokens.documents_of(bad, model))
    with pytest.raises(ValueError, match="no frequency"):
        tokens.packed(np.array([7, 8], np.uint32), [1], np.array([2]), model)


@pytest.mark.parametrize("section", [tokens.SECTION, 3000])
def test_whole_table(spark, sf, section, monkeypatch):
    monkeypatch.setattr(tokens, "SECTION", section)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(spark, docs.repartition(5)) == contract(sorted(read_texts(spark, sf).items()))


def test_edges(spark):
    texts = [None, "", " ", "a  b\n\nc\t d ", "é\u00a0ß 🙂 <|endoftext|> !", "x" * 30_000, "word " * 60_000, "!"]
    docs = docs_of(spark, texts).selectExpr("*", "1 as start", "2 as part", "3 as ids")
    assert rows_of(spark, docs.orderBy("doc_id", ascending=False)) == contract(enumerate(texts))
    scratch = Scratch(spark, "t")
    plain = tokens.sections(scratch, docs)
    model = tokens.frequencies(plain)
    back = {r.doc_id: r.ids for r in tokens.read(tokens.write(scratch, plain, model), model).collect()}
    assert back == {i: [*whole(t), 0] for i, t in enumerate(texts)}
    assert rows_of(spark, docs.limit(0)) == []
    twice = docs.where("doc_id in (3, 7)").unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 7").selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    assert rows_of(spark, twice) == contract([(None, "!"), (3, texts[3]), (3, texts[3]), (7, "!")])


def test_files_of_repeated_attempts_are_not_read(spark, sf):
    """A task that fails after it wrote leaves a file that no section names."""
    docs, scratch = docs_of(spark, ["a b c"] * 50), Scratch(spark, "t")
    plain = tokens.sections(scratch, docs)
    model = tokens.frequencies(plain)
    placed = tokens.write(scratch, plain, model)
    files, place = tokens.store(placed.first().file.rsplit("/", 1)[0])
    with files.open_output_stream(f"{place}/part-000000-lost.tokens") as f:
        f.write(b"half a file")
    assert len(tokens.read(placed, model).collect()) == 50


def test_ids_are_counted_where_they_are_made(spark, tmp_path, monkeypatch):
    """Each part's last section has the numbers of the part's ids; the ids are not read again for the table."""
    monkeypatch.setattr(tokens, "SECTION", 40)
    plain = tokens.sections(Scratch(spark, "t"), docs_of(spark, [None, "some words of a text\n\nhere"] + ["more words, and more of them"] * 30))
    rows = plain.collect()
    counted = [np.frombuffer(r.counts, "<i8") for r in rows if r.counts]
    assert len(rows) > len(counted) == len({r.part for r in rows})
    ids = np.concatenate([np.frombuffer(r.ids, "<u4" if r.wide else "<u2") for r in rows])
    total = np.zeros(max(map(len, counted)), np.int64)
    for c in counted:
        total[: len(c)] += c
    assert (total == np.bincount(ids)).all()
    model = tokens.frequencies(plain)
    assert (model.freq == tokens.Table(total).freq).all()
