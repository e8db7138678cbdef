import random

import numpy as np
import pandas as pd
import pytest

from marketlens.llm import jaccard
from marketlens.llm.shared import Scratch
from tests.llm.helpers import components, docs_of, jaccard_links, read_texts, shingles


def check(spark, docs, texts, words, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(Scratch(spark, "t"), docs, words, num, den).collect()}
    sets = {i: shingles(t, words) for i, t in texts.items()}
    comp = components(sets, jaccard_links(sets, num, den))
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}


def test_whole_table_against_all_pairs(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"), read_texts(spark, sf), 3, 90, 100)


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 4, 5)])
def test_near_copies_and_edges(spark, words, num, den):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE two", "one two three", "é ß", "É ß"]
    for _ in range(4):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 30, 90, 300]))]
        texts.append(" ".join(base))
        for _ in range(15):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts += [" ".join(base)] * 3
    docs = docs_of(spark, texts).selectExpr("*", "1 as n", "2 as sig", "3 as component_id")
    check(spark, docs, dict(enumerate(texts)), words, num, den)


def test_null_ids_empty_tables_and_repeated_rows(spark):
    docs = docs_of(spark, ["a b c d", "a b c d"])
    assert jaccard.groups(Scratch(spark, "t"), docs.limit(0)).count() == 0
    both = docs.unionByName(docs).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in jaccard.groups(Scratch(spark, "t"), both).collect())
    assert got == [(False, 0, 0), (False, 0, 0), (False, 1, 0), (False, 1, 0), (True, 0, 0)]


def test_doubled_segments_tolerate_one_difference():
    bands, rng = jaccard.Bands(90, 100), np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**64, 100, dtype=np.uint64))
    tag = bands.of(len(h))
    m = bands.segments(tag)
    every = {tag: list(range(m))}
    whole = set(jaccard.signatures(h, bands, every)[0].tolist())
    for i in (0, 50, 99):
        less = np.delete(h, i)
        kept = jaccard.signatures(less, bands, {tag: list(range(m))})[0]
        assert whole & set(kept.tolist())


def test_allocation_keeps_the_pigeonhole_sum():
    bands, tag = jaccard.Bands(90, 100), jaccard.Bands(90, 100).of(200)
    cells = pd.DataFrame({"cell": [(tag << 32) + s for s in range(bands.segments(tag))], "pairs": [10.0] * (bands.segments(tag) - 2) + [1e7, 1e7]})
    out, doubled = jaccard.allocate(cells, bands, {tag: 100})
    assert len(out) == len(doubled[tag]) == 2 and not {c & 0xFFFFFFFF for c in out} & set(doubled[tag])
