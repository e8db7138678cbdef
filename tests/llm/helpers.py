"""Brute-force versions and small inputs for the tests."""

from itertools import combinations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    """documents with ids 0, 1, ...; a text may be None."""
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def write_tables(spark, path, documents, **more):
    for name, df in {"documents": documents, **more}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def read_texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard_links(sets, num, den):
    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num and len(x & y) * den >= len(x | y) * num:
            yield a, b
