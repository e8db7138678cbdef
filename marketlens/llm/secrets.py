"""Secret scans with DataFrame functions only.

Three base kinds are found by pattern. The method adds spans of kind entropy: runs of token characters whose best
window has a Shannon entropy above the threshold of its character class. The window slides one character at a time with
the counts of its characters, five bits each in a few longs: the character that leaves takes one off its count, the one
that enters adds one, and both change the running sum of n log2 n; nothing is counted anew. Allow-listed candidates (placeholders, identifiers of known form) are suppressed.

Nulls and edges: a null text counts as empty and has no spans; overlapping spans of different kinds are all kept, but
an entropy span that touches a base span is not added; repeated rows give repeated rows; other columns are ignored;
long candidates are cut into overlapping stretches, so that every window is seen at a linear cost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so this equals [0-9a-f]+ of 16 or more
KINDS = ("assign", "access", "hex", "entropy")

WINDOW, STRETCH = 20, 128
#: Characters of candidates; the count of each has BITS bits (WINDOW needs no more), LANES to a long.
ALPHABET, BITS, LANES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 5, 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Least entropy (bits) of the best window, by character class; the first class that fits counts.
CLASSES = ((r"^[0-9]+$", 3.1), (r"^[A-Za-z+/_=-]+$", 4.05), (r"^[0-9a-fA-F]+$", 3.0), (r"^[a-z0-9]+$|^[A-Z0-9]+$", 3.5), (r"^[A-Za-z0-9+/_=-]+$", 3.7))
ALLOWED = r"(?i)example|placeholder|changeme|your[_-]|x{4,}|0{7,}|123456789|abcdefgh|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _weight(n: Column) -> Column:
    return F.get(F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 2)]), n)


def best_entropy(text: Column) -> Column:
    """The largest entropy of any window of a string of at most STRETCH + WINDOW characters of ALPHABET; 0 for shorter ones."""
    slot = lambda at: F.position(F.substring(text, at, F.lit(1)), F.lit(ALPHABET)) - 1
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, F.floor(c / LANES).cast("int")), c % LANES * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    one = lambda c, word: F.when(F.floor(c / LANES) == word, F.call_function("shiftleft", F.lit(1).cast("long"), c % LANES * BITS)).otherwise(F.lit(0).cast("long"))

    def step(state: Column, at: Column) -> Column:
        full, enters = at > WINDOW, slot(at)
        leaves = F.when(full, slot(F.greatest(F.lit(1), at - WINDOW))).otherwise(F.lit(-1))
        was = count(state["counts"], F.greatest(leaves, F.lit(0)))
        now = count(state["counts"], enters) - F.when(leaves == enters, 1).otherwise(0)
        gone = F.when(full, _weight(was) - _weight(was - 1)).otherwise(0.0)
        total = state["total"] - gone + _weight(now + 1) - _weight(now)
        counts = F.transform(state["counts"], lambda n, word: n + one(enters, word) - F.when(full, one(leaves, word)).otherwise(F.lit(0).cast("long")))
        best = F.when(at >= WINDOW, F.greatest(state["best"], math.log2(WINDOW) - total / WINDOW)).otherwise(state["best"])
        return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

    none = F.array(*[F.lit(0).cast("long")] * -(-len(ALPHABET) // LANES))
    start = F.struct(none.alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.when(F.length(text) >= WINDOW, F.aggregate(F.sequence(F.lit(1), F.length(text)), start, step, lambda s: s["best"])).otherwise(0.0)


def looks_random(candidate: Column) -> Column:
    """Whether a candidate reaches the threshold of its class and is not allow-listed."""
    least = F.lit(99.0)
    for pattern, bits in reversed(CLASSES):
        least = F.when(candidate.rlike(pattern), bits).otherwise(least)
    cut = rf"(.{{1,{STRETCH}}})(?=(.{{0,{WINDOW - 1}}}))"
    stretches = F.zip_with(F.regexp_extract_all(candidate, F.lit(cut), F.lit(1)), F.regexp_extract_all(candidate, F.lit(cut), F.lit(2)), lambda a, b: F.concat(a, b))
    return F.when(~candidate.rlike(ALLOWED), F.exists(stretches, lambda s: best_entropy(s) >= least)).otherwise(False)


def _spans(df: DataFrame, kind: str, pattern: str, keep, only_if: Column | None = None) -> DataFrame:
    """Adds an array of (start, kind, end) of the leftmost non-overlapping matches that keep() accepts, in code points.

    The pieces between the matches give the positions: both are measured and summed from the left.
    """
    found, none = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.array().cast("array<string>")
    df = df.withColumn("found", found if only_if is None else F.when(only_if, found).otherwise(none))
    df = df.withColumn("between", F.when(F.size("found") > 0, F.slice(F.split("text", pattern, -1), F.lit(1), F.size("found"))).otherwise(none))
    measured = F.zip_with("between", "found", lambda b, m: F.struct(F.length(b).alias("skip"), F.length(m).alias("size"), keep(m).alias("keep")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

    def step(state: Column, m: Column) -> Column:
        begin, end = state["at"] + m["skip"], state["at"] + m["skip"] + m["size"]
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(m["keep"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return df.withColumn(kind, F.aggregate(measured, start, step, lambda s: s["spans"])).drop("found", "between")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, entropy): the spans of each kind; one row for each row, no shuffle."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = _spans(df, "assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12)
    df = _spans(df, "access", ACCESS, lambda m: F.length(m) >= 18, F.contains("text", F.lit("AKIA")))
    df = _spans(df, "hex", HEX, lambda m: F.lit(True))
    df = _spans(df, "entropy", CANDIDATE, looks_random)
    base = F.concat("assign", "access", "hex")
    apart = F.filter("entropy", lambda e: ~F.exists(base, lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return df.select("doc_id", "assign", "access", "hex", F.when(F.size("entropy") > 0, apart).otherwise(F.col("entropy")).alias("entropy"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    text = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def query(spark, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return df.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, F.col("entropy"))).alias("spans"))
