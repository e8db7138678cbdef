"""Merkle manifest of a dataset: stored tree levels, and a recursive query that climbs from every row to the root.

Each row is a leaf. The leaves of a source, by doc_id, form a tree of FAN children a node, and the roots of the sources,
by source, form the tree above them. build() stores every node as a row that has its children's digests and a link to
its parent. climb() is one recursive query over those rows: each leaf moves to its parent, folds its digest with those
of its siblings and appends them, until a row has no parent. The siblings from the second level on are the same for all
leaves of a node, so only its first leaf gathers them; the others take them from it once the query has ended.

A node that more than HOT leaves climb through is stored in several copies, over which its leaves are dealt, so that the
few nodes near the root are no hot keys; copies are one for every HOT leaves at most. Nothing but digests and keys is
shuffled, no group has more than FAN rows, and rank windows see one row a partition and source.

Nulls and edges: a null value counts as "-", another one as its length in bytes, ":" and itself; a null source is the
first one; leaves with null ids come first; leaves of one source and id are ordered by their digest, and equal rows are
leaves of their own; a source with one leaf has that leaf as its root, and so has a dataset with one source; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import Scratch, if_small, table

FAN = 16
#: Leaves that climb through one copy of a node.
HOT = 256
NODE = "id string, children binary, pos int, up string, weight long"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Spark's bound on the rows of a recursive query; -1 is none.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CLIMB = """
WITH RECURSIVE climb (doc_id, leaf, source, run, first, single, at, up, spread, digest, proof) AS (
  SELECT doc_id, leaf, source, run, first, single, pos, up, spread, digest, X'' FROM {leaves}
  UNION ALL
  SELECT c.doc_id, c.leaf, c.source, c.run, c.first, c.single, n.pos, n.up, c.spread,
    unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.at), c.digest, substring(n.children, 32 * c.at + 33)))), 256)),
    CASE WHEN c.first THEN concat(c.proof, substring(n.children, 1, 32 * c.at), substring(n.children, 32 * c.at + 33)) ELSE c.proof END
  FROM climb c JOIN {nodes} n ON c.up = n.id AND pmod(c.spread, n.copies) = n.copy
)
SELECT * FROM climb WHERE up IS NULL
"""


@dataclass
class Manifest:
    """leaves (doc_id, source, leaf, other, rank, tree, run, at), nodes (id, children, pos, up, weight, digest), roots (source, tree, subroot), root."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    root: bytes | None


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_hex(value: Column | str) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(text: Column) -> Column:
    """Digest of a row, with this text."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return digest(F.concat(*[part(text if f == "text" else F.col(f)) for f in FIELDS]))


def ranked(scratch: Scratch, rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows with rank (from 0) and n in their group, by the given order; equal rows are dealt over partitions, too."""
    sides = [*[F.col(c).asc_nulls_first() for c in group], *order]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    by_range = numbered.repartitionByRange(*sides, "row").sortWithinPartitions(*sides, "row")
    placed = scratch.save(by_range.drop("row").withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.shiftright("place", 33)))
    key = F.struct(*group) if group else F.lit(0)
    per = placed.groupBy(key.alias("of"), F.col("range").alias("in_range")).agg(F.min("place").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("of")
    before = F.coalesce(F.sum("held").over(whole.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = scratch.save(per.select("of", "in_range", "first", before.alias("before"), F.sum("held").over(whole).alias("n")))
    both = placed.join(if_small(per), (placed["range"] == per["in_range"]) & key.eqNullSafe(per["of"]))
    return both.withColumn("rank", F.col("place") - F.col("first") + F.col("before")).drop("place", "range", "of", "in_range", "first", "before")


def node_id(tree: Column, level: int, index: Column) -> Column:
    return F.concat_ws("/", tree.cast("string"), F.lit(str(level)), index.cast("string"))


def _levels(scratch: Scratch, rows: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(stored levels, tops) of the trees over rows (tree, rank, n, digest, weight); a top has its node's id, null for a lone row."""
    levels, tops, level = [], [], 0
    now = rows.select("tree", "rank", "n", "digest", "weight", F.lit(None).cast("string").alias("id"))
    tops.append(now.where("n = 1"))
    while most > 1:
        level += 1
        listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda x: F.lower(F.hex(x["digest"])))
        runs = now.where("n > 1").groupBy("tree", F.floor(F.col("rank") / FAN).alias("rank"), F.ceil(F.col("n") / FAN).alias("n"))
        runs = runs.agg(F.array_join(listed, "").alias("text"), F.sum("weight").alias("weight"))
        made = runs.select(node_id(F.col("tree"), level, F.col("rank")).alias("id"), "tree", "rank", "n", digest(F.col("text")).alias("digest"), F.unhex("text").alias("children"), "weight")
        up = F.when(F.col("n") > 1, node_id(F.col("tree"), level + 1, F.floor(F.col("rank") / FAN)))
        now = scratch.save(made.withColumn("up", up))
        levels.append(now)
        tops.append(now.where("n = 1").select(*tops[0].columns))
        most = -(-most // FAN)
    return levels, tops


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(scratch: Scratch, docs: DataFrame, other: Column | None = None) -> Manifest:
    """The manifest of docs; other: digests of rows that are kept beside those of the leaves."""
    made = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf_digest(F.col("text")).alias("leaf"), (other if other is not None else F.lit(None).cast("binary")).alias("other"))
    made = ranked(scratch, scratch.save(made), ["source"], [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()])
    leaves = scratch.save(made)
    sources = leaves.groupBy("source").agg(F.count("*").alias("n"))
    sources = ranked(scratch, sources.select("source", F.col("n").alias("size")), [], [F.col("source").asc_nulls_first()]).withColumnsRenamed({"rank": "tree", "n": "of"})
    sources = scratch.save(sources)
    most, trees = sources.agg(F.max("size"), F.max("of")).first()
    if not most:
        none = leaves.withColumns({"tree": F.lit(0), "run": F.lit(""), "at": F.lit(0), "up": F.lit(None).cast("string")})
        return Manifest(none, docs.sparkSession.createDataFrame([], NODE), sources.withColumn("subroot", F.lit(None).cast("binary")), None)
    named = leaves.join(if_small(sources.select(F.col("source").alias("its"), "tree")), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    levels, tops = _levels(scratch, named.select("tree", "rank", "n", F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("weight")), most)
    tops = scratch.save(_union(tops).select("tree", F.col("digest").alias("subroot"), F.col("id").alias("top"), F.col("weight").alias("size")))
    roots = scratch.save(sources.select("source", "tree").join(if_small(tops.drop("size")), "tree"))
    above, last = _levels(scratch, tops.select(F.lit(-1).alias("tree"), F.col("tree").alias("rank"), F.lit(trees).alias("n"), F.col("subroot").alias("digest"), F.col("size").alias("weight")), trees)
    root = _union(last).select("digest").first()[0]
    beyond = (F.floor(F.col("tree") / FAN), F.pmod(F.col("tree"), F.lit(FAN))) if trees > 1 else (None, None)
    over = lambda own, otherwise: F.when(F.col("n") > 1, own).otherwise(otherwise)
    to_top = node_id(F.lit(-1), 1, beyond[0]) if trees > 1 else F.lit(None).cast("string")
    at_top = beyond[1] if trees > 1 else F.lit(0)
    place = F.pmod(F.col("rank"), F.lit(FAN))
    inner = [df.select("id", "children", over(place, at_top).cast("int").alias("pos"), over(F.col("up"), to_top).alias("up"), "weight") for df in levels]
    upper = [df.select("id", "children", place.cast("int").alias("pos"), "up", "weight") for df in above]
    nodes = _union(inner + upper) if inner or upper else docs.sparkSession.createDataFrame([], NODE)
    run = over(node_id(F.col("tree"), 1, F.floor(F.col("rank") / FAN)), to_top)
    placed = named.withColumns({"run": run, "at": over(place, at_top).cast("int"), "up": run})
    return Manifest(placed, nodes, roots, root)


def prove(scratch: Scratch, tree: Manifest) -> DataFrame:
    """(doc_id, source, leaf, folded_root, proof) for every leaf: proof has the digests of all siblings up to the root.

    folded_root is what the digest in other (the leaf's own, where it is null) and these siblings fold to.
    """
    spark: SparkSession = scratch.spark
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = F.least(F.lit(tasks), F.greatest(F.ceil(F.col("weight") / HOT), F.lit(1))).cast("int")
    nodes = tree.nodes.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    nodes = scratch.save(nodes.select("id", "children", "pos", "up", "copies", "copy"))
    single = F.col("n") == 1
    first = single | (F.col("at") == 0)
    leaves = tree.leaves.select("doc_id", "leaf", "source", "run", first.alias("first"), single.alias("single"), F.col("at").alias("pos"), "up", F.col("rank").alias("spread"), F.coalesce("other", "leaf").alias("digest"), "at")
    leaves = scratch.save(leaves)
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        climbed = scratch.save(spark.sql(CLIMB, leaves=leaves.drop("at"), nodes=nodes).select("doc_id", "leaf", "source", "run", "first", "single", "spread", "digest", "proof"))
    finally:
        spark.conf.set(ROW_LIMIT, before)
    # what the first leaf of a run gathered above the run is that of all its leaves
    head = climbed.where("first and not single").select(F.col("run").alias("id"), "proof")
    runs = nodes.where("copy = 0").select("id", "children")
    shared = head.join(runs, "id").select(F.col("id").alias("its"), "children", F.expr("substring(proof, octet_length(children) - 31)").alias("above"))
    # first leaves look for nothing, each under a key of its own
    both = climbed.join(shared, F.when(~F.col("first"), F.col("run")).otherwise(F.concat(F.lit("-"), "spread")) == F.col("its"), "left")
    at = F.pmod(F.col("spread"), F.lit(FAN)).cast("int")
    own = F.concat(F.substring("children", F.lit(1), 32 * at), F.substring("children", 32 * at + 33, F.octet_length("children")), "above")
    return both.select("doc_id", "source", "leaf", F.col("digest").alias("folded_root"), F.when(F.col("first"), F.col("proof")).otherwise(own).alias("proof"))


def tampered() -> Column:
    """Digest of a row whose text has its A-Z lower-cased, for ids whose crc32 five divides; null for the others."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return F.when(chosen, leaf_digest(F.translate(F.col("text"), UPPER, LOWER)))


def audit(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof against its tampered text."""
    tree = build(scratch, docs, tampered())
    proofs = prove(scratch, tree)
    subroots = if_small(tree.roots.select(F.col("source").alias("its"), "subroot"))
    rows = proofs.join(subroots, F.col("source").eqNullSafe(F.col("its")))
    root = F.lit(tree.root.hex() if tree.root else "")
    folded = as_hex("folded_root")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), as_hex("leaf").alias("leaf"), as_hex("subroot").alias("subroot"), root.alias("root"), F.sha2(as_hex("proof"), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(Scratch(spark, "merkle"), table(spark, sf_dir, "documents"))
