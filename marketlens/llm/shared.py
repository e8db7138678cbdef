"""What the operators of this subpackage share: tables, shared storage, checked broadcasts, labels, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows (of a few longs each) that are sent to every executor; beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one below the warehouse where it is unset.

    A warehouse on the driver's disk serves only where the executors run there too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_scratch"


#: Spark's own setting to remove the shuffle files of a query when it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def give_back() -> None:
    """Returns memory that is free again to the system, where the C library can; else it stays with the driver's process."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Scratch:
    """Intermediate tables of one run, written to the shared folder, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = self.spark.conf.get(FILE_CLEANUP)
        self.spark.conf.set(FILE_CLEANUP, "true")  # what is written is read from the table, never from the shuffles
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(FILE_CLEANUP, before)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *saved: DataFrame) -> None:
        """Removes tables that no later plan reads."""
        for df in saved:
            self._delete(df._scratch_path)

    def close(self) -> None:
        """Removes all tables of the run; to be called when its results are written elsewhere."""
        self._delete(self.base)


def if_small(df: DataFrame, wide: str | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast when it was counted to hold at most so many rows, else unmarked (a shuffled join follows).

    wide: an array column, whose elements are counted instead of rows.
    """
    if wide is None:
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    return F.broadcast(df) if (df.agg(F.sum(F.size(wide))).first()[0] or 0) + df.limit(most + 1).count() <= most else df


def bucket_of(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a row."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def labelled(spark, sf_dir, label: str, modulus: int, held: int) -> DataFrame:
    """(doc_id, y): the labels outside the held-out fold; of several labels of a document the largest counts."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.where(bucket_of("doc_id", modulus) != held)


def labelled_sample(spark, sf_dir, label: str, modulus: int, held: int, positives: int, negatives: int) -> DataFrame:
    """(doc_id, y): at most so many rows of each class outside the held-out fold, by the order of a hash of the id."""
    rows = labelled(spark, sf_dir, label, modulus, held)
    take = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return take(1, positives).unionByName(take(0, negatives))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (a, b): component is the smallest node that its links reach.

    Large-star and small-star rounds: each node's neighbours are hung on the smallest node of its neighbourhood until
    the edges are stars. Each round costs one aggregation and one join on the node and is written to the shared
    folder; their number grows with the logarithm of the number of nodes. Edges with a null end, loops and repeats
    count for nothing. An empty table gives an empty result.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    now = scratch.save(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state = None
    while state is None or was != state:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        new = scratch.save(small.select("e.*").where("a <> b").distinct())
        was, state = state, new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
    out = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    both = out.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
    saved = scratch.save(both)
    scratch.drop(now)
    return saved


def sharing(scratch: Scratch, entries: DataFrame, *stats: Column, where: Column | None = None, aside: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(entries with the least and largest doc of their sig, one row for each sig) of what two different docs share.

    entries (sig, doc) is a saved table. It is aggregated before it is joined, so that a sig that very many docs have
    is one row for each task, and then a skewed key of a join, which Spark splits. stats: more columns for each sig,
    where: a condition on them, without which a sig goes; aside: columns of entries that only these need.
    """
    per = entries.groupBy("sig").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), *stats).where("low <> high")
    per = scratch.save(per if where is None else per.where(where))
    return scratch.save(entries.drop(*aside).join(per.select("sig", "low", "high"), "sig")), per


def connect(scratch: Scratch, entries: DataFrame, brief: DataFrame, bound: Callable[[str, str], Column], verified: Callable[[DataFrame], DataFrame], nearness: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(node, component) of the links among docs that share an entry (sig, doc, low, high), as sharing() gives them.

    brief has doc_id and what bound(left, right), a cheap necessary condition on two aliases, needs; verified() keeps
    the pairs (a, b) that link. Docs are first paired with the least and the largest doc of their entries only: each
    with the one that it shares most entries with, then with the others that are not yet in its component. Last, all
    pairs of an entry in different components are compared, starting from the side outside the entry's largest
    component. Pairs inside a component could not change it, so no link between components is lost, and no group of
    linked docs is expanded into all pairs. nearness(left, right) says which partner of as many entries comes first.
    """
    ends = entries.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("doc").alias("b")), F.struct(F.col("doc").alias("a"), F.col("high").alias("b")))).alias("e"))
    often = ends.select("e.*").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    of = lambda name: brief.select(F.col("doc_id").alias(f"{name}_id"), F.struct(*[c for c in brief.columns if c != "doc_id"]).alias(name))
    first = scratch.save(often.join(of("p"), F.col("a") == F.col("p_id")).join(of("q"), F.col("b") == F.col("q_id")).where(bound("p", "q")).select("a", "b", F.struct("n", nearness("p", "q")).alias("n") if nearness else "n"))
    each = first.select(F.explode(F.array("a", "b")).alias("doc"), F.struct("n", "a", "b").alias("pair"))
    best = scratch.save(each.groupBy("doc").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct())
    comp = components(scratch, verified(best))
    at = lambda name: comp.select(F.col("node").alias(f"{name}_at"), F.col("component").alias(f"{name}_in"))
    rest = first.join(at("a"), F.col("a") == F.col("a_at"), "left").join(at("b"), F.col("b") == F.col("b_at"), "left")
    rest = rest.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    more = verified(rest)
    stars = lambda: comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
    comp = components(scratch, stars().unionByName(more))
    per = comp.groupBy("component").agg(F.count("*").alias("members"))
    named = comp.join(per, "component").select(F.col("node").alias("doc"), "component", "members")
    rows = entries.select("sig", "doc").join(named, "doc", "left")
    rows = scratch.save(rows.select("sig", "doc", F.coalesce("component", "doc").alias("component"), F.coalesce("members", F.lit(1)).alias("members")))
    groups = rows.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max(F.struct("members", "component")).alias("main"))
    groups = scratch.save(groups.where("least <> most").select("sig", F.col("main.component").alias("main")))
    # written, as both sides of the next join read it: its shuffles are gone before that join's are made
    mixed = scratch.save(rows.join(groups, "sig").select("sig", "doc", "component", "main"))
    scratch.drop(rows, groups)
    full = mixed.join(brief, F.col("doc") == F.col("doc_id"))
    l, r = full.where("component <> main").alias("l"), full.alias("r")
    once = (F.col("r.component") == F.col("l.main")) | (F.col("l.doc") < F.col("r.doc"))
    pairs = l.join(r, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.component") != F.col("r.component")) & once & bound("l", "r"))
    pairs = pairs.select(F.least("l.doc", "r.doc").alias("a"), F.greatest("l.doc", "r.doc").alias("b")).distinct()
    last = verified(scratch.save(pairs.join(first, ["a", "b"], "left_anti")))
    final = components(scratch, stars().unionByName(last))
    scratch.drop(first, best, mixed)
    return final
