"""The link graph as a table: which pages a crawl reaches, and the report of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import urls
from marketlens.storage import new_folder


def reach(seeds: DataFrame, links: DataFrame, max_depth: int = 2, max_pages: int | None = None) -> DataFrame:
    """(url, depth): each page at its least depth, from seeds (url) over links (from_url, to_url), skipped URLs left out.

    URLs are made canonical first, so each page counts once whatever its spelling; that costs far more than a join, so
    it is done once for each different spelling, not for each link. The links are written once; each level joins the
    spellings of its pages with the links, and only what a level reaches for the first time is tested: it is written
    before, as the test, which costs as much, would otherwise move below the joins and meet every link. Every level is
    written to the shared folder, so that a lost executor costs no recomputation of earlier levels. max_pages keeps the
    first by depth, priority and URL.
    """
    spark = seeds.sparkSession
    base = new_folder(spark, "reach")

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    plain = saved(links.where("from_url is not null and to_url is not null").select("from_url", "to_url").distinct(), "links")
    # to a stated number of tasks: few bytes of URLs are much work
    dealt = lambda df: df.distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = saved(dealt(plain.select(F.explode(F.array("from_url", "to_url")).alias("written"))).withColumn("page", urls.canonical_url(F.col("written"))), "names")
    kept = lambda df: df.where(urls.skip_reason(F.col("written")).isNull()).select(F.col("page").alias("url")).distinct()
    first = saved(dealt(seeds.select(F.col("url").alias("written"))), "seeds").withColumn("page", urls.canonical_url(F.col("written")))
    seen = saved(kept(first).withColumn("depth", F.lit(0)), "0")
    frontier = seen
    for depth in range(1, max_depth + 1):
        spelt = names.join(frontier.select(F.col("url").alias("page")), "page").select(F.col("written").alias("from_url"))
        step = plain.join(spelt, "from_url").select(F.col("to_url").alias("written")).distinct().join(names, "written")
        new = saved(dealt(step.join(seen.select(F.col("url").alias("page")), "page", "left_anti")), f"{depth}-new")
        frontier = saved(kept(new).withColumn("depth", F.lit(depth)), str(depth))
        seen = seen.unionByName(frontier)
    if max_pages is not None:
        seen = seen.orderBy("depth", urls.priority(F.col("url"), urls.LINK_FIRST), "url").limit(max_pages)
    return seen


def discovery_report(candidates: DataFrame, url: str = "url") -> DataFrame:
    """(outcome, n): URLs kept, and skipped by kind of reason."""
    reason = F.split_part(urls.skip_reason(F.col(url)), F.lit(":"), F.lit(1))
    return candidates.withColumn("outcome", F.coalesce(reason, F.lit("kept"))).groupBy("outcome").agg(F.count("*").alias("n"))
