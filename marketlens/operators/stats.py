"""Counts, breakdowns, windows and selections over crawled pages and runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import urls


def category_breakdown(pages, by=("session_id",)):
    return pages.groupBy(*by, "primary_category").agg(F.count("*").alias("n"))


def scoring_breakdown(pages, by=("session_id",)):
    return pages.groupBy(*by, "scoring_method").agg(F.count("*").alias("n"), F.count_if(F.col("ai_success")).alias("ok"), F.count_if(~F.col("ai_success") & F.col("ai_score").isNotNull()).alias("failed"))


def score_averages(pages, by=("session_id",)):
    return pages.groupBy(*by).agg(F.round(F.avg(F.when(F.col("ai_success"), F.col("ai_score"))), 9).alias("avg_ai"), F.round(F.avg("rules_score"), 9).alias("avg_rules"))


def scoring_audit(pages):
    tried = F.contains("reason", F.lit("attempted"))
    return pages.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(tried & F.col("ai_success")).alias("successful"), F.count_if(tried & ~F.col("ai_success")).alias("failed"), F.count_if(~tried).alias("skipped"))


def discovery_summary(pages, threshold: float = 0.5):
    return pages.agg(F.count_if(F.col("scoring_method") == "ai").alias("ai_scored"), F.count_if(F.col("scoring_method") == "rules").alias("rules_scored"), F.round(F.avg("score"), 3).alias("mean_score"), F.count_if(F.col("score") >= threshold).alias("valuable"))


def company_stats(companies, products, signals, links, as_of: str, days: int = 60):
    from marketlens.operators.catalog import days_before

    p = products.groupBy("company_id").agg(F.count("*").alias("products"))
    recent = signals.where(F.col("published_at") >= days_before(as_of, days))
    s = recent.select(F.explode("company_ids").alias("company_id"), "id").distinct().groupBy("company_id").agg(F.count("*").alias("signals"))
    c = links.join(products.select(F.col("id").alias("product_id"), "company_id"), "product_id").groupBy("company_id").agg(F.count_distinct("capability_id").alias("capabilities"))
    out = companies.select(F.col("id").alias("company_id"))
    for part in (p, s, c):
        out = out.join(part, "company_id", "left")
    return out.na.fill(0)


def session_stats(sources, by="market"):
    """Rows, failures, cache hits and entities of each kind for each run."""
    return sources.groupBy(by).agg(F.count("*").alias("processed"), F.count_if(F.col("confidence") == 0).alias("failed"), F.count_if(F.col("method") == "rules").alias("cache_hits"), F.count_distinct("name").alias("entities"), F.count_distinct("company_id").alias("companies"))


ENTITY_TYPES = ("company", "product", "capability", "release", "document", "signal")
PAGE_OUTCOMES = ("processed", "skipped", "failed")


def run_counters(runs, outcomes, found, changes):
    """Counters of every extraction run (id): its pages by outcome, cache hits and retries, entities by type, changes.

    outcomes (session_id, outcome, cache_hit, retries) has a row for each page, found (session_id, entity_type, entity_id)
    one for each fact, changes (session_id) one for each change. Every table is aggregated by run before it is joined.
    """
    per_page = outcomes.groupBy("session_id").agg(*[F.count_if(F.col("outcome") == o).alias(f"{o}_pages") for o in PAGE_OUTCOMES], F.count_if("cache_hit").alias("cache_hits"), F.sum("retries").cast("long").alias("total_retries"))
    per_type = found.select("session_id", "entity_type", "entity_id").distinct().groupBy("session_id").pivot("entity_type", list(ENTITY_TYPES)).count()
    per_type = per_type.withColumnsRenamed({t: f"{t}_found" for t in ENTITY_TYPES})
    per_change = changes.groupBy("session_id").agg(F.count("*").alias("changes_detected"))
    out = runs.select(F.col("id").alias("session_id"))
    for part in (per_page, per_type, per_change):
        out = out.join(part, "session_id", "left")
    return out.na.fill(0)


def scoring_details(pages):
    """One row a page with what became of its scoring by the model: successful, failed or skipped, and why."""
    tried = F.contains("reason", F.lit("attempted"))
    outcome = F.when(tried & F.col("ai_success"), "successful").when(tried, "failed").otherwise("skipped")
    return pages.select("session_id", "id", "url", outcome.alias("outcome"), F.coalesce("reason", F.lit("unknown")).alias("reason"), "ai_score", "rules_score", "score", "scoring_method")


def progress_metrics(df, done="done", total="total", elapsed="elapsed"):
    """pages_per_minute and eta_seconds of runs; nothing remains means 0."""
    rate = F.col(done) / F.greatest(F.col(elapsed), F.lit(1)) * 60
    left = F.col(total) - F.col(done)
    return df.withColumn("pages_per_minute", F.round(rate, 6)).withColumn("eta_seconds", F.when(left > 0, F.floor(left / F.greatest(rate / 60, F.lit(0.1)))).otherwise(0).cast("long"))


def confidence_rollup(sources, by=("url",), least: float = 0.6):
    out = sources.groupBy(*by).agg(F.max("confidence").alias("best"), F.round(F.avg("confidence"), 9).alias("overall"), F.count("*").alias("found"))
    return out.withColumn("success", (F.col("overall") >= least) & (F.col("found") > 0))


def content_set_hash(pages, by=("session_id",)):
    return pages.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("content_hash")), ""), 256).alias("set_hash"))


def first_page(pages, key: str = "canonical_url", order: str = "id"):
    """The page that stands for each page of the same key: the first by order."""
    return pages.withColumn("kept_id", F.first_value(order).over(Window.partitionBy("session_id", key).orderBy(order)))


def duplicate_map(pages):
    return first_page(pages).where(F.col("id") != F.col("kept_id")).select("session_id", "id", "kept_id")


def dedupe_pages(pages):
    return first_page(pages).where(F.col("id") == F.col("kept_id")).drop("kept_id")


def cap_pages(pages, per_domain: int = 100, per_category: int = 100, approx: bool = False):
    """Greedy by score: a page stays while its domain and its category both have room, in its session.

    Exact: whether a page stays depends on those before it, so each session walks its narrow columns once. approx:
    two windows, domain rank and then category rank of the survivors; the same when only one cap binds.
    """
    order = [F.desc("score"), F.asc("id")]
    if approx:
        first = pages.withColumn("rd", F.row_number().over(Window.partitionBy("session_id", "domain").orderBy(*order))).where(F.col("rd") <= per_domain)
        return first.withColumn("rc", F.row_number().over(Window.partitionBy("session_id", "primary_category").orderBy(*order))).where(F.col("rc") <= per_category).drop("rd", "rc")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        room: dict = {}
        keep = []
        for domain, category in zip(rows["domain"], rows["primary_category"], strict=True):
            d, c = ("d", domain), ("c", category)
            ok = room.get(d, 0) < per_domain and room.get(c, 0) < per_category
            if ok:
                room[d], room[c] = room.get(d, 0) + 1, room.get(c, 0) + 1
            keep.append(ok)
        return rows.loc[keep, ["session_id", "id"]]

    # no more than per_domain pages of a domain and per_category of a category can stay, whatever the others do
    # so of a domain and category no page behind the first so many stays, as each before it stayed or met a full cap
    narrow = pages.select("session_id", "id", "domain", "primary_category", "score")
    pair = Window.partitionBy("session_id", "domain", "primary_category").orderBy(F.desc_nulls_last(F.nanvl("score", F.lit(None))), "id")  # as the walk sorts
    narrow = narrow.withColumn("place", F.row_number().over(pair)).where(F.col("place") <= min(per_domain, per_category)).drop("place")
    kept = narrow.groupBy("session_id").applyInPandas(walk, "session_id int, id long")
    return pages.join(kept, ["session_id", "id"], "left_semi")


def select_pages(pages, threshold: float = 0.5, per_domain: int = 100, per_category: int = 100):
    return cap_pages(dedupe_pages(pages.where(F.col("score") >= threshold)), per_domain, per_category)


def filter_funnel(pages, threshold: float = 0.5, per_domain: int = 100, per_category: int = 100):
    """Rows in, after the score, after dedupe and after caps, by session."""
    high = pages.where(F.col("score") >= threshold)
    count = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    unique = dedupe_pages(high)
    out = count(pages, "rows_in")
    for df, name in ((high, "scored"), (unique, "unique_pages"), (cap_pages(unique, per_domain, per_category), "capped")):
        out = out.join(count(df, name), "session_id", "left")
    return out.na.fill(0)


def profile_sketches(df, columns: list[str], bits: int = 16):
    """(column_name, n, valid, sketch) in one pass without more rows: counts and a mergeable sketch of the different values.

    Sketches can be stored and united: merge_profiles() of the profiles of parts is the profile of the whole table. The
    estimate of a united sketch has a standard error of 1.04 / sqrt(2 ** bits), 0.4 % for 16 bits (64 KB a column).
    """
    one = lambda c: F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n"), F.count(c).alias("valid"), F.hll_sketch_agg(F.col(c).cast("string"), bits).alias("sketch"))
    return df.agg(F.array(*[one(c) for c in columns]).alias("p")).select(F.inline("p"))


def merge_profiles(profiles):
    return profiles.groupBy("column_name").agg(F.sum("n").alias("n"), F.sum("valid").alias("valid"), F.hll_union_agg("sketch").alias("sketch"))


def profile_estimates(profiles):
    """(column_name, n, valid, nulls, different): different is an estimate, within 2 % (4.9 standard errors) for sketches of 16 bits."""
    return profiles.select("column_name", "n", "valid", (F.col("n") - F.col("valid")).alias("nulls"), F.hll_sketch_estimate("sketch").alias("different"))


def column_profile(df: DataFrame, columns: list[str]):
    """Nulls, values and exact distinct values of each column, in one pass."""
    stats = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n"), F.count(c).alias("valid"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("different")) for c in columns])
    return df.agg(stats.alias("s")).select(F.inline("s"))


def top_by(df, by: list[str], order: list[Column], k: int):
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_by_category(pages, k: int = 10):
    return top_by(pages.where(F.col("primary_category") != "legal"), ["session_id", "primary_category"], [F.desc("score"), F.asc("url"), F.asc("id")], k)


def top_pages(pages, k: int = 10):
    return pages.orderBy(F.desc("score"), F.asc("id")).limit(k)


def latest_run(sessions, by: str, order: str = "started_at"):
    return top_by(sessions, [by], [F.desc_nulls_last(order), F.desc("id")], 1).drop("rank")


def prioritise_seeds(seeds, max_pages: int, url: str = "url"):
    """Kept seeds by priority, then URL, within seven tenths of the pages allowed."""
    kept = seeds.withColumn("reason", urls.skip_reason(F.col(url))).where("reason is null").drop("reason")
    return kept.withColumn("priority", urls.priority(F.col(url))).orderBy("priority", url).limit(int(0.7 * max_pages))


def prioritise_links(links, url: str = "to_url"):
    return links.withColumn("priority", urls.priority(F.col(url), urls.LINK_FIRST))
