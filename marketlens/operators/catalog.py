"""List, search, lookup and join questions over the catalog tables. Sorts end with the key and place nulls explicitly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import text, urls


def matches(term: str | None, columns: tuple[str, ...] = (), arrays: tuple[str, ...] = ()) -> Column:
    """Any of the columns, or any element of the arrays, contains the term (% and _ are wildcards); true without a term."""
    if not term:
        return F.lit(True)
    like = f"%{term}%"
    found = [F.coalesce(F.col(c), F.lit("")).ilike(like) for c in columns] + [F.exists(a, lambda x: x.ilike(like)) for a in arrays]
    return F.coalesce(reduce(Column.__or__, found), F.lit(False))


def equals(**values) -> Column:
    """All given columns equal their value; None leaves a column free."""
    return reduce(Column.__and__, [F.col(c) == v for c, v in values.items() if v is not None], F.lit(True))


def window_of(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    df = df.orderBy(*order)
    return (df.offset(offset) if offset else df).limit(limit)


def list_companies(df, search=None, status=None, limit=100, offset=0):
    found = df.where(matches(search, ("name",), ("aliases", "tags")) & equals(status=status))
    return window_of(found, [F.desc_nulls_last("is_self"), F.asc_nulls_last("name"), F.asc("id")], limit, offset)


def list_products(df, search=None, company_id=None, category=None, stage=None, limit=100, offset=0):
    found = df.where(matches(search, ("name", "short_desc"), ("tags",)) & equals(company_id=company_id, category=category, stage=stage))
    return window_of(found, [F.asc_nulls_last("name"), F.asc("id")], limit, offset)


def list_capabilities(df, search=None, limit=100, offset=0):
    found = df.where(matches(search, ("name", "definition", "tag"))).withColumn("definition", F.coalesce("definition", F.lit("")))
    return window_of(found, [F.asc_nulls_last("name"), F.asc("id")], limit, offset)


def list_sources(df, search=None, credibility=None, limit=100, offset=0):
    found = df.where(matches(search, ("origin", "author")) & equals(credibility=credibility))
    return window_of(found, [F.asc_nulls_last("origin"), F.asc("id")], limit, offset)


def days_before(as_of: str, days: int) -> Column:
    return F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"interval {int(days)} days")


def list_signals(df, *, as_of, type=None, impact=None, company_id=None, product_id=None, days=None, search=None, limit=100, offset=0):
    keep = matches(search, ("headline", "summary")) & equals(type=type, impact=impact)
    if company_id:
        keep &= F.array_contains("company_ids", company_id)
    if product_id:
        keep &= F.array_contains("product_ids", product_id)
    if days:
        keep &= F.col("published_at") >= days_before(as_of, days)
    return window_of(df.where(keep), [F.desc_nulls_last("published_at"), F.asc("id")], limit, offset)


def get_by_ids(df, ids: DataFrame, key: str = "id"):
    """The rows whose key is among ids (a table of one column); unknown ids give nothing."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def children(parents, kids, parent_id: str, key: str):
    """Rows of kids of one parent; an unknown parent is an error rather than an empty answer."""
    if parents.where(F.col("id") == parent_id).isEmpty():
        raise LookupError(f"no such row: {parent_id}")
    return kids.where(F.col(key) == parent_id)


def company_signals(signals, company_id, *, as_of, days=60, limit=50):
    return list_signals(signals, as_of=as_of, company_id=company_id, days=days, limit=limit)


def facet_signals(df, *, types=(), companies=(), products=(), capabilities=(), impacts=(), impact_range=None, since=None):
    """OR inside a facet, AND between facets; chosen impact levels replace the impact range."""
    keep = F.lit(True)
    if types:
        keep &= F.col("type").isin(*types)
    for column, values in (("company_ids", companies), ("product_ids", products), ("capability_ids", capabilities)):
        if values:
            keep &= F.arrays_overlap(column, urls.literals(values))
    level = F.col("impact").cast("int")
    if impacts:
        keep &= level.isin(*impacts)
    elif impact_range:
        keep &= level.between(*impact_range)
    if since:
        keep &= F.col("published_at") >= F.to_timestamp_ntz(F.lit(since))
    return df.where(keep)


def since_preset(preset: str, as_of: str) -> str:
    """The first day of 7d, 30d or ytd, counting the present one."""
    from datetime import date, timedelta

    day = date.fromisoformat(as_of[:10])
    return {"7d": day - timedelta(6), "30d": day - timedelta(29), "ytd": day.replace(month=1, day=1)}[preset].isoformat()


def paginate(df, page: int, order: list[Column], size: int = 25):
    """The rows of a page, each with the number of pages."""
    pages = df.agg(F.ceil(F.count("*") / size).cast("long").alias("total_pages"))
    return window_of(df, order, size, (page - 1) * size).crossJoin(F.broadcast(pages))


def split_urls(df, url="url"):
    """Rows with skip and reason of the site filter."""
    reason = urls.skip_reason(F.col(url))
    return df.withColumn("reason", reason).withColumn("skip", F.col("reason").isNotNull())


def scoring_eligibility(df):
    """Whether a page (url, title, h1, h2, h3, content_length) is worth a model call, and why not."""
    blank = reduce(Column.__and__, [F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in ("title", "h1", "h2", "h3")])
    hits = F.filter(urls.literals(urls.NOISE_SCORING), lambda w: F.contains(F.lower("url"), w))
    reason = F.when(blank & (F.col("content_length") <= 100), "no minimal content").when(F.size(hits) > 0, F.concat(F.lit("noise: "), F.array_join(hits, ", "))).otherwise("eligible")
    return df.withColumn("scoring_reason", reason).withColumn("eligible", reason == "eligible")


def session_status(df, fail_threshold: float = 0.3):
    share = F.col("failed") / F.col("total")
    state = F.when(F.col("completed_at").isNull(), "running").when((F.col("total") > 0) & (F.col("failed") >= F.col("total")), "failed").when((F.col("total") > 0) & (share > fail_threshold), "degraded").otherwise("completed")
    return df.withColumn("state", state)


def split_existing_runs(requests, sessions, keys: list[str], force: bool = False):
    """requests with reused: whether a session has the same keys already, unless forced."""
    known = sessions.select(*keys).distinct().withColumn("reused", F.lit(not force))
    return requests.join(known, keys, "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def website_columns(df):
    url = urls.with_scheme(F.col("website"))
    return df.withColumn("website_url", url).withColumn("website_host", urls.bare_host(url))


def product_capabilities(links, capabilities, product_id=None):
    found = links if product_id is None else links.where(F.col("product_id") == product_id)
    nested = capabilities.select(F.col("id").alias("capability_id"), F.struct("id", "name", F.coalesce("definition", F.lit("")).alias("definition")).alias("capability"))
    return found.join(nested, "capability_id")


def product_company(products, companies):
    return products.alias("p").join(companies.alias("c"), F.col("p.company_id") == F.col("c.id"))


def signals_with_source(signals, sources):
    return signals.alias("s").join(sources.alias("o"), F.col("s.source_id") == F.col("o.id"), "left")


def products_with_signals(products, signals):
    ids = signals.select(F.explode("product_ids").alias("id")).distinct()
    return products.join(ids, "id", "left_semi")


def match_existing_companies(candidates, companies):
    """candidates (cid, domain, name) with the first company of the same registrable domain or, else, bare name.

    Two equi joins instead of one with OR; per candidate the first company in order wins, domain before name.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    known = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), urls.registrable_domain(urls.bare_host(urls.with_scheme(F.col("website")))).alias("domain"), bare(F.col("name")).alias("bare"), F.col("pos"))
    wanted = candidates.select("cid", "domain", bare(F.col("name")).alias("bare"))
    by_domain = wanted.where("domain is not null").join(known.drop("bare"), "domain").select("cid", "company_id", "company_name", "pos", F.lit(0).alias("how"))
    by_name = wanted.where("length(bare) > 2").join(known.drop("domain"), "bare").select("cid", "company_id", "company_name", "pos", F.lit(1).alias("how"))
    order = Window.partitionBy("cid").orderBy("pos", "how", "company_id")
    best = by_domain.unionByName(by_name).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return best.select("cid", "company_id", F.when(F.col("how") == 0, "domain").otherwise("name").alias("matched_by"))


def apply_scores(pages, scores):
    """A model score above 0 replaces score and category of the latest page of its canonical URL; updated tells which."""
    latest = Window.partitionBy("canonical_url").orderBy(F.desc("crawled_at"), F.desc("id"))
    new = scores.where("new_score > 0").select(F.col("canonical_url").alias("scored_url"), "new_score", "new_category")
    ranked = pages.withColumn("rn", F.row_number().over(latest))
    both = ranked.join(new, (F.col("canonical_url") == F.col("scored_url")) & (F.col("rn") == 1), "left")
    both = both.withColumn("updated", F.col("new_score").isNotNull()).withColumns({"score": F.coalesce("new_score", "score"), "primary_category": F.coalesce("new_category", "primary_category")})
    return both.drop("rn", "scored_url", "new_score", "new_category")


def probe_cache(requests, cache, as_of: str):
    """requests with hit and response: entries of the same key that have not expired."""
    live = cache.where(F.col("expires_at") > F.to_timestamp_ntz(F.lit(as_of))).select("cache_key", "response", F.lit(True).alias("hit"))
    return requests.join(live.dropDuplicates(["cache_key"]), "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def update_cache(cache, new, as_of: str, days: int = 30):
    """The newer entry of each key; new ones expire after some days."""
    fresh = new.withColumn("expires_at", F.to_timestamp_ntz(F.lit(as_of)) + F.expr(f"interval {int(days)} days")).withColumn("age", F.lit(0))
    both = cache.withColumn("age", F.lit(1)).unionByName(fresh)
    latest = Window.partitionBy("cache_key").orderBy("age", F.desc("n"))
    return both.withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn", "age")


def companies_matching(df, term: str):
    t = term.lower()
    return df.where(F.contains(F.lower("name"), F.lit(t)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(t))))


def orphans(child, parent, key: str, parent_key: str = "id"):
    """Rows whose reference is set but leads nowhere."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def signal_links(signals, ids: str, name: str):
    return signals.select(F.col("id").alias("signal_id"), F.explode(ids).alias(name)).distinct()


def global_search(companies, products, signals, query: str):
    """Hits of all three kinds in one shape; a prefix company:, product: or signal: restricts to one; blank finds nothing."""
    kind, _, rest = query.partition(":")
    kinds, term = ([kind], rest.strip()) if rest and kind in ("company", "product", "signal") else (["company", "product", "signal"], query.strip())
    shape = lambda df, kind, title, sub, text: df.select(F.lit(kind).alias("type"), F.col("id"), F.col(title).alias("title"), F.col(sub).alias("subtitle"), F.col(text).alias("description"), F.lit(100).alias("score"))
    parts = {
        "company": shape(companies.where(matches(term, ("name",), ("aliases", "tags"))), "company", "name", "hq_country", "website"),
        "product": shape(products.where(matches(term, ("name", "short_desc"), ("tags",))), "product", "name", "category", "short_desc"),
        "signal": shape(signals.where(matches(term, ("headline", "summary"))), "signal", "headline", "type", "summary"),
    }
    found = reduce(DataFrame.unionByName, [parts[k] for k in kinds])
    return found if term else found.limit(0)


def this_week(signals, as_of: str, self_id: str = "cmp_self", k: int = 5):
    recent = signals.where((F.col("published_at") >= days_before(as_of, 7)) & ~F.array_contains("company_ids", self_id))
    return window_of(recent, [F.col("impact").cast("int").desc_nulls_last(), F.desc_nulls_last("published_at"), F.asc("id")], k)


def normalized_products(df):
    return df.withColumn("stage", text.stage(F.col("stage")))


def scored_at_least(pages, threshold: float = 0.5):
    return pages.where(F.col("score") >= threshold)


def extractable(fingerprints):
    """Fingerprints whose page has text to extract from."""
    return fingerprints.where("normalized_text_len > 0 and extracted_text is not null")


def fingerprints_with_page(fingerprints, pages):
    return fingerprints.join(pages.select(F.col("id").alias("page_id"), "canonical_url"), "page_id")


def known_ids(incoming, existing, key: str = "name"):
    """(id, old_id) of every incoming row: the least id of the existing rows of its key, null if there is none."""
    old = existing.groupBy(key).agg(F.min("id").alias("old_id"))
    return incoming.select(key, "id").join(old, key, "left").select("id", "old_id")
