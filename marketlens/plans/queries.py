"""The registered queries: each applies an operator to the reference tables; most have an oracle in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens import fixtures
from marketlens.fixtures import AS_OF, Tables
from marketlens.functions import text, urls
from marketlens.operators import catalog, checks, entities, graph, pages, patterns, responses, stats, upserts
from marketlens.sources import files
from marketlens.storage import Published, new_folder
from marketlens.streaming import changes, progress

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(Tables(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = fixtures.duckdb(sql)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- oracle fragments -------------------------------------------------------------------------------------------


def p(url: str, n: int) -> str:
    return f"regexp_extract({url}, '{urls.PARTS}', {n})"


def host(url: str) -> str:
    return f"regexp_replace(lower({p(url, 2)}), '^www\\.', '')"


def canonical(url: str) -> str:
    query = f"array_to_string(list_filter(string_split({p(url, 4)}, '&'), lambda x: contains(x, '=') AND NOT list_contains({sql_list(urls.TRACKING_KEYS)}, lower(split_part(x, '=', 1)))), '&')"
    path = f"regexp_replace({p(url, 3)}, '/+$', '')"
    return f"(lower({p(url, 1)}) || '://' || {host(url)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END)"


def domain(h: str) -> str:
    parts, n = f"string_split(lower({h}), '.')", f"len(string_split(lower({h}), '.'))"
    tail = lambda k: f"array_to_string({parts}[{n} - {k - 1}:{n}], '.')"
    return f"CASE WHEN {n} <= 1 THEN lower({h}) WHEN {n} >= 3 AND list_contains({sql_list(urls.TWO_PART_SUFFIXES)}, {tail(2)}) THEN {tail(3)} ELSE {tail(2)} END"


def first_hit(u: str, values, test: str = "contains({u}, x)") -> str:
    return f"list_filter({sql_list(values)}, lambda x: {test.format(u=u)})[1]"


def any_hit(u: str, values) -> str:
    return "(" + " OR ".join(f"contains({u}, '{v}')" for v in values) + ")"


def skip(url: str) -> str:
    u = f"lower({url})"
    fragment = f"split_part({u}, '#', 2)"
    return (
        f"coalesce('URL contains low-value pattern: ' || {first_hit(u, urls.LOW_VALUE)}, 'URL has skip extension: ' || {first_hit(u, urls.SKIP_SUFFIXES, 'ends_with({u}, x)')}, "
        f"'URL contains non-English language path: ' || {first_hit(u, urls.LANGUAGE_SEGMENTS)}, 'URL has skip query parameter: ' || {first_hit(u, urls.SKIP_QUERY)}, "
        f"CASE WHEN {any_hit(fragment, urls.FRAGMENTS)} THEN 'URL has skip fragment: ' || {fragment} END)"
    )


def prio(url: str, first=urls.SEED_FIRST) -> str:
    return f"CASE WHEN {any_hit(f'lower({url})', first)} THEN 0 WHEN {any_hit(f'lower({url})', urls.SEED_NEXT)} THEN 1 ELSE 2 END"


NORM = "regexp_replace(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\s+#./\\-]', '', 'g')"


def norm(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({NORM.format(x=f'coalesce({x}, $$$$)')}, '\\s+'), lambda w: w <> '')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.ACRONYMS.items())
    return f"array_to_string(list_transform({words}, lambda w: CASE w {cases} ELSE w END), ' ')"


def extract(x: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(trim({x}), '{pattern}', {group}), '')"


VERSION_OF = f"coalesce({extract('name', text.VERSION, 2)}, {extract('name', text.MAJOR, 2)})"
BASE_OF = f"coalesce({extract('name', text.VERSION, 1)}, {extract('name', text.MAJOR, 1)}, name)"

# --- A: sources and sinks ---------------------------------------------------------------------------------------

add("a2_first_summaries", lambda t: files.first_summaries(t.company_summaries).select("company_id", "one_liner", "footprint"),
    "SELECT company_id, one_liner, footprint FROM company_summaries QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY pos) = 1")
add("a3_load_counts", lambda t: files.load_counts({"companies": t.companies, "products": t.products, "signals": t.signals}),
    "SELECT 'companies' AS table_name, count(*) AS n FROM companies UNION ALL SELECT 'products', count(*) FROM products UNION ALL SELECT 'signals', count(*) FROM signals")
add("a6_latest_exports", lambda t: files.latest_exports(t.orders.select(F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("competitor"), F.when(F.col("o_orderkey") % 50 > 30, "2A").otherwise("2B").alias("stage"), F.concat(F.lit("f"), "o_orderkey").alias("file_name"))),
    """WITH f AS (SELECT 'c' || (o_custkey % 50) AS competitor, CASE WHEN o_orderkey % 50 > 30 THEN '2A' ELSE '2B' END AS stage, 'f' || o_orderkey AS file_name FROM orders),
    l AS (SELECT competitor, stage, max(file_name) AS file_name FROM f GROUP BY ALL) SELECT * FROM l WHERE competitor IN (SELECT competitor FROM l GROUP BY 1 HAVING count(*) = 2)""")  # fmt: skip
add("a7_export_crawl", lambda t: files.export_crawl(t.crawled, 2), "SELECT session_id, url, canonical_url, status_code, primary_category, score, depth, size_bytes, content_hash, crawled_at, id FROM crawled WHERE session_id = 2")
add("a8_export_fingerprints", lambda t: files.export_fingerprints(t.fingerprints, 1), "SELECT id, url, page_type, content_hash, normalized_text_len, left(extracted_text, 5000) AS extracted_text_preview FROM fingerprints WHERE fingerprint_session_id = 1")
add("a9_export_session", lambda t: files.export_session(t.crawl_sessions, 17), "SELECT * FROM crawl_sessions WHERE id = 17")
add("a10_latest_runs", lambda t: stats.latest_run(t.crawl_sessions, "competitor").select("competitor", "id", "started_at"),
    "SELECT competitor, id, started_at FROM crawl_sessions QUALIFY row_number() OVER (PARTITION BY competitor ORDER BY started_at DESC NULLS LAST, id DESC) = 1")
add("a11_stage_audit", lambda t: files.stage_audit(t.responses.select(F.when(F.col("n") % 2 == 0, "1").otherwise("2A").alias("stage"), F.lit("acme").alias("competitor"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("p"), "id").alias("prompt"), F.col("content").alias("response"))),
    "SELECT CASE WHEN n % 2 = 0 THEN '1' ELSE '2A' END AS stage, 'acme' AS competitor, 'u' || id AS url, length('p' || id) AS prompt_length, length(content) AS response_size FROM responses")
add("a12_purge_sessions", lambda t: files.purge_sessions(t.crawl_sessions, t.crawled, t.crawl_sessions.where("id < 3").select("id"))[2],
    "SELECT (SELECT count(*) FROM crawl_sessions WHERE id < 3) AS sessions_removed, (SELECT count(*) FROM crawled WHERE session_id < 3) AS pages_removed")

# --- B: lists, filters, lookups ---------------------------------------------------------------------------------

flat = lambda df, *arrays: df.withColumns({a: F.array_join(a, "|") for a in arrays})
COMPANY = "id, name, hq_country, website, status, is_self, array_to_string(aliases, '|') AS aliases, array_to_string(tags, '|') AS tags"
add("b1_list_companies", lambda t: flat(catalog.list_companies(t.companies, "s1", "active"), "aliases", "tags"),
    f"SELECT {COMPANY} FROM companies WHERE (name ILIKE '%s1%' OR list_bool_or(list_transform(aliases, lambda a: a ILIKE '%s1%')) OR list_bool_or(list_transform(tags, lambda a: a ILIKE '%s1%'))) AND status = 'active' ORDER BY is_self DESC NULLS LAST, name, id LIMIT 100")
add("b2_extracted_companies", lambda t: catalog.window_of(entities.seen_span(t.facts), [F.desc_nulls_last("first_seen"), F.asc("company_id")], 100),
    "SELECT company_id, min(seen_at) AS first_seen, max(seen_at) AS last_updated FROM facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
add("b3_list_products", lambda t: catalog.list_products(t.products, "ring", category="SMALL").select("id", "name", "category", "stage"),
    "SELECT id, name, category, stage FROM products WHERE (name ILIKE '%ring%' OR short_desc ILIKE '%ring%' OR list_bool_or(list_transform(tags, lambda a: a ILIKE '%ring%'))) AND category = 'SMALL' ORDER BY name, id LIMIT 100")
add("b4_list_capabilities", lambda t: catalog.list_capabilities(t.capabilities, "m"), "SELECT id, name, coalesce(definition, '') AS definition, tag FROM capabilities WHERE name ILIKE '%m%' OR coalesce(definition, '') ILIKE '%m%' OR tag ILIKE '%m%'")
add("b5_list_sources", lambda t: catalog.list_sources(t.sources, "author 1", "high"), "SELECT * FROM sources WHERE (origin ILIKE '%author 1%' OR coalesce(author, '') ILIKE '%author 1%') AND credibility = 'high'")
add("b6_list_signals", lambda t: catalog.list_signals(t.signals, as_of=AS_OF, type="view", company_id="cmp_3", days=20, search="view").select("id", "headline", "impact", "published_at"),
    f"SELECT id, headline, impact, published_at FROM signals WHERE type = 'view' AND list_contains(company_ids, 'cmp_3') AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AND (headline ILIKE '%view%' OR coalesce(summary, '') ILIKE '%view%') ORDER BY published_at DESC, id LIMIT 100")
add("b7_get_by_ids", lambda t: catalog.get_by_ids(t.products, t.signals.select(F.element_at("product_ids", 2))).select("id", "name"), "SELECT id, name FROM products WHERE id IN (SELECT product_ids[2] FROM signals)")
add("b8_company_products", lambda t: catalog.children(t.companies, t.products, "cmp_3", "company_id").select("id", "name", "company_id"), "SELECT id, name, company_id FROM products WHERE company_id = 'cmp_3'")
add("b9_company_signals", lambda t: catalog.company_signals(t.signals, "cmp_3", as_of=AS_OF).select("id", "published_at"),
    f"SELECT id, published_at FROM signals WHERE list_contains(company_ids, 'cmp_3') AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY ORDER BY published_at DESC, id LIMIT 50")
add("b10_facet_signals", lambda t: catalog.facet_signals(t.signals, types=("view", "click"), companies=("cmp_1", "cmp_2"), impact_range=(0, 2), since=catalog.since_preset("30d", AS_OF)).select("id", "type", "impact"),
    "SELECT id, type, impact FROM signals WHERE type IN ('view', 'click') AND list_has_any(company_ids, ['cmp_1', 'cmp_2']) AND CAST(impact AS INT) BETWEEN 0 AND 2 AND published_at >= TIMESTAMP '2024-01-02'")
add("b12_paginate", lambda t: catalog.paginate(t.signals.select("id", "published_at"), 3, [F.desc("published_at"), F.asc("id")]),
    "SELECT id, published_at, (SELECT CAST(ceil(count(*) / 25) AS BIGINT) FROM signals) AS total_pages FROM signals ORDER BY published_at DESC, id LIMIT 25 OFFSET 50")
add("b13_classify_urls", lambda t: catalog.split_urls(t.site_pages).select("page_id", "skip", "reason"), f"SELECT page_id, {skip('url')} IS NOT NULL AS skip, {skip('url')} AS reason FROM site_pages")
add("b14_split_urls", lambda t: catalog.split_urls(t.site_pages).groupBy("session_id").agg(F.count_if("skip").alias("skipped"), F.count_if(~F.col("skip")).alias("kept")),
    f"SELECT session_id, count(*) FILTER (r IS NOT NULL) AS skipped, count(*) FILTER (r IS NULL) AS kept FROM (SELECT session_id, {skip('url')} AS r FROM site_pages) q GROUP BY 1")
add("b15_score_threshold", lambda t: catalog.scored_at_least(t.crawled).select("id", "score"), "SELECT id, score FROM crawled WHERE score >= 0.5")
add("b16_extractable", lambda t: catalog.extractable(t.fingerprints).select("id", "normalized_text_len"), "SELECT id, normalized_text_len FROM fingerprints WHERE normalized_text_len > 0 AND extracted_text IS NOT NULL")
NOISE_HITS = f"list_filter({sql_list(urls.NOISE_SCORING)}, lambda x: contains(lower(url), x))"
add("b17_scoring_eligibility", lambda t: catalog.scoring_eligibility(pages.page_metadata(t.site_pages)).select("page_id", "eligible", "scoring_reason"),
    f"SELECT page_id, len({NOISE_HITS}) = 0 AS eligible, CASE WHEN len({NOISE_HITS}) > 0 THEN 'noise: ' || array_to_string({NOISE_HITS}, ', ') ELSE 'eligible' END AS scoring_reason FROM site_pages")
add("b18_list_sessions", lambda t: catalog.window_of(t.crawl_sessions.where("competitor = 'acme'").select("id", "started_at"), [F.desc_nulls_last("started_at"), F.asc("id")], 20, 5),
    "SELECT id, started_at FROM crawl_sessions WHERE competitor = 'acme' ORDER BY started_at DESC, id LIMIT 20 OFFSET 5")
add("b19_session_status", lambda t: catalog.session_status(t.crawl_sessions).select("id", "state"),
    "SELECT id, CASE WHEN completed_at IS NULL THEN 'running' WHEN total > 0 AND failed >= total THEN 'failed' WHEN total > 0 AND failed / total > 0.3 THEN 'degraded' ELSE 'completed' END AS state FROM crawl_sessions")
add("b20_existing_runs", lambda t: catalog.split_existing_runs(t.crawl_sessions.select("id", F.col("crawl_id"), "competitor", "schema_version"), t.crawl_sessions.where("completed_at is not null"), ["crawl_id", "competitor", "schema_version"]).select("id", "reused"),
    "SELECT id, EXISTS (SELECT 1 FROM crawl_sessions s WHERE s.completed_at IS NOT NULL AND s.crawl_id = r.crawl_id AND s.competitor = r.competitor AND s.schema_version = r.schema_version) AS reused FROM (SELECT * FROM crawl_sessions) r")
add("b23_website_columns", lambda t: catalog.website_columns(t.companies).select("id", "website_url", "website_host"),
    f"SELECT id, website_url, {host('website_url')} AS website_host FROM (SELECT id, CASE WHEN starts_with(website, 'http') THEN website ELSE 'https://' || website END AS website_url FROM companies) q")

# --- C: joins ---------------------------------------------------------------------------------------------------

add("c1_product_capabilities", lambda t: catalog.product_capabilities(t.product_capabilities, t.capabilities).select("id", "product_id", F.col("capability.name").alias("capability_name"), F.col("capability.definition").alias("definition")),
    "SELECT pc.id, product_id, c.name AS capability_name, coalesce(definition, '') AS definition FROM product_capabilities pc JOIN capabilities c ON c.id = capability_id")
add("c2_product_company", lambda t: catalog.product_company(t.products, t.companies).select("p.id", F.col("c.name").alias("company_name")), "SELECT p.id, c.name AS company_name FROM products p JOIN companies c ON p.company_id = c.id")
add("c3_signals_with_source", lambda t: catalog.signals_with_source(t.signals, t.sources).select("s.id", "o.origin", "o.credibility"), "SELECT s.id, o.origin, o.credibility FROM signals s LEFT JOIN sources o ON s.source_id = o.id")
add("c4_products_with_signals", lambda t: catalog.products_with_signals(t.products, catalog.facet_signals(t.signals, types=("error",))).select("id", "name"), "SELECT id, name FROM products WHERE id IN (SELECT unnest(product_ids) FROM signals WHERE type = 'error')")
add("c5_fingerprints_with_page", lambda t: catalog.fingerprints_with_page(t.fingerprints.select("page_id", "page_type"), t.crawled), "SELECT page_id, page_type, canonical_url FROM fingerprints JOIN (SELECT id AS pid, canonical_url FROM crawled) c ON page_id = pid")
CANDIDATES = "SELECT c_custkey AS cid, CASE WHEN c_custkey % 2 = 0 THEN 'supplier-' || lpad(CAST(c_custkey % 40 AS VARCHAR), 9, '0') || '.com' ELSE NULL END AS domain, 'Supplier ' || lpad(CAST(c_custkey % 60 AS VARCHAR), 9, '0') AS name FROM customer"
add("c6_match_companies", lambda t: catalog.match_existing_companies(t.customer.select(F.col("c_custkey").alias("cid"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("supplier-"), F.lpad((F.col("c_custkey") % 40).cast("string"), 9, "0"), F.lit(".com"))).alias("domain"), F.concat(F.lit("Supplier "), F.lpad((F.col("c_custkey") % 60).cast("string"), 9, "0")).alias("name")), t.companies.withColumn("pos", F.col("id"))),
    f"""WITH cand AS ({CANDIDATES}), known AS (SELECT id, {domain(host("CASE WHEN starts_with(website, 'http') THEN website ELSE 'https://' || website END"))} AS domain, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS bare FROM companies)
    SELECT cid, id AS company_id, how AS matched_by FROM (SELECT cid, k.id, CASE WHEN c.domain = k.domain THEN 'domain' ELSE 'name' END AS how FROM cand c JOIN known k ON c.domain = k.domain OR regexp_replace(lower(c.name), '[^a-z0-9]', '', 'g') = k.bare) q QUALIFY row_number() OVER (PARTITION BY cid ORDER BY id) = 1""")  # fmt: skip
SCORES = "SELECT DISTINCT canonical_url, CAST(length(canonical_url) % 7 AS DOUBLE) / 10 AS new_score, 'docs' AS new_category FROM crawled WHERE depth = 0"
add("c7_apply_scores", lambda t: catalog.apply_scores(t.crawled, t.crawled.where("depth = 0").select("canonical_url", ((F.length("canonical_url") % 7).cast("double") / 10).alias("new_score"), F.lit("docs").alias("new_category")).distinct()).select("id", "score", "primary_category", "updated"),
    f"""WITH s AS ({SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY crawled_at DESC, id DESC) AS rn FROM crawled)
    SELECT id, coalesce(new_score, score) AS score, coalesce(new_category, primary_category) AS primary_category, new_score IS NOT NULL AS updated FROM r LEFT JOIN s ON r.canonical_url = s.canonical_url AND rn = 1 AND new_score > 0""")  # fmt: skip
add("c8_probe_cache", lambda t: catalog.probe_cache(t.requests, t.cache, AS_OF).groupBy("hit").agg(F.count("*").alias("n")),
    f"SELECT hit, count(*) AS n FROM (SELECT cache_key IN (SELECT cache_key FROM cache WHERE expires_at > TIMESTAMP '{AS_OF}') AS hit FROM requests) q GROUP BY 1")
add("c9_update_cache", lambda t: catalog.update_cache(t.cache, t.requests.select(F.col("request_id").alias("n"), "cache_key", F.col("prompt").alias("response")), AS_OF),
    f"""SELECT n, cache_key, response, expires_at FROM (SELECT n, cache_key, response, expires_at, 1 AS age FROM cache UNION ALL SELECT request_id, cache_key, prompt, TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY, 0 FROM requests) q QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY age, n DESC) = 1""")
add("c10_upsert_match", lambda t: catalog.known_ids(t.new_products, t.old_products), "SELECT n.id, min(o.id) AS old_id FROM new_products n LEFT JOIN old_products o ON n.name = o.name GROUP BY 1")
add("c11_companies_matching", lambda t: catalog.companies_matching(t.companies, "S3").select("id", "name"), "SELECT id, name FROM companies WHERE contains(lower(name), 's3') OR list_bool_or(list_transform(aliases, lambda a: contains(lower(a), 's3')))")
add("c12_orphans", lambda t: catalog.orphans(t.signals, t.sources, "source_id").select("id", "source_id"), "SELECT id, source_id FROM signals WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM sources)")
add("c13_signal_links", lambda t: catalog.signal_links(t.signals, "product_ids", "product_id"), "SELECT DISTINCT id AS signal_id, unnest(product_ids) AS product_id FROM signals")

# --- D: aggregations --------------------------------------------------------------------------------------------

add("d1_category_breakdown", lambda t: stats.category_breakdown(t.crawled), "SELECT session_id, primary_category, count(*) AS n FROM crawled GROUP BY ALL")
add("d2_scoring_breakdown", lambda t: stats.scoring_breakdown(t.crawled), "SELECT session_id, scoring_method, count(*) AS n, count(*) FILTER (ai_success) AS ok, count(*) FILTER (NOT ai_success AND ai_score IS NOT NULL) AS failed FROM crawled GROUP BY ALL")
add("d3_score_averages", lambda t: stats.score_averages(t.crawled), "SELECT session_id, round(avg(ai_score) FILTER (ai_success), 9) AS avg_ai, round(avg(rules_score), 9) AS avg_rules FROM crawled GROUP BY 1")
add("d4_scoring_audit", lambda t: stats.scoring_audit(t.crawled), "SELECT reason, count(*) AS n, count(*) FILTER (contains(reason, 'attempted') AND ai_success) AS successful, count(*) FILTER (contains(reason, 'attempted') AND NOT ai_success) AS failed, count(*) FILTER (NOT contains(reason, 'attempted')) AS skipped FROM crawled GROUP BY 1")
add("d5_discovery_summary", lambda t: stats.discovery_summary(t.crawled), "SELECT count(*) FILTER (scoring_method = 'ai') AS ai_scored, count(*) FILTER (scoring_method = 'rules') AS rules_scored, round(avg(score), 3) AS mean_score, count(*) FILTER (score >= 0.5) AS valuable FROM crawled")
add("d6_company_stats", lambda t: stats.company_stats(t.companies, t.products, t.signals, t.product_capabilities, AS_OF),
    f"""SELECT id AS company_id, (SELECT count(*) FROM products p WHERE p.company_id = c.id) AS products, (SELECT count(*) FROM signals s WHERE list_contains(company_ids, c.id) AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY) AS signals,
    (SELECT count(DISTINCT capability_id) FROM product_capabilities pc JOIN products p ON p.id = pc.product_id WHERE p.company_id = c.id) AS capabilities FROM companies c""")  # fmt: skip
add("d7_session_stats", lambda t: stats.session_stats(t.facts), "SELECT market, count(*) AS processed, count(*) FILTER (confidence = 0) AS failed, count(*) FILTER (method = 'rules') AS cache_hits, count(DISTINCT name) AS entities, count(DISTINCT company_id) AS companies FROM facts GROUP BY 1")
add("d8_progress_metrics", lambda t: stats.progress_metrics(t.crawl_sessions.select("id", F.col("failed").alias("done"), "total", (F.col("id") % 40).alias("elapsed"))).select("id", "pages_per_minute", "eta_seconds"),
    "SELECT id, round(failed / greatest(id % 40, 1) * 60, 6) AS pages_per_minute, CASE WHEN total > failed THEN CAST(floor((total - failed) / greatest(failed / greatest(id % 40, 1) * 60 / 60, 0.1)) AS BIGINT) ELSE 0 END AS eta_seconds FROM crawl_sessions")
add("d9_confidence_rollup", lambda t: stats.confidence_rollup(t.facts), "SELECT url, max(confidence) AS best, round(avg(confidence), 9) AS overall, count(*) AS found, round(avg(confidence), 9) >= 0.6 AS success FROM facts GROUP BY 1")
UPSERT = """u AS (SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.category, o.category) AS category, coalesce(n.price, o.price) AS price,
    (CASE WHEN o.id IS NULL OR n.id IS NULL THEN 0 ELSE (coalesce(n.name, o.name) IS DISTINCT FROM o.name)::INT + (coalesce(n.category, o.category) IS DISTINCT FROM o.category)::INT + (coalesce(n.price, o.price) IS DISTINCT FROM o.price)::INT END) AS c, o.id AS oid, n.id AS nid FROM old_products o FULL JOIN new_products n ON o.id = n.id),
    m AS (SELECT *, CASE WHEN oid IS NULL THEN 'created' WHEN nid IS NULL THEN 'kept' WHEN c > 0 THEN 'updated' ELSE 'unchanged' END AS status FROM u)"""
add("d10_upsert_summary", lambda t: entities.upsert_summary(entities.upsert(t.old_products, t.new_products, "id", ["name", "category", "price"])),
    f"WITH {UPSERT} SELECT count(*) FILTER (status <> 'kept') AS processed, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'updated') AS updated, CAST(sum(c) AS BIGINT) AS changes FROM m")
add("d11_content_set_hash", lambda t: stats.content_set_hash(t.crawled), "SELECT session_id, sha256(string_agg(content_hash, '' ORDER BY content_hash)) AS set_hash FROM crawled GROUP BY 1")
add("d12_duplicate_map", lambda t: stats.duplicate_map(t.crawled), "SELECT session_id, id, kept_id FROM (SELECT session_id, id, min(id) OVER (PARTITION BY session_id, canonical_url) AS kept_id FROM crawled) q WHERE id <> kept_id")
HIGH = "h AS (SELECT * FROM crawled WHERE score >= 0.5), d AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY session_id, canonical_url ORDER BY id) = 1)"
CAPPED = "x AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY session_id, domain ORDER BY score DESC, id) <= {d}), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY session_id, primary_category ORDER BY score DESC, id) <= {c})"
add("d13_filter_funnel", lambda t: stats.filter_funnel(t.crawled, per_domain=3, per_category=10),
    f"WITH {HIGH}, {CAPPED.format(d=3, c=10)} SELECT session_id, count(*) AS rows_in, (SELECT count(*) FROM h WHERE h.session_id = p.session_id) AS scored, (SELECT count(*) FROM d WHERE d.session_id = p.session_id) AS unique_pages, (SELECT count(*) FROM y WHERE y.session_id = p.session_id) AS capped FROM crawled p GROUP BY 1")
PROFILED = ("website", "status", "hq_country", "name")
add("d14_column_profile", lambda t: stats.column_profile(t.companies, list(PROFILED)), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS valid, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS different FROM companies" for c in PROFILED))

# --- E: windows and top-k ---------------------------------------------------------------------------------------

add("e1_top_by_category", lambda t: stats.top_by_category(t.crawled).select("session_id", "primary_category", "url", "score", "rank"),
    "SELECT session_id, primary_category, url, score, CAST(row_number() OVER w AS INT) AS rank FROM crawled WHERE primary_category <> 'legal' WINDOW w AS (PARTITION BY session_id, primary_category ORDER BY score DESC, url, id) QUALIFY row_number() OVER w <= 10")
add("e2_top_pages", lambda t: stats.top_pages(t.crawled).select("id", "url", "score"), "SELECT id, url, score FROM crawled ORDER BY score DESC, id LIMIT 10")
add("e3_this_week", lambda t: catalog.this_week(t.signals, AS_OF, "cmp_1").select("id", "impact", "published_at"),
    f"SELECT id, impact, published_at FROM signals WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND NOT list_contains(company_ids, 'cmp_1') ORDER BY CAST(impact AS INT) DESC, published_at DESC, id LIMIT 5")
add("e4_recent_activity", lambda t: catalog.company_signals(t.signals, "cmp_2", as_of=AS_OF, limit=10).select("id", "headline"),
    f"SELECT id, headline FROM signals WHERE list_contains(company_ids, 'cmp_2') AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY ORDER BY published_at DESC, id LIMIT 10")
add("e5_latest_child_run", lambda t: stats.latest_run(t.crawl_sessions, "crawl_id").select("crawl_id", "id"), "SELECT crawl_id, max(id) AS id FROM crawl_sessions GROUP BY 1")
add("e6_cap_pages", lambda t: stats.cap_pages(t.crawled, 4, 12).select("session_id", "id"))
add("e6_cap_pages_one_binds", lambda t: stats.cap_pages(t.crawled, 5, 1_000_000_000).select("session_id", "id"), "SELECT session_id, id FROM crawled QUALIFY row_number() OVER (PARTITION BY session_id, domain ORDER BY score DESC, id) <= 5")
add("e7_prioritise_seeds", lambda t: stats.prioritise_seeds(t.site_pages.select("url").distinct(), 60), f"SELECT url, {prio('url')} AS priority FROM (SELECT DISTINCT url FROM site_pages) q WHERE {skip('url')} IS NULL ORDER BY 2, 1 LIMIT 42")
add("e8_prioritise_links", lambda t: stats.prioritise_links(t.site_pages.select(F.col("url").alias("to_url"))), f"SELECT url AS to_url, {prio('url', urls.LINK_FIRST)} AS priority FROM site_pages")

# --- F: pipelines and sets --------------------------------------------------------------------------------------

add("f1_select_pages", lambda t: stats.select_pages(t.crawled, per_domain=1_000_000_000, per_category=6).select("session_id", "id"), f"WITH {HIGH}, {CAPPED.format(d=1000000000, c=6)} SELECT session_id, id FROM y")
SEARCHED = "SELECT 'company' AS type, id, name AS title, hq_country AS subtitle, website AS description, 100 AS score FROM companies WHERE name ILIKE '%e 1%' OR list_bool_or(list_transform(aliases, lambda a: a ILIKE '%e 1%')) OR list_bool_or(list_transform(tags, lambda a: a ILIKE '%e 1%')) UNION ALL SELECT 'product', id, name, category, short_desc, 100 FROM products WHERE name ILIKE '%e 1%' OR short_desc ILIKE '%e 1%' OR list_bool_or(list_transform(tags, lambda a: a ILIKE '%e 1%')) UNION ALL SELECT 'signal', id, headline, type, summary, 100 FROM signals WHERE headline ILIKE '%e 1%' OR coalesce(summary, '') ILIKE '%e 1%'"
add("f2_global_search", lambda t: catalog.global_search(t.companies, t.products, t.signals, "e 1"), SEARCHED)
add("f3_union_ci", lambda t: t.companies.select("id", F.array_join(text.union_ci(F.array("aliases", "tags", F.transform("aliases", F.lower))), "|").alias("merged")), "SELECT id, array_to_string(list_concat(aliases, tags), '|') AS merged FROM companies")
add("f5_field_sets", lambda t: t.products.groupBy("company_id").agg(F.array_join(F.array_sort(F.array_except(F.collect_set("category"), F.collect_set(F.when(F.col("size") > 5, F.col("category"))))), "|").alias("only_small")),
    "SELECT company_id, coalesce(string_agg(category, '|' ORDER BY category), '') AS only_small FROM (SELECT company_id, CASE WHEN max(size) > 5 THEN NULL ELSE category END AS category FROM products GROUP BY company_id, category) q GROUP BY 1")
add("f6_import_entities", lambda t: entities.import_entities(t.old_products, t.new_products, ["name"], ["category", "price"]).select("name", "category", "price", "id"),
    """WITH f AS (SELECT * FROM new_products QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS rn FROM old_products)
    SELECT o.name, CASE WHEN rn = 1 AND f.id IS NOT NULL THEN f.category ELSE o.category END AS category, CASE WHEN rn = 1 AND f.id IS NOT NULL THEN f.price ELSE o.price END AS price, o.id FROM o LEFT JOIN f ON o.name = f.name
    UNION ALL SELECT name, category, price, id FROM f WHERE name NOT IN (SELECT name FROM old_products)""")  # fmt: skip

# --- G: page mining ---------------------------------------------------------------------------------------------


def tag(h: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(html, '(?is)<{h}\\b[^>]*>(.*?)</{h}\\s*>', 1), lambda x: trim(regexp_replace(x, '(?s)<[^>]*>', '', 'g'))), ' ')"


TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '(?s)<[^>]*>', '', 'g'))"
add("g1_page_metadata", lambda t: pages.page_metadata(t.site_pages).select("page_id", "title", "h1", "h2", "h3", F.col("content_length").cast("long").alias("content_length"), "has_minimal_content"),
    f"SELECT page_id, {TITLE} AS title, {tag('h1')} AS h1, {tag('h2')} AS h2, {tag('h3')} AS h3, length(trim(regexp_replace(html, '(?s)<[^>]*>', '', 'g'))) AS content_length, true AS has_minimal_content FROM site_pages")
FULL = f"""WITH raw AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)(?:<a\\b[^>]*?\\shref|data-href|data-url)\\s*=\\s*["'']([^"'']+)["'']', 1))) AS raw FROM site_pages),
    f AS (SELECT page_id, url, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN raw WHEN starts_with(raw, '//') THEN {p('url', 1)} || ':' || raw WHEN starts_with(raw, '/') THEN {p('url', 1)} || '://' || {p('url', 2)} || raw ELSE {p('url', 1)} || '://' || {p('url', 2)} || regexp_replace({p('url', 3)}, '[^/]*$', '') || raw END AS u FROM raw WHERE NOT regexp_matches(raw, '^(#|mailto:|tel:|javascript:)'))"""
LINK = f"lower({p('u', 1)}) || '://' || {host('u')} || CASE WHEN regexp_replace({p('u', 3)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({p('u', 3)}, '/+$', '') END || CASE WHEN {p('u', 4)} = '' THEN '' ELSE '?' || {p('u', 4)} END"
add("g2_extract_links", lambda t: pages.extract_links(t.site_pages),
    f"{FULL}, l AS (SELECT DISTINCT page_id, url, {LINK} AS link FROM f WHERE {domain(host('u'))} = {domain(host('url'))} AND lower({p('u', 1)}) IN ('http', 'https')) SELECT page_id, url, link, {prio('link', urls.LINK_FIRST)} AS priority FROM l")
add("g3_clean_text", lambda t: pages.clean_text(t.site_pages).select("page_id", "clean"))
add("g3_clean_text_parser", lambda t: pages.clean_text(t.site_pages, parser=True).select("page_id", "clean"))
add("g4_key_urls", lambda t: pages.key_urls(t.site_pages).select("page_id", "key_url"), f"SELECT page_id, {canonical('url')} AS key_url FROM site_pages")


def classified() -> str:
    order = ["product_url", "product_title", "product_h1", "docs_url", "docs_title", "pricing_url", "pricing_title", "releases_url", "releases_title", "news_url", "news_title"]
    rules = {n: (c, s, f"regexp_matches(lower(url), '{pat}')") for n, c, s, pat in pages.URL_RULES} | {n: (c, s, any_hit(f"lower({col})", words)) for n, c, s, col, words in pages.WORD_RULES}
    signals = "list_filter([" + ", ".join(f"CASE WHEN {rules[n][2]} THEN '{n}' END" for n in order) + "], lambda x: x IS NOT NULL)"
    best = "CASE " + " ".join(f"WHEN {rules[n][2]} THEN {{{'c'}}}".replace("{c}", f"'{rules[n][0]}'") for n in sorted(order, key=lambda n: -pages.PRIORITY[rules[n][0]])) + " ELSE 'other' END"
    base = "CASE " + " ".join(f"WHEN {rules[n][2]} THEN {rules[n][1]}" for n in sorted(order, key=lambda n: -pages.PRIORITY[rules[n][0]])) + " END"
    return f"""m AS (SELECT page_id, url, html, depth, status, session_id, {TITLE} AS title, {tag('h1')} AS h1 FROM site_pages), k AS (SELECT *, {signals} AS sig, {best} AS category, {base} AS base FROM m),
    c AS (SELECT page_id, url, html, depth, status, session_id, category, CASE WHEN base IS NULL THEN 0.1::DOUBLE ELSE least(1.0::DOUBLE, base::DOUBLE + len(sig) * 0.05::DOUBLE) END AS score, CASE WHEN base IS NULL THEN 'no_classification' ELSE array_to_string(sig, ',') END AS signals FROM k)"""


PENALISED = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN " + any_hit("lower(url)", urls.NOISE) + " THEN least(score * pow(0.9::DOUBLE, depth), 0.05::DOUBLE) ELSE score * pow(0.9::DOUBLE, depth) END))"
SCORED = f"s AS (SELECT page_id, url, session_id, CASE WHEN status <> 200 OR html = '' THEN 'other' WHEN contains(lower(url), 'pdf') THEN 'datasheet' ELSE category END AS category, round(CASE WHEN status <> 200 OR html = '' THEN 0 WHEN contains(lower(url), 'pdf') THEN 0.9 ELSE {PENALISED} END, 9)::DOUBLE AS score FROM c)"
add("g5_classify_pages", lambda t: pages.classify_pages(pages.page_metadata(t.site_pages)).select("page_id", "category", F.round("base_score", 9).alias("score"), F.array_join("signals", ",").alias("signals")),
    f"WITH {classified()} SELECT page_id, category, round(score, 9) AS score, signals FROM c")
add("g5b_score_pages", lambda t: pages.score_pages(t.site_pages).select("page_id", "category", F.round("score", 9).alias("score"), "content_hash"),
    f"WITH {classified()}, {SCORED} SELECT s.page_id, s.category, s.score, CASE WHEN status = 200 AND NOT contains(lower(c.url), 'pdf') THEN sha256(html) END AS content_hash FROM s JOIN c USING (page_id)")


def flagship(t: Tables) -> DataFrame:
    """Top 10 pages of each category of each run, after URL filtering, scoring and dedupe by canonical URL."""
    kept = catalog.split_urls(t.site_pages).where("not skip")
    scored = pages.score_pages(kept).withColumns({"canonical_url": urls.canonical_url(F.col("url")), "id": F.col("page_id")})
    ranked = stats.top_by(stats.dedupe_pages(scored), ["session_id", "category"], [F.desc(F.round("score", 9)), F.asc("url"), F.asc("page_id")], 10)
    return ranked.select("session_id", "category", "url", F.round("score", 9).alias("score"), "rank")


add("flagship_top_pages", flagship,
    f"WITH {classified()}, {SCORED}, d AS (SELECT * FROM s WHERE {skip('url')} IS NULL QUALIFY row_number() OVER (PARTITION BY session_id, {canonical('url')} ORDER BY page_id) = 1) SELECT session_id, category, url, score, CAST(row_number() OVER w AS INT) AS rank FROM d WINDOW w AS (PARTITION BY session_id, category ORDER BY score DESC, url, page_id) QUALIFY row_number() OVER w <= 10")
typed = lambda t: t.fingerprints.select("id", "url", "page_type", F.col("extracted_text").alias("text"))
add("g6_extract_entities", lambda t: pages.extract_entities(typed(t))["source"].groupBy("entity_type").agg(F.count("*").alias("n")))
ALL = lambda pat: f"list_transform(regexp_extract_all(text, '{pat}', 1), lambda x: x)"
PRICED = ", ".join(f"nullif(regexp_extract(text, '{pat}', 1), '') AS {n}" for n, pat, _ in (*pages.PRICE_PATTERNS, *pages.SPEC_PATTERNS))
FACT_TEXT = "SELECT o_orderkey AS id, 'Plan: ' || CASE WHEN o_orderkey % 3 = 0 THEN '$' || o_custkey || '.00 per month' ELSE 'free' END || '. ' || (o_orderkey % 64) || ' GB RAM, ' || (o_orderkey % 8) || ' core' AS text FROM orders"
fact_text = lambda t: t.orders.select(F.col("o_orderkey").alias("id"), F.expr("'Plan: ' || CASE WHEN o_orderkey % 3 = 0 THEN '$' || o_custkey || '.00 per month' ELSE 'free' END || '. ' || (o_orderkey % 64) || ' GB RAM, ' || (o_orderkey % 8) || ' core'").alias("text"))
add("g7_product_facts", lambda t: pages.product_facts(fact_text(t)).select("id", *[n for n, _, _ in (*pages.PRICE_PATTERNS, *pages.SPEC_PATTERNS)]), f"SELECT id, {PRICED} FROM ({FACT_TEXT}) q")
add("g7_product_names", lambda t: pages.product_facts(typed(t)).select("id", "name", "confidence"))
RELEASES = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Released version 2.' || (o_orderkey % 50) || ' for all' WHEN 1 THEN 'Launched on May ' || (1 + o_orderkey % 28) || ', 2024.' ELSE 'nothing' END AS text FROM orders"
add("g8_release_facts", lambda t: pages.release_facts(t.orders.select(F.col("o_orderkey").alias("id"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Released version 2.' || (o_orderkey % 50) || ' for all' WHEN 1 THEN 'Launched on May ' || (1 + o_orderkey % 28) || ', 2024.' ELSE 'nothing' END").alias("text"))).select("id", "version", "date", "release_name"),
    f"SELECT id, v AS version, d AS date, CASE WHEN v IS NOT NULL THEN 'Version ' || v WHEN d IS NOT NULL THEN 'Release Unknown' END AS release_name FROM (SELECT id, nullif(regexp_extract(text, '{pages.RELEASE_VERSION}', 1), '') AS v, nullif(regexp_extract(text, '{pages.RELEASE_DATE}', 1), '') AS d FROM ({RELEASES}) r) q")
HOST = "regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1)"
TITLED = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
add("g9_company_from_url", lambda t: pages.company_from_url(t.site_pages).select("page_id", "company_name", "alias", "website"), f"SELECT page_id, {TITLED(f"replace(split_part({HOST}, '.', 1), '-', ' ')")} AS company_name, {HOST} AS alias, 'https://' || {HOST} AS website FROM site_pages")
KIND = "CASE " + " ".join(f"WHEN {any_hit('lower(url)', words.split())} THEN '{n}'" for n, words in pages.DOC_TYPES) + " ELSE 'unknown' END"
add("g10_document_facts", lambda t: pages.document_facts(t.site_pages.select("page_id", "url", F.col("html").alias("text"))).select("page_id", "doc_title", "doc_type"),
    f"SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?m)^#\\s*(.+)$', 1)), ''), nullif(trim(regexp_extract(html, '(?i)<h1[^>]*>([^<]+)</h1>', 1)), '')) AS doc_title, {KIND} AS doc_type FROM site_pages")
LABEL = f"split_part(regexp_replace(lower({p('url', 2)}), '^www[23]?\\.', ''), '.', 1)"
add("g11_competitor_from_url", lambda t: t.site_pages.select("page_id", urls.label_from_url(F.col("url")).alias("label")), f"SELECT page_id, upper(({LABEL})[1:1]) || ({LABEL})[2:] AS label FROM site_pages")
CLUES = "list_filter([" + ", ".join(f"CASE WHEN {any_hit('lower(url)', w.split())} THEN '{n}' END" for n, w in urls.CLUES.items()) + "], lambda x: x IS NOT NULL)"
add("g12_url_context", lambda t: t.site_pages.select("page_id", F.array_join(urls.clues(F.col("url")), ",").alias("clues"), F.array_join(urls.path_segments(F.col("url")), "/").alias("path")),
    f"SELECT page_id, array_to_string({CLUES}, ',') AS clues, array_to_string(list_filter(string_split({p('url', 3)}, '/'), lambda s: s NOT IN ('', 'index', 'home')), '/') AS path FROM site_pages")

# --- P: fingerprints --------------------------------------------------------------------------------------------

FAMILY = "CASE WHEN contains(lower(trim(split_part(content_type, ';', 1))), 'pdf') THEN 'pdf' WHEN starts_with(lower(trim(split_part(content_type, ';', 1))), 'text/') THEN 'html' ELSE 'binary' END"
raws = lambda t: t.fingerprints.withColumn("raw", F.when(F.col("id") % 23 != 0, F.concat(F.lit("<p>"), F.coalesce("extracted_text", F.lit("x"))))).withColumn("extracted_text", F.when(F.col("id") % 10 == 1, F.lit("  Short   Text ")).otherwise(F.col("extracted_text")))
FLAT = "regexp_replace(lower(x), '\\s+', ' ', 'g')"
add("p1_fingerprint", lambda t: pages.fingerprint(raws(t)).select("id", "content_hash", F.col("normalized_text_len").cast("long").alias("text_len"), "low_text_pdf", "needs_render"),
    f"""WITH r AS (SELECT id, {FAMILY} AS kind, CASE WHEN id % 23 <> 0 THEN '<p>' || coalesce(extracted_text, 'x') END AS raw, trim(CASE WHEN id % 10 = 1 THEN '  Short   Text ' ELSE coalesce(extracted_text, '') END) AS x FROM fingerprints),
    e AS (SELECT *, kind IN ('html', 'pdf') AND length(x) >= CASE WHEN kind = 'pdf' THEN 100 ELSE 50 END AS ok FROM r)
    SELECT id, CASE WHEN raw IS NULL THEN 'empty' WHEN ok THEN sha256({FLAT}) ELSE sha256(raw) END AS content_hash, CASE WHEN raw IS NOT NULL AND ok THEN length({FLAT}) ELSE 0 END AS text_len, raw IS NOT NULL AND kind = 'pdf' AND NOT ok AS low_text_pdf, raw IS NULL OR (kind = 'html' AND NOT ok) AS needs_render FROM e""")  # fmt: skip
CLEAN = "extracted_text"
for pattern, new in pages.CLEANING:
    CLEAN = f"regexp_replace({CLEAN}, '{pattern}', '{new}', 'g')".replace("\n", "' || chr(10) || '")
add("p2_clean_extracted_text", lambda t: t.fingerprints.where("extracted_text is not null").select("id", F.sha2(pages.clean_extracted_text(F.col("extracted_text")), 256).alias("clean_hash")), f"SELECT id, sha256(trim({CLEAN})) AS clean_hash FROM fingerprints WHERE extracted_text IS NOT NULL")
add("p3_content_family", lambda t: t.fingerprints.select("id", pages.content_family(F.col("content_type")).alias("family"), pages.size_note(F.col("content_length")).alias("note")), f"SELECT id, {FAMILY} AS family, CASE WHEN content_length > 15000000 THEN 'over size limit' END AS note FROM fingerprints")
add("p4_duplicate_content", lambda t: pages.duplicate_content(t.fingerprints), "SELECT content_hash, count(*) AS n, min(id) AS first_id FROM fingerprints GROUP BY 1 HAVING count(*) > 1")
add("p5_split_unchanged", lambda t: pages.split_unchanged(t.fingerprints.where("fingerprint_session_id = 0"), t.fingerprints.where("fingerprint_session_id = 3")).select("id", "unchanged"),
    "SELECT id, EXISTS (SELECT 1 FROM fingerprints h WHERE h.fingerprint_session_id = 3 AND h.competitor = f.competitor AND h.url = f.url AND h.content_hash = f.content_hash) AS unchanged FROM (SELECT * FROM fingerprints) f WHERE fingerprint_session_id = 0")
add("p6_fingerprint_totals", lambda t: pages.fingerprint_totals(t.fingerprints), "SELECT fingerprint_session_id, count(*) AS processed, count(*) FILTER (content_hash = 'error') AS errors FROM fingerprints GROUP BY 1")

# --- H: cleaning and normalising --------------------------------------------------------------------------------

add("h1_canonical_url", lambda t: t.site_pages.select("page_id", urls.canonical_url(F.col("url")).alias("canonical")), f"SELECT page_id, {canonical('url')} AS canonical FROM site_pages")
add("h3_registrable_domain", lambda t: t.site_pages.select("page_id", urls.registrable_domain(F.concat(urls.bare_host(F.col("url")), F.when(F.col("page_id") % 2 == 0, ".co.uk").otherwise(""))).alias("domain")),
    f"SELECT page_id, {domain('h')} AS domain FROM (SELECT page_id, {host('url')} || CASE WHEN page_id % 2 = 0 THEN '.co.uk' ELSE '' END AS h FROM site_pages) q")
add("h4_resolve_link", lambda t: t.site_pages.select("page_id", urls.resolve_link(F.when(F.col("page_id") % 3 == 0, "/a/b").when(F.col("page_id") % 3 == 1, "c.html").otherwise("//x.org/d"), F.col("url")).alias("link")),
    f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN {p('url', 1)} || '://' || {p('url', 2)} || '/a/b' WHEN 1 THEN {p('url', 1)} || '://' || {p('url', 2)} || regexp_replace({p('url', 3)}, '[^/]*$', '') || 'c.html' ELSE {p('url', 1)} || '://x.org/d' END AS link FROM site_pages")
TYPED = "SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'acme.com/x' WHEN 2 THEN 'ftp://acme.com' WHEN 3 THEN 'http://10.0.0.' || page_id WHEN 4 THEN 'a b.com' WHEN 5 THEN 'https://shop.acme.co.uk:8443/p?q=1' WHEN 6 THEN 'nodots' ELSE 'sub.test.com' END AS typed FROM site_pages"
REASON = f"""CASE WHEN length(typed) > 2000 THEN 'URL is too long (max 2000 characters)' WHEN contains(typed, ' ') THEN 'URL cannot contain spaces' WHEN h = '' THEN 'Invalid URL format' WHEN s NOT IN ('http', 'https') THEN 'Only HTTP and HTTPS URLs are supported' WHEN regexp_matches(h, '{urls.PRIVATE}') THEN 'Private IP addresses and localhost are not allowed'
    WHEN len(list_filter({sql_list(urls.PLACEHOLDERS)}, lambda x: h = x OR ends_with(h, '.' || x))) > 0 THEN 'Placeholder domains are not allowed' WHEN NOT contains(h, '.') THEN 'Invalid domain name' END"""
add("h5_validate_url", lambda t: t.site_pages.select("page_id", urls.validated(F.expr("CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'acme.com/x' WHEN 2 THEN 'ftp://acme.com' WHEN 3 THEN 'http://10.0.0.' || page_id WHEN 4 THEN 'a b.com' WHEN 5 THEN 'https://shop.acme.co.uk:8443/p?q=1' WHEN 6 THEN 'nodots' ELSE 'sub.test.com' END")).alias("v")).select("page_id", "v.ok", "v.reason", "v.domain"),
    f"""WITH u AS (SELECT page_id, typed, CASE WHEN contains(typed, '://') THEN typed ELSE 'https://' || typed END AS url FROM ({TYPED}) q), h AS (SELECT page_id, typed, lower({p('url', 1)}) AS s, regexp_replace(lower({p('url', 2)}), ':[0-9]*$', '') AS h FROM u), r AS (SELECT page_id, h, {REASON} AS reason FROM h)
    SELECT page_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN {domain('h')} END AS domain FROM r""")  # fmt: skip
add("h6_normalize_text", lambda t: t.entity_names.select("id", text.normalize_text(F.col("name")).alias("normalized")), f"SELECT id, {norm('name')} AS normalized FROM entity_names")
add("h7_extract_version", lambda t: t.entity_names.select("id", text.without_version(F.col("name")).alias("base"), text.version_of(F.col("name")).alias("version")), f"SELECT id, {BASE_OF} AS base, {VERSION_OF} AS version FROM entity_names")
add("h8_product_tier", lambda t: t.entity_names.select("id", text.tier_of(F.col("name")).alias("tier")), f"SELECT id, lower({extract('name', text.TIER, 2)}) AS tier FROM entity_names")
add("h9_flatten_specs", lambda t: responses.flatten_specs(t.products.select("id", F.try_parse_json(F.concat(F.lit('{"size": {"type": "number", "value": '), "size", F.lit(', "unit": "kg"}, "range": {"type": "range", "min": 1, "max": '), "size", F.lit("}}"))).alias("specs"))),
    """SELECT id, 'size' AS path, 'number' AS type, CAST(size AS VARCHAR) AS value_text, CAST(size AS DOUBLE) AS value_num, CAST(NULL AS DOUBLE) AS value_min, CAST(NULL AS DOUBLE) AS value_max, 'kg' AS unit FROM products UNION ALL SELECT id, 'range', 'range', NULL, NULL, 1, size, NULL FROM products""")  # fmt: skip
HAS = lambda words: any_hit("lower(coalesce(stage, ''))", words)
add("h10_normalize_stage", lambda t: t.products.select("id", text.stage(F.col("stage")).alias("stage_lenient"), text.strict_stage(F.col("stage")).alias("stage_strict")),
    f"SELECT id, CASE WHEN {HAS(['alpha'])} THEN 'alpha' WHEN {HAS(['beta'])} THEN 'beta' WHEN {HAS(['ga', 'general availability', 'released'])} THEN 'ga' WHEN {HAS(['discontinued', 'eol', 'end of life'])} THEN 'discontinued' WHEN {HAS(['deprecated'])} THEN 'deprecated' WHEN {HAS(['pre-order', 'preorder'])} THEN 'beta' ELSE 'alpha' END AS stage_lenient, CASE WHEN lower(stage) IN ('alpha', 'beta', 'ga', 'discontinued') THEN lower(stage) ELSE 'ga' END AS stage_strict FROM products")
RIPE = lambda words: any_hit("lower(coalesce(maturity, ''))", words)
add("h11_normalize_maturity", lambda t: t.product_capabilities.select("id", text.maturity(F.col("maturity")).alias("level")),
    f"SELECT id, CASE WHEN {RIPE(['basic'])} THEN 'basic' WHEN {RIPE(['intermediate'])} THEN 'intermediate' WHEN {RIPE(['advanced'])} THEN 'advanced' WHEN {RIPE(['expert'])} THEN 'expert' WHEN {RIPE(['ga', 'general availability', 'released'])} THEN 'ga' ELSE 'basic' END AS level FROM product_capabilities")
add("h12_specs_as_text", lambda t: t.products.select("id", F.explode(text.specs_as_text(F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("stage"), F.col("stage")))).alias("label", "spec")).select("id", "label", "spec.type", "spec.value"),
    "SELECT id, 'size' AS label, 'text' AS type, CAST(size AS VARCHAR) AS value FROM products UNION ALL SELECT id, 'stage', 'text', stage FROM products WHERE stage IS NOT NULL")
TOKENS = "CAST(floor(length(coalesce(text, '')) / 4 * CASE WHEN regexp_matches(coalesce(text, ''), '[{\\[]') THEN 1.2::DOUBLE ELSE 1.0 END) AS INT)"
add("h13_token_estimate", lambda t: t.documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens")), f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
HEAD = "left(text, 180)"
END = f"length({HEAD}) - instr(reverse({HEAD}), '.') + 1"
add("h14_truncate_tokens", lambda t: t.documents.select("doc_id", text.truncate_tokens(F.col("text"), 50).alias("cut")), f"SELECT doc_id, CASE WHEN {TOKENS} <= 50 THEN text WHEN contains({HEAD}, '.') AND {END} - 1 > 180 * 0.8 THEN left(text, {END}) ELSE {HEAD} || '...' END AS cut FROM documents")
add("h15_token_budget", lambda t: pages.token_budget(t.documents, 20_000, 5_000), f"SELECT doc_id, {TOKENS} AS tokens, length(text) > 20000 AS too_long, length(text) > 5000 AS warned FROM documents")
add("h19_stable_ids", lambda t: t.products.select("id", text.stable_id("prod_", F.col("name"), F.col("company_id")).alias("stable")), "SELECT id, 'prod_' || left(sha256(name || ':' || company_id), 12) AS stable FROM products")
add("h21_score_rescale", lambda t: t.orders.select("o_orderkey", text.rescaled_score(F.col("o_totalprice") / 1000 - 20).alias("score")), "SELECT o_orderkey, CASE WHEN x > 1 AND x / 100 <= 1 THEN x / 100 WHEN x BETWEEN 0 AND 1 THEN x END AS score FROM (SELECT o_orderkey, o_totalprice / 1000 - 20 AS x FROM orders) q")
add("h_reason_summary", lambda t: text.outcome_summary(t.site_pages, F.coalesce(F.split_part(urls.skip_reason(F.col("url")), F.lit(":"), F.lit(1)), F.lit("kept")), ["session_id"]), f"SELECT session_id, coalesce(split_part({skip('url')}, ':', 1), 'kept') AS outcome, count(*) AS n FROM site_pages GROUP BY ALL")

# --- I: history -------------------------------------------------------------------------------------------------

FIELDS = ["name", "status", "version", "pricing"]
states = lambda t: t.versions.withColumn("data", entities.payload(FIELDS))
STATE = "coalesce('name=' || length(name) || ':' || name, '') || coalesce(chr(10) || 'pricing=' || length(pricing) || ':' || pricing, '') || coalesce(chr(10) || 'status=' || length(status) || ':' || status, '') || coalesce(chr(10) || 'version=' || length(version) || ':' || version, '')"
add("i1_take_snapshots", lambda t: entities.take_snapshots(states(t)).select("entity_id", "n", "data_hash"), f"SELECT entity_id, n, sha256({STATE}) AS data_hash FROM versions QUALIFY row_number() OVER (PARTITION BY entity_id, sha256({STATE}) ORDER BY created_at, n) = 1")
add("i2_latest_snapshots", lambda t: entities.latest_snapshots(t.versions).select("entity_id", "n", "status"), "SELECT entity_id, n, status FROM versions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, n DESC) = 1")
LAGGED = "WITH l AS (SELECT *, " + ", ".join(f"lag({f}) OVER w AS p_{f}" for f in [*FIELDS, "n"]) + " FROM versions WINDOW w AS (PARTITION BY entity_id ORDER BY created_at, n))"
CHANGED = " UNION ALL ".join(f"SELECT entity_id, n, '{f}' AS field, p_{f} AS old_value, {f} AS new_value, CASE WHEN p_{f} IS NULL THEN 'added' WHEN {f} IS NULL THEN 'removed' ELSE 'modified' END AS type FROM l WHERE p_n IS NOT NULL AND p_{f} IS DISTINCT FROM {f}" for f in FIELDS)
add("i3_field_changes", lambda t: entities.history_changes(states(t)).select("entity_id", "n", F.inline("changes")).withColumnsRenamed({"old": "old_value", "new": "new_value"}), f"{LAGGED} {CHANGED}")
PARTS_OF = "list_filter([CASE WHEN p_version IS DISTINCT FROM version THEN 'version ' || coalesce(p_version, 'None') || ' → ' || coalesce(version, 'None') END, CASE WHEN p_status IS DISTINCT FROM status THEN 'status ' || coalesce(p_status, 'None') || ' → ' || coalesce(status, 'None') END, CASE WHEN p_pricing IS DISTINCT FROM pricing THEN 'pricing updated' END], lambda x: x IS NOT NULL)"
add("i4_change_summary", lambda t: entities.history_changes(states(t)).select("entity_id", "n", "summary"), f"{LAGGED} SELECT entity_id, n, left(name || ': ' || array_to_string({PARTS_OF}, ', '), 200) AS summary FROM l WHERE p_n IS NOT NULL AND len({PARTS_OF}) > 0")
add("i5_change_hash", lambda t: entities.history_changes(states(t)).select("entity_id", "n", "change_hash"), f"{LAGGED} SELECT entity_id, n, sha256('Order:' || entity_id || ':' || p_n || ':' || n) AS change_hash FROM l WHERE p_n IS NOT NULL AND len({PARTS_OF}) > 0")
add("i6_change_feed", lambda t: entities.change_feed(entities.history_changes(states(t))).select("entity_id", "n", "created_at"), f"{LAGGED} SELECT entity_id, n, created_at FROM l WHERE p_n IS NOT NULL AND len({PARTS_OF}) > 0 ORDER BY created_at DESC, n DESC LIMIT 50")
add("i7_provenance", lambda t: entities.provenance(t.facts.select("id", F.lit("Company").alias("entity_type"), F.col("company_id").alias("entity_id"), "url", F.col("market").alias("content_hash"), "method", "confidence")).select("id", "entity_id", "url", "method"),
    "SELECT id, company_id AS entity_id, url, method FROM facts QUALIFY row_number() OVER (PARTITION BY company_id, url, market ORDER BY id) = 1")


def sourced(t: Tables) -> DataFrame:
    """Source records of products: responses give a tag and cost the length of their bullet, and every third comes from the cache."""
    ai = F.col("method") == "ai"
    facts = t.facts.withColumns({"tag": F.when(ai, F.col("tag")), "tokens_input": F.when(ai, F.length("bullet")), "cache_hit": ai & (F.col("id") % 3 == 0)})
    return entities.source_records(facts.select("id", F.lit("Product").alias("entity_type"), F.col("name").alias("entity_id"), "url", F.nullif("market", F.lit("P")).alias("content_hash"), "page_type", "method", "confidence", "tokens_input", "cache_hit", entities.payload(["stage", "tag", "bullet"]).alias("data")))


SOURCED = "(SELECT id, name AS entity_id, url, CASE WHEN market = 'P' THEN '' ELSE market END AS content_hash, method, confidence, CASE WHEN method = 'ai' THEN 'bullet,stage,tag' ELSE 'bullet,stage' END AS fields_extracted, CASE WHEN method = 'ai' THEN length(bullet) END AS tokens_input, method = 'ai' AND id % 3 = 0 AS cache_hit FROM facts QUALIFY row_number() OVER (PARTITION BY name, url, market ORDER BY id) = 1)"
add("i7_source_records", lambda t: sourced(t).select("id", "entity_id", "url", "content_hash", "method", "confidence", F.array_join("fields_extracted", ",").alias("fields_extracted"), "tokens_input", "cache_hit"), f"SELECT * FROM {SOURCED} q")
add("i7_source_costs", lambda t: entities.source_costs(sourced(t)),
    f"SELECT method, count(*) AS records, count(*) FILTER (WHERE cache_hit) AS cache_hits, coalesce(sum(tokens_input), 0)::BIGINT AS tokens_input, 0::BIGINT AS tokens_output, 0::BIGINT AS processing_time_ms, sum(len(string_split(fields_extracted, ',')))::BIGINT AS fields FROM {SOURCED} q GROUP BY method")
add("i8_seen_span", lambda t: entities.seen_span(t.facts, ("company_id", "name")), "SELECT company_id, name, min(seen_at) AS first_seen, max(seen_at) AS last_updated FROM facts GROUP BY ALL")
add("i9_state_as_of", lambda t: entities.latest_snapshots(t.versions, "1998-01-01 00:00:00").select("entity_id", "n", "status"), "SELECT entity_id, n, status FROM versions WHERE created_at <= TIMESTAMP '1998-01-01 00:00:00' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, n DESC) = 1")

# --- J: entity resolution ---------------------------------------------------------------------------------------

BASE = f"({BASE_OF})"
TIERLESS = f"coalesce({extract(BASE, text.TIER, 1)}, {BASE})"
add("j1_natural_keys", lambda t: t.entity_names.select("id", entities.natural_key("product", F.lit("acme"), name=F.col("name"), company_id=F.when(F.col("id") % 7 == 0, "unknown").otherwise(F.col("company"))).alias("key")),
    f"SELECT id, concat_ws(':', 'acme', 'product', {norm(TIERLESS)}, CASE WHEN id % 7 <> 0 THEN company END, 'v' || {VERSION_OF}, 'tier_' || lower({extract(BASE, text.TIER, 2)})) AS key FROM entity_names")
add("j1_other_keys", lambda t: t.entity_names.select("id", entities.natural_key("capability", F.lit("acme"), name=F.col("name"), category=F.col("category")).alias("capability_key"), entities.natural_key("release", F.lit("acme"), name=F.col("name"), version=F.col("size").cast("string"), date=F.lit("2024-05-01T10:00")).alias("release_key")),
    f"SELECT id, concat_ws(':', 'acme', 'capability', {norm('name')}, category) AS capability_key, concat_ws(':', 'acme', 'release', {norm('name')}, 'v' || size, '2024-05-01') AS release_key FROM entity_names")
RANK = "CASE lower(page_type) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in entities.PAGE_RANKS.items()) + " ELSE 1 END"
RANKED = f"round(greatest(({RANK} + CASE WHEN method = 'rules' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN contains(lower(url), '/pricing') THEN 0.15::DOUBLE ELSE 0 END - least(greatest(len(string_split(url, '/')) - 3, 0) * 0.1::DOUBLE, 0.5::DOUBLE)) * confidence, 0.1::DOUBLE), 9)"
add("j2_rank_sources", lambda t: t.facts.select("id", F.round(entities.source_rank(F.col("url"), F.col("page_type"), F.col("method"), F.col("confidence")), 9).alias("rank")), f"SELECT id, {RANKED} AS rank FROM facts")
values = lambda t: t.facts.select(F.col("company_id").alias("entity"), F.when(F.col("id") % 3 == 0, "description").when(F.col("id") % 3 == 1, "tags").otherwise("stage").alias("field"), F.col("tag").alias("value"), (F.col("confidence") / 2).alias("rank"), F.col("id").alias("pos"))
add("j3_resolve_fields", lambda t: entities.resolve_fields(values(t)).select("entity", "field", "resolved", F.round("confidence", 9).alias("confidence")),
    """WITH v AS (SELECT company_id AS entity, CASE id % 3 WHEN 0 THEN 'description' WHEN 1 THEN 'tags' ELSE 'stage' END AS field, tag AS value, confidence / 2 AS rank, id AS pos FROM facts),
    r AS (SELECT *, row_number() OVER w AS rn, lead(rank) OVER w AS nx FROM v WINDOW w AS (PARTITION BY entity, field ORDER BY rank DESC, pos)), k AS (SELECT *, row_number() OVER (PARTITION BY entity, field, lower(value) ORDER BY rn) = 1 AS first FROM r WHERE field = 'tags')
    SELECT entity, field, value AS resolved, round(CASE WHEN field = 'description' AND rank - nx < 0.2 THEN rank * 0.8 ELSE rank END, 9) AS confidence FROM r WHERE field <> 'tags' AND rn = 1
    UNION ALL SELECT entity, field, string_agg(value, ', ' ORDER BY rn) FILTER (first), round(least(sum(rank) FILTER (first) / count(*), 1.0), 9) FROM k GROUP BY 1, 2""")  # fmt: skip
add("j4_upsert", lambda t: entities.upsert(t.old_products, t.new_products, "id", ["name", "category", "price"]).select("id", "name", "category", "price", "status"), f"WITH {UPSERT} SELECT id, name, category, price, status FROM m")
add("j5_upsert_all", lambda t: entities.upsert_all({
        "product": (t.old_products.withColumn("company", F.concat(F.lit("cmp_"), F.col("id") % 10)), t.new_products.withColumn("company", F.concat(F.lit("Supplier "), F.lpad((F.col("id") % 12).cast("string"), 9, "0"))), "name", ["category", "company"]),
        "company": (t.companies, t.companies.where("is_self"), "name", ["website"])}, {"product": {"company": "company"}})["product"].select("name", "category", "company", "status"),
    """WITH m AS (SELECT name AS known, min(id) AS company FROM companies GROUP BY 1), f AS (SELECT *, 'Supplier ' || lpad(CAST(id % 12 AS VARCHAR), 9, '0') AS known FROM new_products QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1),
    n AS (SELECT f.name, f.category, m.company FROM f LEFT JOIN m ON f.known = m.known), o AS (SELECT name, category, 'cmp_' || (id % 10) AS company FROM old_products)
    SELECT coalesce(n.name, o.name) AS name, coalesce(n.category, o.category) AS category, coalesce(n.company, o.company) AS company,
    CASE WHEN o.name IS NULL THEN 'created' WHEN n.name IS NULL THEN 'kept' WHEN coalesce(n.category, o.category) IS DISTINCT FROM o.category OR coalesce(n.company, o.company) IS DISTINCT FROM o.company THEN 'updated' ELSE 'unchanged' END AS status FROM o FULL JOIN n ON o.name = n.name""")  # fmt: skip
add("j6_import_entities", lambda t: entities.import_entities(t.old_products, t.new_products, ["name", "category"]).select("name", "category", "id"),
    "SELECT name, category, id FROM old_products UNION ALL SELECT name, category, id FROM (SELECT * FROM new_products QUALIFY row_number() OVER (PARTITION BY name, category ORDER BY id) = 1) f WHERE NOT EXISTS (SELECT 1 FROM old_products o WHERE o.name = f.name AND o.category = f.category)")
STAGED = "CASE stage WHEN 'discontinued' THEN 0 WHEN 'alpha' THEN 1 WHEN 'beta' THEN 2 ELSE 3 END"
add("j7_consolidate_products", lambda t: entities.consolidate_products(t.facts),
    f"""SELECT company_id, name, string_agg(DISTINCT market, ',' ORDER BY market) AS markets, array_to_string(list_sort(list_distinct(list(lower(tag))))[1:5], ',') AS tags, CASE min({STAGED}) WHEN 0 THEN 'discontinued' WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' ELSE 'ga' END AS stage, count(DISTINCT url) AS sources,
    string_agg(DISTINCT replace(bullet, ': ', '='), ',' ORDER BY replace(bullet, ': ', '=')) AS specs FROM facts GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY name) <= 20""")  # fmt: skip
add("j8_consolidate_company", lambda t: entities.consolidate_company(t.facts),
    "SELECT company_id, min({'l': length(url), 'u': url}).u AS website, array_to_string(list_sort(list_distinct(list(tag)))[1:3], ',') AS tags, array_to_string(list_sort(list_distinct(list(url)))[1:6], ',') AS sources FROM facts GROUP BY 1")
parsed = lambda t: responses.parse_responses(t.responses)
add("j9_split_products", lambda t: responses.split_products(parsed(t)).select("id", F.col("product").cast("long").alias("product")), "SELECT id, n AS product FROM responses WHERE n % 6 <> 4")

# --- L: responses -----------------------------------------------------------------------------------------------

add("l1_parse_responses", lambda t: parsed(t).select("id", F.coalesce("step", F.lit("quarantine")).alias("step")), "SELECT id, CASE n % 6 WHEN 0 THEN 'strict' WHEN 1 THEN 'fenced' WHEN 2 THEN 'braces' WHEN 3 THEN 'trailing_commas' WHEN 4 THEN 'quarantine' ELSE 'strict' END AS step FROM responses")
add("l2_unwrap", lambda t: t.orders.select("o_orderkey", responses.unwrap(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"choices": [{"message": {"content": "'), "o_orderpriority", F.lit('"}}]}'))).otherwise(F.concat(F.lit('{"text": "'), "o_orderstatus", F.lit('"}')))).alias("content")), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS content FROM orders")
SCORE = "CASE n % 3 WHEN 0 THEN CAST('0.' || (10 + n % 90) AS DOUBLE) WHEN 1 THEN CASE WHEN n % 100 > 1 THEN (n % 100) / 100 ELSE n % 100 END ELSE NULL END"
VALID = "n % 6 <> 4 AND n % 3 <> 2"
add("l3_validate_scores", lambda t: responses.validate_scores(parsed(t)).select("id", "valid", "category", F.round("score", 9).alias("score"), F.round("confidence", 9).alias("confidence")),
    f"SELECT id, {VALID} AS valid, CASE WHEN {VALID} THEN CASE n % 5 WHEN 0 THEN 'product' WHEN 1 THEN 'docs' WHEN 2 THEN 'other' ELSE 'news' END ELSE 'other' END AS category, round(CASE WHEN {VALID} THEN {SCORE} ELSE 0.1 END, 9) AS score, round(CASE WHEN {VALID} THEN (n % 10) / 10 ELSE 0 END, 9) AS confidence FROM responses")
add("l4_blend_scores", lambda t: responses.blend_scores(t.crawled.select("id", "url", "depth", "rules_score"), responses.validate_scores(parsed(t))).select("id", F.round("final_score", 9).alias("final_score"), "method"),
    f"SELECT c.id, CASE WHEN ok THEN round(least(1.0::DOUBLE, sc * pow(0.9::DOUBLE, depth)), 9) ELSE round(rules_score, 9) END AS final_score, CASE WHEN ok THEN 'ai' ELSE 'rules' END AS method FROM crawled c JOIN (SELECT id, {VALID} AND n % 10 >= 1 AS ok, CAST({SCORE} AS DOUBLE) AS sc FROM responses) r ON c.id = r.id")
ERR = lambda words: any_hit("lower(error)", words)
add("l5_failure_triage", lambda t: responses.failure_triage(t.failures), f"SELECT model, NOT {ERR(responses.FINAL_ERRORS)} AND {ERR((*responses.PASSING_ERRORS, *responses.PARSE_ERRORS))} AS retry, count(*) AS n FROM failures GROUP BY ALL")
add("l6_cache_keys", lambda t: t.requests.select("request_id", responses.cache_key(F.lit("m1"), F.lit("v1"), F.col("page_type"), F.lit("acme"), F.col("prompt")).alias("key")), "SELECT request_id, sha256('m1:v1:' || page_type || ':acme:' || prompt) AS key FROM requests")
add("l7_stage1_split", lambda t: responses.stage1_split(parsed(t)).groupBy("is_valid").agg(F.count("*").alias("n")), "SELECT n % 6 <> 4 AS is_valid, count(*) AS n FROM responses GROUP BY 1")
add("l8_coerce_object", lambda t: parsed(t).select("id", F.try_variant_get(responses.coerce_object(F.col("parsed")), "$.reasoning", "string").alias("reasoning")), "SELECT id, CASE WHEN n % 6 <> 4 THEN 'ok' END AS reasoning FROM responses")

# --- K: constraints ---------------------------------------------------------------------------------------------

add("k1_check_products", lambda t: checks.check(t.products.withColumn("markets", F.array(F.lit("EU"), F.when(F.col("size") % 2 == 0, "US"))), "product"),
    """SELECT 'product' AS entity, id, 'stage' AS path, 'not in enum' AS message FROM products WHERE stage NOT IN ('alpha', 'beta', 'ga', 'discontinued', 'deprecated') UNION ALL SELECT 'product', id, 'stage', 'required' FROM products WHERE stage IS NULL
    UNION ALL SELECT 'product', id, 'markets[1]', 'expected string' FROM products WHERE size % 2 <> 0""")  # fmt: skip
add("k1_check_companies", lambda t: checks.check(t.companies, "company"),
    "SELECT 'company' AS entity, id, 'website' AS path, 'not a URL' AS message FROM companies WHERE website NOT LIKE 'https://%' UNION ALL SELECT 'company', id, 'status', 'not in enum' FROM companies WHERE status NOT IN ('active', 'dormant')")
add("k1_check_signals", lambda t: checks.check(t.signals.withColumns({"published_at": F.when(F.col("n") % 3 == 0, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("n") % 3 == 1, F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")), "url": F.when(F.col("n") % 2 == 0, "https://x.com/a").otherwise("x.com/a")}), "signal"),
    """SELECT 'signal' AS entity, id, 'type' AS path, 'not in enum' AS message FROM signals WHERE type NOT IN ('news', 'job', 'paper', 'funding', 'release', 'social') UNION ALL SELECT 'signal', id, 'published_at', 'not a date-time' FROM signals WHERE n % 3 = 1
    UNION ALL SELECT 'signal', id, 'published_at', 'required' FROM signals WHERE n % 3 = 2 UNION ALL SELECT 'signal', id, 'url', 'not a URL' FROM signals WHERE n % 2 = 1""")  # fmt: skip
add("k1_check_links", lambda t: checks.check(t.product_capabilities.withColumn("method", F.when(F.length("id") % 2 == 0, "guessed")), "product_capability"),
    """SELECT 'product_capability' AS entity, id, 'maturity' AS path, 'not in enum' AS message FROM product_capabilities WHERE maturity NOT IN ('basic', 'intermediate', 'advanced', 'expert', 'ga') UNION ALL SELECT 'product_capability', id, 'maturity', 'required' FROM product_capabilities WHERE maturity IS NULL
    UNION ALL SELECT 'product_capability', id, 'method', 'not in enum' FROM product_capabilities WHERE length(id) % 2 = 0""")  # fmt: skip
add("k1_check_sources", lambda t: checks.check(t.sources.withColumn("credibility", F.when(F.col("credibility") == "low", "poor").otherwise(F.col("credibility"))), "source"), "SELECT 'source' AS entity, id, 'credibility' AS path, 'not in enum' AS message FROM sources WHERE credibility = 'low'")
add("k1_check_capabilities", lambda t: checks.check(t.capabilities.withColumn("tags", F.array("tag")), "capability"), "SELECT 'capability' AS entity, id, 'tags[0]' AS path, 'expected string' AS message FROM capabilities WHERE tag IS NULL")
add("k1_check_summaries", lambda t: checks.check(t.company_summaries, "company_summary", key="company_id"), "SELECT 'company_summary' AS entity, company_id AS id, 'sources' AS path, 'required' AS message FROM company_summaries")
specced = lambda t: t.products.withColumns({"stage": F.lit("ga"), "markets": F.array(F.lit("EU")), "specs": F.create_map(F.lit("size"), F.struct(F.when(F.col("size") % 3 == 0, "number").when(F.col("size") % 3 == 1, "url").otherwise("weight").alias("type"), F.when(F.col("size") % 2 == 0, F.col("size").cast("string")).otherwise("large").alias("value")))})
add("k1_check_specs", lambda t: checks.check(specced(t), "product"),
    """SELECT 'product' AS entity, id, 'specs.size.value' AS path, 'expected number' AS message FROM products WHERE size % 3 = 0 AND size % 2 <> 0 UNION ALL SELECT 'product', id, 'specs.size.value', 'not a URL' FROM products WHERE size % 3 = 1 UNION ALL SELECT 'product', id, 'specs.size.type', 'not in enum' FROM products WHERE size % 3 = 2""")  # fmt: skip
add("k2_check_pages", lambda t: checks.check(t.crawled.withColumn("score", F.col("score") * 1.1), "page"), "SELECT 'page' AS entity, id, 'score' AS path, 'out of range' AS message FROM crawled WHERE score * 1.1::DOUBLE > 1")
add("k3_check_unique", lambda t: checks.check_unique(t.old_products, ["name", "category"]), "SELECT name, category, count(*) AS n FROM old_products GROUP BY 1, 2 HAVING count(*) > 1")

# --- S: link graph ----------------------------------------------------------------------------------------------

add("s1_reach", lambda t: graph.reach(t.links.where("from_url = 'https://x.com/7'").select(F.col("from_url").alias("url")).distinct(), t.links, 2),
    f"""WITH RECURSIVE l AS (SELECT from_url, to_url FROM links WHERE {skip('to_url')} IS NULL), r AS (SELECT DISTINCT from_url AS url, 0 AS depth FROM links WHERE from_url = 'https://x.com/7' UNION SELECT to_url, depth + 1 FROM r JOIN l ON l.from_url = r.url WHERE depth < 2)
    SELECT url, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1""")  # fmt: skip
add("s2_discovery_report", lambda t: graph.discovery_report(t.site_pages), f"SELECT coalesce(split_part({skip('url')}, ':', 1), 'kept') AS outcome, count(*) AS n FROM site_pages GROUP BY 1")

# --- T: batch forms of the streams ------------------------------------------------------------------------------

KINDS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("page_processed", "page_succeeded", "page_failed", "page_skipped", "session_started"))
add("t1_progress_state", lambda t: progress.progress_state(t.progress), f"SELECT session_id, arg_max(value, {{'t': ts, 'e': event_id}}) AS last_value, max(ts) AS last_seen, count(*) AS events, {KINDS} FROM progress GROUP BY 1")
add("t2_progress_metrics", lambda t: progress.progress_metrics_stream(t.progress.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")),
    "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS events, count(*) FILTER (kind = 'page_failed') AS failed, count(*) FILTER (kind = 'page_skipped') AS skipped FROM progress GROUP BY 1")
add("t3_session_gaps", lambda t: progress.session_gaps(t.progress.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").groupBy("session_id").agg(F.count("*").alias("runs"), F.max("events").alias("longest")),
    """WITH g AS (SELECT session_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM progress), r AS (SELECT session_id, sum(s) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS r FROM g), c AS (SELECT session_id, r, count(*) AS n FROM r GROUP BY ALL)
    SELECT session_id, count(*) AS runs, max(n) AS longest FROM c GROUP BY 1""")  # fmt: skip
add("t4_dedupe", lambda t: progress.dedupe_stream(t.fingerprints, ["url", "content_hash"]).select("url", "content_hash"), "SELECT DISTINCT url, content_hash FROM fingerprints")
add("t5_changes", lambda t: entities.detect_changes(entities.latest_snapshots(states(t)).drop("n", "created_at"), states(t).where("created_at < '1998-01-01'")).select("entity_id", F.size("changes").alias("fields")),
    f"""WITH a AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, n DESC) = 1), b AS (SELECT * FROM versions WHERE created_at < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, n DESC) = 1),
    d AS (SELECT a.entity_id, {' + '.join(f'(a.{f} IS DISTINCT FROM b.{f})::INT' for f in FIELDS)} AS fields FROM a JOIN b ON a.entity_id = b.entity_id) SELECT * FROM d WHERE fields > 0""")  # fmt: skip
add("t6_alerts", lambda t: progress.alerts_stream(t.signals, "cmp_1").select("id", "impact"), "SELECT id, impact FROM signals WHERE abs(CAST(impact AS INT)) >= 2 AND NOT list_contains(company_ids, 'cmp_1')")


def streamed_changes(t: Tables) -> DataFrame:
    """The stream over the given orders, run to its end; its changes are read from the files that it wrote."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before, folder = t.spark.conf.get(provider), new_folder(t.spark, "changes")
    t.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        orders = t.spark.readStream.schema(t.orders.schema).option("pathGlobFilter", "orders.parquet").parquet(t.sf_dir)
        versions = t.spark.sql(fixtures.SQL["versions"].replace("FROM orders", "FROM {orders}"), orders=orders)
        stream = versions.withColumn("data", entities.payload(list(FIELDS))).select("entity_type", "entity_id", "n", "created_at", "data")
        changes.write_changes(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    finally:
        t.spark.conf.set(provider, before)
    return t.spark.read.parquet(f"{folder}/out")


add("t5_change_stream", lambda t: streamed_changes(t).select("entity_id", "previous_n", "n", "change_hash", "summary", F.size("changes").alias("fields")),
    f"""{LAGGED} SELECT entity_id, p_n AS previous_n, n, sha256('Order:' || entity_id || ':' || p_n || ':' || n) AS change_hash, left(name || ': ' || array_to_string({PARTS_OF}, ', '), 200) AS summary,
    {' + '.join(f'(p_{f} IS DISTINCT FROM {f})::INT' for f in FIELDS)} AS fields FROM l WHERE p_n IS NOT NULL AND len({PARTS_OF}) > 0""")  # fmt: skip
PAGED = ("page_processed", "page_succeeded", "page_failed")
filed = lambda t: t.progress.withColumns({"type": F.col("kind"), "page": F.when(F.col("kind").isin(*PAGED), F.col("event_id").cast("string")), "reason": F.when(F.col("kind") == "page_failed", F.concat(F.lit("r"), F.col("event_id") % 9))}).withColumn("payload", entities.payload(["type", "page", "reason"]))
add("t1_merged_state", lambda t: progress.merged_state(filed(t)).select("session_id", *[F.col("state")[f].alias(f) for f in ("type", "page", "reason")], F.coalesce(F.col("kinds")["page_failed"], F.lit(0)).alias("page_failed"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "events"),
    """SELECT session_id, arg_max(kind, {'t': ts, 'e': event_id}) AS type, arg_max(event_id || '', {'t': ts, 'e': event_id}) FILTER (kind IN ('page_processed', 'page_succeeded', 'page_failed')) AS page,
    arg_max('r' || (event_id % 9), {'t': ts, 'e': event_id}) FILTER (kind = 'page_failed') AS reason, count(*) FILTER (kind = 'page_failed') AS page_failed, max(ts) AS last_seen, count(*) AS events FROM progress GROUP BY 1""")  # fmt: skip
sized = lambda t: t.progress.withColumns({"ts": F.col("ts").cast("timestamp"), "total": F.when(F.col("kind") == "session_started", 50 + F.col("event_id") % 100)})
add("t2_live_metrics", lambda t: progress.live_metrics(sized(t), "1 day").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}),
    """WITH w AS (SELECT session_id, date_trunc('day', ts)::TIMESTAMP AS s, count(*) FILTER (kind = 'page_processed') AS a, count(*) FILTER (kind = 'page_succeeded') AS b, count(*) FILTER (kind = 'page_failed') AS c, count(*) FILTER (kind = 'page_skipped') AS d, min(ts) AS f, max(50 + event_id % 100) FILTER (kind = 'session_started') AS t FROM progress GROUP BY ALL),
    r AS (SELECT session_id, s AS window_start, s + INTERVAL 1 DAY AS window_end, sum(a) OVER v AS processed, sum(b) OVER v AS succeeded, sum(c) OVER v AS failed, sum(d) OVER v AS skipped, min(f) OVER v AS started, max(t) OVER v AS total FROM w WINDOW v AS (PARTITION BY session_id ORDER BY s)),
    m AS (SELECT *, (processed + failed)::DOUBLE / greatest((epoch_us(window_end) - epoch_us(started)) / 1e6, 1) * 60 AS rate, coalesce(total, 0) - skipped - processed - failed AS rest FROM r)
    SELECT session_id, window_start, window_end, processed, succeeded, failed, skipped, total, round(rate, 6) AS pages_per_minute, CASE WHEN rest > 0 THEN floor(rest / greatest(rate / 60, 0.1))::BIGINT ELSE 0 END AS eta_seconds FROM m""")  # fmt: skip

# --- J: merges by natural key and imports, with all their outputs ------------------------------------------------


def merged_items(t: Tables) -> dict[str, DataFrame]:
    keyed = lambda df: df.withColumn("natural_key", entities.natural_key("capability", F.lit("acme"), name=F.col("name"), category=F.lit(None).cast("string")))
    return upserts.upsert("item", keyed(t.stored_items), keyed(t.incoming_items), ["name", "category", "price"], 7, AS_OF)


ITEM = ("name", "category", "price")
KEYED = f"'acme:capability:' || {norm('name')}"
STEPPED = f"""WITH s AS (SELECT {KEYED} AS natural_key, id AS own, 0 AS age, NULL::BIGINT AS n, name, category, price FROM stored_items UNION ALL SELECT {KEYED}, NULL, 1, n, name, category, price FROM incoming_items),
    f AS (SELECT natural_key, age, n, coalesce(max(own) OVER k, 'ent_' || left(sha256('item:' || natural_key), 12)) AS id, min(age) OVER k = 0 AS known, {', '.join(f'last_value({c} IGNORE NULLS) OVER w AS {c}' for c in ITEM)}, row_number() OVER w AS step FROM s
        WINDOW w AS (PARTITION BY natural_key ORDER BY age, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), k AS (PARTITION BY natural_key)),
    l AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in ITEM)}, coalesce(lag(n) OVER w, 0) AS previous_n, lead(step) OVER w IS NULL AS last FROM f WINDOW w AS (PARTITION BY natural_key ORDER BY age, n)),
    m AS (SELECT *, {' + '.join(f'({c} IS DISTINCT FROM p_{c})::INT' for c in ITEM)} AS moved FROM l)"""
add("j4_upsert_entities", lambda t: merged_items(t)["entities"],
    f"""{STEPPED}, g AS (SELECT natural_key, max(age) AS came, count(*) FILTER (step > 1 AND moved > 0) AS moves FROM m GROUP BY 1)
    SELECT id, natural_key, name, category, price, CASE WHEN came = 0 THEN 'kept' WHEN NOT known THEN 'created' WHEN moves > 0 THEN 'updated' ELSE 'unchanged' END AS status FROM m JOIN g USING (natural_key) WHERE last""")  # fmt: skip
add("j4_upsert_snapshots", lambda t: merged_items(t)["snapshots"].select("entity_type", "entity_id", "n", F.col("data")["name"].alias("name"), F.col("data")["category"].alias("category"), "session_id"),
    f"{STEPPED} SELECT 'item' AS entity_type, id AS entity_id, n, name, category, 7 AS session_id FROM (SELECT * FROM m WHERE age = 1 AND (step = 1 OR moved > 0) QUALIFY row_number() OVER (PARTITION BY id, name, category, price ORDER BY n) = 1) q")
add("j4_upsert_changes", lambda t: merged_items(t)["changes"].select("entity_id", "previous_n", "n", F.array_join("fields_changed", ",").alias("fields"), "change_hash"),
    f"""{STEPPED} SELECT id AS entity_id, previous_n, n, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} IS DISTINCT FROM p_{c} THEN '{c}' END" for c in sorted(ITEM))}], lambda x: x IS NOT NULL), ',') AS fields, sha256('item:' || id || ':' || previous_n || ':' || n) AS change_hash FROM m WHERE age = 1 AND step > 1 AND moved > 0""")
add("j4_upsert_sources", lambda t: merged_items(t)["sources"].select("entity_id", "n", "url", "content_hash", "page_type", "method", "confidence", F.array_join(F.array_sort("fields_extracted"), ",").alias("fields")),
    f"""{STEPPED} SELECT m.id AS entity_id, n, url, content_hash, page_type, method, confidence, array_to_string(list_filter([CASE WHEN i.category IS NOT NULL THEN 'category' END, 'name', CASE WHEN i.price IS NOT NULL THEN 'price' END], lambda x: x IS NOT NULL), ',') AS fields
    FROM m JOIN incoming_items i USING (n) QUALIFY row_number() OVER (PARTITION BY m.id, url, content_hash ORDER BY n) = 1""")  # fmt: skip
add("j4_upsert_log", lambda t: merged_items(t)["log"],
    f"{STEPPED} SELECT 'item' AS entity_type, count(*) AS processed, count(*) FILTER (step = 1 AND NOT known) AS created, count(*) FILTER (step > 1 OR known) AS updated, count(*) FILTER (step > 1 AND moved > 0) AS changes, 7 AS session_id FROM m WHERE age = 1")
add("c10_match_natural_key", lambda t: upserts.matched(t.incoming_items.withColumn("natural_key", F.regexp_replace(F.lower(F.trim("name")), r"\s+", " ")), t.stored_items.withColumn("natural_key", F.lower("name"))).select("n", "natural_key", "id"),
    "SELECT n, regexp_replace(lower(trim(i.name)), '\\s+', ' ', 'g') AS natural_key, s.id FROM incoming_items i LEFT JOIN stored_items s ON regexp_replace(lower(trim(i.name)), '\\s+', ' ', 'g') = lower(s.name)")


def families(t: Tables) -> DataFrame:
    """Products joined to their companies by the ids that come out of one run."""
    key = lambda df, kind, name="name": df.withColumn("natural_key", F.concat(F.lit(f"acme:{kind}:"), F.lower(name)))
    firms = t.found_companies.select("n", "name", "website")
    goods = key(t.found_products, "product").withColumn("company_id", F.concat(F.lit("acme:company:"), F.lower(F.when(F.col("n") % 4 == 0, F.concat(F.lit("New "), F.col("n") % 8)).otherwise(F.col("company")))))
    known = key(t.products, "product").withColumn("company_id", F.lit("cmp_old"))
    out = upserts.upsert_all({"product": (known, goods, ["name", "category", "company_id"]), "company": (key(t.companies, "company"), key(firms, "company"), ["name", "website"])}, {"product": {"company_id": "company"}}, 7, AS_OF)
    child, parent = out["product"]["entities"], out["company"]["entities"]
    return child.join(parent.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id").select("natural_key", "company_id", "company_name")


add("j5_children_by_ids", families,
    """WITH c AS (SELECT 'acme:company:' || lower(name) AS k, min(id) AS id, NULL AS n, arg_min(name, id) AS name FROM companies GROUP BY 1), i AS (SELECT 'acme:company:' || lower(name) AS k, arg_max(name, n) AS name FROM found_companies GROUP BY 1),
    p AS (SELECT k, coalesce(c.id, 'ent_' || left(sha256('company:' || k), 12)) AS company_id, coalesce(i.name, c.name) AS company_name FROM c FULL JOIN i USING (k)),
    g AS (SELECT 'acme:product:' || lower(name) AS natural_key, n, 'acme:company:' || lower(CASE WHEN n % 4 = 0 THEN 'New ' || (n % 8) ELSE company END) AS k FROM found_products)
    SELECT natural_key, company_id, company_name FROM (SELECT natural_key, arg_max(p.company_id, n) AS company_id, arg_max(p.company_name, n) AS company_name FROM g JOIN p ON g.k = p.k GROUP BY 1) q""")  # fmt: skip


def imported(t: Tables) -> dict[str, DataFrame]:
    none = F.array().cast("array<string>")
    serving = {
        "companies": t.companies.select("id", "name", "website", "hq_country", "status", "tags", "aliases"), "company_summaries": files.first_summaries(t.company_summaries).select("company_id", "one_liner", none.alias("sources")),
        "products": t.products.select("id", "name", "company_id", "category", "stage", "short_desc", F.lit(None).cast("string").alias("product_url"), "tags", none.alias("markets")), "capabilities": t.capabilities.select("id", "name", "definition", F.array("tag").alias("tags")),
        "product_capabilities": t.product_capabilities.select("id", "product_id", "capability_id", "maturity", F.lit("").alias("details"), F.lit("").alias("source_id"), F.lit(None).cast("string").alias("method")),
    }
    firms = t.found_companies.withColumns({"hq_country": F.lit(None).cast("string"), "tags": none, "aliases": none, "sources": none})
    goods = t.found_products.withColumns({"product_url": F.lit(None).cast("string"), "tags": none, "markets": none})
    skills = t.found_capabilities.withColumns({c: F.lit(None).cast("string") for c in ("definition", "details", "source_id", "method")}).withColumn("tags", none)
    return upserts.import_serving(serving, firms, goods, skills)


FIRMS = """fl AS (SELECT name, arg_max({'w': website}, n).w AS website, arg_max({'s': coalesce(status, 'active')}, n).s AS status, arg_max({'d': coalesce(short_desc, '')}, n).d AS one_liner FROM found_companies GROUP BY 1),
    oc AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS nth FROM companies),
    co AS (SELECT oc.id, oc.name, CASE WHEN nth = 1 AND fl.name IS NOT NULL THEN fl.website ELSE oc.website END AS website, CASE WHEN nth = 1 AND fl.name IS NOT NULL THEN fl.status ELSE oc.status END AS status FROM oc LEFT JOIN fl ON oc.name = fl.name
        UNION ALL SELECT 'cmp_' || left(sha256(name), 12), name, website, status FROM fl WHERE name NOT IN (SELECT name FROM companies)), ci AS (SELECT name, min(id) AS id FROM co GROUP BY 1)"""
GOODS = """gi AS (SELECT n, ci.id AS company_id, g.name, category, CASE n % 4 WHEN 0 THEN 'beta' WHEN 1 THEN 'ga' WHEN 2 THEN 'alpha' ELSE 'discontinued' END AS stage FROM found_products g JOIN ci ON g.company = ci.name), gl AS (SELECT name, company_id, arg_max(category, n) AS category, arg_max(stage, n) AS stage FROM gi GROUP BY 1, 2),
    op AS (SELECT *, row_number() OVER (PARTITION BY name, company_id ORDER BY id) AS nth FROM products),
    pr AS (SELECT op.id, op.name, op.company_id, CASE WHEN nth = 1 AND gl.name IS NOT NULL THEN gl.category ELSE op.category END AS category, CASE WHEN nth = 1 AND gl.name IS NOT NULL THEN gl.stage ELSE op.stage END AS stage FROM op LEFT JOIN gl ON op.name = gl.name AND op.company_id = gl.company_id
        UNION ALL SELECT 'prd_' || left(sha256(company_id || ':' || name), 12), name, company_id, category, stage FROM gl WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.name = gl.name AND p.company_id = gl.company_id)), pi AS (SELECT name, company_id, min(id) AS id FROM pr GROUP BY 1, 2)"""
SKILLS = "cp AS (SELECT id, name FROM capabilities UNION ALL SELECT DISTINCT 'cap_' || left(sha256(name), 12), name FROM found_capabilities WHERE name NOT IN (SELECT name FROM capabilities)), si AS (SELECT name, min(id) AS id FROM cp GROUP BY 1)"
add("j6_import_companies", lambda t: imported(t)["companies"].select("id", "name", "website", "status"), f"WITH {FIRMS} SELECT * FROM co")
add("j6_import_summaries", lambda t: imported(t)["company_summaries"].select("company_id", "one_liner"),
    f"WITH {FIRMS}, sm AS (SELECT ci.id AS company_id, one_liner FROM fl JOIN ci USING (name)), os AS (SELECT company_id, one_liner FROM company_summaries QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY pos) = 1) SELECT company_id, coalesce(sm.one_liner, os.one_liner) AS one_liner FROM os FULL JOIN sm USING (company_id)")
add("j6_import_products", lambda t: imported(t)["products"].select("id", "name", "company_id", "category", "stage"), f"WITH {FIRMS}, {GOODS} SELECT * FROM pr")
add("j6_import_capabilities", lambda t: imported(t)["capabilities"].select("id", "name"), f"WITH {SKILLS} SELECT * FROM cp")
add("j6_import_links", lambda t: imported(t)["product_capabilities"].select("id", "product_id", "capability_id", "maturity"),
    f"""WITH {FIRMS}, {GOODS}, {SKILLS}, li AS (SELECT f.n, pi.id AS product_id, si.id AS capability_id, CASE WHEN maturity = 'Expert level' THEN 'expert' ELSE 'basic' END AS maturity FROM found_capabilities f JOIN ci ON f.company = ci.name JOIN pi ON f.product = pi.name AND pi.company_id = ci.id JOIN si ON f.name = si.name)
    SELECT id, product_id, capability_id, maturity FROM product_capabilities UNION ALL SELECT 'pc_' || left(sha256(product_id || ':' || capability_id), 12), product_id, capability_id, arg_min(maturity, n) FROM li WHERE NOT EXISTS (SELECT 1 FROM product_capabilities o WHERE o.product_id = li.product_id AND o.capability_id = li.capability_id) GROUP BY 2, 3""")  # fmt: skip
split = lambda t: responses.product_tables(responses.parse_responses(t.consolidated))
add("j9_product_table", lambda t: split(t)[0].select("id", "name", "category", "stage", F.array_join("tags", "|").alias("tags"), F.array_join("markets", "|").alias("markets"), F.col("specs")["weight"]["value"].alias("weight"), F.size("specs").alias("n_specs"), "short_desc", "confidence"),
    """SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE p_type END AS category, CASE p_partkey % 3 WHEN 0 THEN 'ga' WHEN 1 THEN 'beta' ELSE 'alpha' END AS stage, p_brand AS tags, '' AS markets, p_size || '' AS weight, 1 AS n_specs, NULL AS short_desc, 0.9 AS confidence FROM part
    UNION ALL SELECT p_partkey, 'Named ' || p_size, 'unknown', 'ga', '', '', NULL, 0, NULL, 0.9 FROM part""")  # fmt: skip
add("j9_capability_table", lambda t: split(t)[1].select("id", "product", "pos", "name", "definition", F.size("tags").alias("n_tags"), "category"),
    "SELECT p_partkey AS id, p_name AS product, 0 AS pos, 'a' || (p_partkey % 4) AS name, NULL AS definition, 0 AS n_tags, 'general' AS category FROM part UNION ALL SELECT p_partkey, p_name, 2, '', 'd', 0, 'general' FROM part")

# --- U: rules from tables ---------------------------------------------------------------------------------------

add("u_product_rules", lambda t: patterns.facts(fact_text(t), patterns.product_rules(t.spark)).select("id", *[F.col("facts")[n].alias(n) for n, _, _ in (*pages.PRICE_PATTERNS, *pages.SPEC_PATTERNS)]), f"SELECT id, {PRICED} FROM ({FACT_TEXT}) q")
add("u_release_rules", lambda t: patterns.release_facts(t.spark.sql(RELEASES.replace("FROM orders", "FROM {orders}"), orders=t.orders), patterns.release_rules(t.spark)).select("id", "version", "date", "release_name"),
    f"SELECT id, v AS version, d AS date, CASE WHEN v IS NOT NULL THEN 'Version ' || v WHEN d IS NOT NULL THEN 'Release Unknown' END AS release_name FROM (SELECT id, nullif(regexp_extract(text, '{pages.RELEASE_VERSION}', 1), '') AS v, nullif(regexp_extract(text, '{pages.RELEASE_DATE}', 1), '') AS d FROM ({RELEASES}) r) q")
add("u_page_rules", lambda t: patterns.classify(pages.page_metadata(t.site_pages), patterns.page_rules(t.spark)).select("page_id", "category", F.round("base_score", 9).alias("score"), F.array_join("signals", ",").alias("signals")), f"WITH {classified()} SELECT page_id, category, round(score, 9) AS score, signals FROM c")

# --- A, D, F, J: exports by folder, cascade purge, counters, profiles --------------------------------------------


def exported(t: Tables) -> DataFrame:
    """Exports written as JSON below a folder by stage and name, then the newest ones read back."""
    folder = new_folder(t.spark, "exports")
    rows = t.orders.select(F.when(F.col("o_orderkey") % 50 > 30, "2A").otherwise("2B").alias("stage"), F.concat(F.lit("Firm_"), F.col("o_orderkey") % 3, F.lit("_"), F.col("o_orderkey") % 50).alias("file_name"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("status"))
    rows.repartition(8, "stage", "file_name").write.partitionBy("stage", "file_name").json(folder)
    wanted = t.spark.range(5).select(F.concat(F.lit("firm "), "id").alias("competitor"))
    return files.read_latest_exports(t.spark, folder, wanted, "n long, status string")


add("a6_read_latest_exports", exported,
    """WITH f AS (SELECT 'firm ' || (o_orderkey % 3) AS competitor, CASE WHEN o_orderkey % 50 > 30 THEN '2A' ELSE '2B' END AS stage, 'Firm_' || (o_orderkey % 3) || '_' || (o_orderkey % 50) AS file_name, o_orderkey AS n, o_orderstatus AS status FROM orders),
    l AS (SELECT competitor, stage, max(file_name) AS file_name FROM f GROUP BY ALL) SELECT f.* FROM f JOIN l USING (competitor, stage, file_name) WHERE competitor IN (SELECT competitor FROM l GROUP BY 1 HAVING count(*) = 2)""")  # fmt: skip
latest = lambda t: files.export_latest(t.crawl_sessions, t.crawled, t.crawl_sessions, t.fingerprints, t.crawl_sessions)
small = lambda t: t.crawl_sessions.where("id < 5")
add("a10_export_latest", lambda t: files.export_latest(small(t), t.crawled, small(t), t.fingerprints, t.crawl_sessions)["crawl"].select("competitor", "session_id", "id", "url"),
    "WITH l AS (SELECT competitor, arg_max(id, {'s': started_at, 'i': id}) AS session_id FROM crawl_sessions WHERE id < 5 GROUP BY 1) SELECT competitor, session_id, c.id, url FROM crawled c JOIN l USING (session_id)")
add("a10_export_latest_fingerprints", lambda t: files.export_latest(small(t), t.crawled, small(t), t.fingerprints, t.crawl_sessions)["fingerprints"].select("competitor", "id", "extracted_text_preview"),
    "WITH l AS (SELECT competitor, max(id) AS s FROM crawl_sessions WHERE id < 5 GROUP BY 1) SELECT l.competitor, f.id, left(extracted_text, 5000) AS extracted_text_preview FROM fingerprints f JOIN l ON f.fingerprint_session_id = l.s")
add("a10_export_latest_extraction", lambda t: latest(t)["extraction"].select("id", "competitor"), "SELECT arg_max(id, {'s': started_at, 'i': id}) AS id, competitor FROM crawl_sessions GROUP BY competitor")


def purged(t: Tables) -> DataFrame:
    store = Published(t.spark, new_folder(t.spark, "purge"))
    store.publish({"sessions": t.crawl_sessions, "pages": t.crawled, "fingerprints": t.fingerprints})
    return files.purge(store, t.crawl_sessions.where("id < 3"))


add("a12_purge_cascade", purged,
    """WITH p AS (SELECT id FROM crawled WHERE session_id IN (SELECT id FROM crawl_sessions WHERE id < 3)) SELECT 'sessions' AS table_name, count(*) FILTER (id < 3) AS removed, count(*) FILTER (id >= 3) AS kept FROM crawl_sessions
    UNION ALL SELECT 'pages', count(*) FILTER (id IN (SELECT id FROM p)), count(*) FILTER (id NOT IN (SELECT id FROM p)) FROM crawled UNION ALL SELECT 'fingerprints', count(*) FILTER (page_id IN (SELECT id FROM p)), count(*) FILTER (page_id NOT IN (SELECT id FROM p)) FROM fingerprints""")  # fmt: skip
add("d7_run_counters", lambda t: stats.run_counters(t.crawl_sessions, t.page_outcomes, t.found_entities, t.found_entities.where("entity_type = 'release'")),
    """SELECT s.id AS session_id, coalesce(a, 0) AS processed_pages, coalesce(b, 0) AS skipped_pages, coalesce(c, 0) AS failed_pages, coalesce(h, 0) AS cache_hits, coalesce(r, 0) AS total_retries, coalesce(co, 0) AS company_found, coalesce(pr, 0) AS product_found, 0 AS capability_found, coalesce(re, 0) AS release_found, 0 AS document_found, coalesce(si, 0) AS signal_found, coalesce(ch, 0) AS changes_detected
    FROM crawl_sessions s LEFT JOIN (SELECT session_id, count(*) FILTER (outcome = 'processed') AS a, count(*) FILTER (outcome = 'skipped') AS b, count(*) FILTER (outcome = 'failed') AS c, count(*) FILTER (cache_hit) AS h, sum(retries)::BIGINT AS r FROM page_outcomes GROUP BY 1) o ON o.session_id = s.id
    LEFT JOIN (SELECT session_id, count(DISTINCT entity_id) FILTER (entity_type = 'company') AS co, count(DISTINCT entity_id) FILTER (entity_type = 'product') AS pr, count(DISTINCT entity_id) FILTER (entity_type = 'release') AS re, count(DISTINCT entity_id) FILTER (entity_type = 'signal') AS si, count(*) FILTER (entity_type = 'release') AS ch FROM found_entities GROUP BY 1) f ON f.session_id = s.id""")  # fmt: skip
add("d4_scoring_details", lambda t: stats.scoring_details(t.crawled).select("id", "outcome", "reason", "score"), "SELECT id, CASE WHEN contains(reason, 'attempted') AND ai_success THEN 'successful' WHEN contains(reason, 'attempted') THEN 'failed' ELSE 'skipped' END AS outcome, reason, score FROM crawled")
SKETCHED = ("website", "status", "hq_country", "name")


def sketched(t: Tables) -> DataFrame:
    """Profiles of two halves, united; near tells whether the estimate lies within 2 % of the exact number."""
    halves = [stats.profile_sketches(t.companies.where(f"pmod(hash(id), 2) = {k}"), list(SKETCHED)) for k in (0, 1)]
    merged = stats.profile_estimates(stats.merge_profiles(halves[0].unionByName(halves[1])))
    exact = stats.column_profile(t.companies, list(SKETCHED)).select("column_name", F.col("different").alias("exact"))
    return merged.join(exact, "column_name").select("column_name", "n", "valid", "nulls", (F.abs(F.col("different") - F.col("exact")) <= F.greatest(F.col("exact") * 0.02, F.lit(0.5))).alias("near"))


add("d14_profile_sketches", sketched, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS valid, count(*) FILTER ({c} IS NULL) AS nulls, true AS near FROM companies" for c in SKETCHED))
paired = lambda t: t.versions.withColumn("data", entities.payload(FIELDS)).withColumn("old", F.lag("data").over(Window.partitionBy("entity_id").orderBy("created_at", "n"))).where("old is not null").withColumn("s", entities.field_sets(F.col("old"), F.col("data")))
KIND_OF = {"added": "p_{f} IS NULL AND {f} IS NOT NULL", "removed": "p_{f} IS NOT NULL AND {f} IS NULL", "modified": "p_{f} <> {f}"}
add("f5_changed_fields", lambda t: paired(t).select("entity_id", "n", *[F.array_join(f"s.{k}", ",").alias(k) for k in KIND_OF]),
    f"{LAGGED} SELECT entity_id, n, " + ", ".join("array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond.format(f=f)} THEN '{f}' END" for f in sorted(FIELDS)) + f"], lambda x: x IS NOT NULL), ',') AS {k}" for k, cond in KIND_OF.items()) + " FROM l WHERE p_n IS NOT NULL")
add("j7_product_profiles", lambda t: entities.product_profiles(t.facts).select("company_id", "name", F.array_join("markets", ",").alias("markets"), F.array_join("tags", ",").alias("tags"), "stage", F.size("sources").alias("sources"), F.col("specs")["WEIGHT"].alias("weight")),
    f"""SELECT company_id, name, string_agg(DISTINCT market, ',' ORDER BY market) AS markets, array_to_string(list_sort(list_distinct(list(lower(tag))))[1:5], ',') AS tags, CASE min({STAGED}) WHEN 0 THEN 'discontinued' WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' ELSE 'ga' END AS stage, count(DISTINCT url) AS sources,
    arg_min(replace(bullet, 'WEIGHT: ', ''), {{'u': url, 'v': replace(bullet, 'WEIGHT: ', '')}}) AS weight FROM facts GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY name) <= 20""")  # fmt: skip
add("j8_company_profile", lambda t: entities.company_profile(t.facts).select("company_id", "name", F.array_join("aliases", "|").alias("aliases"), "website", F.array_join("tags", ",").alias("tags"), F.array_join("sources", ",").alias("sources")),
    """WITH n AS (SELECT company_id, arg_min(name, {'r': CASE lower(page_type) WHEN 'product' THEN 3 WHEN 'docs' THEN 4 ELSE 5 END, 'u': url, 'n': name}) AS name, list_sort(list_distinct(list(name))) AS names, min({'l': length(url), 'u': url}).u AS website,
    array_to_string(list_sort(list_distinct(list(lower(tag))))[1:3], ',') AS tags, array_to_string(list_sort(list_distinct(list(url)))[1:6], ',') AS sources FROM facts GROUP BY 1) SELECT company_id, name, array_to_string(list_filter(names, lambda x: x <> name), '|') AS aliases, website, tags, sources FROM n""")  # fmt: skip
add("l3_score_details", lambda t: responses.validate_scores(parsed(t)).select("id", "reasoning", F.array_join("signals", "|").alias("signals"), F.size("secondary_categories").alias("n_secondary")),
    f"SELECT id, CASE WHEN {VALID} THEN 'ok' ELSE 'Failed to parse AI response' END AS reasoning, CASE WHEN {VALID} THEN '' ELSE 'parse_error' END AS signals, 0 AS n_secondary FROM responses")
released = lambda t: t.spark.sql(RELEASES.replace("FROM orders", "FROM {orders}"), orders=t.orders).withColumns({"url": F.concat(F.lit("https://acme.com/r/"), "id"), "page_type": F.when(F.col("id") % 2 == 0, "release").otherwise("docs")})
add("g6_extraction_results", lambda t: pages.extraction_results(released(t)),
    """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'release' ELSE 'docs' END AS page_type, CASE WHEN o_orderkey % 2 = 1 THEN 0.8::DOUBLE WHEN o_orderkey % 3 = 0 THEN 0.9::DOUBLE WHEN o_orderkey % 3 = 1 THEN 0.85::DOUBLE END AS c FROM orders)
    SELECT id, page_type, CASE WHEN c IS NULL THEN 1 ELSE 2 END AS kinds, round(CASE WHEN c IS NULL THEN 0.7 ELSE (0.7::DOUBLE + c) / 2 END, 9) AS confidence, true AS success FROM c""")  # fmt: skip

# --- H: summaries of the rules ------------------------------------------------------------------------------------


def summary(name: str, column: str) -> None:
    """How many rows have each outcome of a rule that another query applies."""
    QUERIES[f"{name}_summary"] = lambda spark, sf_dir: text.outcome_summary(QUERIES[name](spark, sf_dir), F.coalesce(F.col(column).cast("string"), F.lit("none")))
    ORACLE_SQL[f"{name}_summary"] = f"SELECT coalesce({column} || '', 'none') AS outcome, count(*) AS n FROM ({ORACLE_SQL[name]}) q GROUP BY 1"


for rule, column in (("h7_extract_version", "version"), ("h8_product_tier", "tier"), ("h10_normalize_stage", "stage_lenient"), ("h11_normalize_maturity", "level"), ("h13_token_estimate", "tokens"), ("h6_normalize_text", "normalized")):
    summary(rule, column)
