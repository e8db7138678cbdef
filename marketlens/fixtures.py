"""The reference tables of the queries, made from the given tables by the same SQL in Spark and in DuckDB.

Operators never mention these. A few words differ between the engines: ARR(..) is an array, MINUTES(n) an interval.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AS_OF = "2024-01-31 00:00:00"

SQL = {
    "companies": """SELECT 'cmp_' || s_suppkey AS id, s_name AS name, n_name AS hq_country,
        CASE s_suppkey % 3 WHEN 0 THEN 'https://www.' || lower(replace(s_name, '#', '-')) || '.com' WHEN 1 THEN lower(replace(s_name, '#', '-')) || '.co.uk' ELSE NULL END AS website,
        CASE s_suppkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'active' WHEN 2 THEN 'acquired' ELSE 'closed' END AS status, s_suppkey = 1 AS is_self,
        ARR(upper(s_name), 'S' || (s_suppkey % 7)) AS aliases, ARR(n_name, CASE WHEN s_acctbal > 5000 THEN 'large' ELSE 'small' END) AS tags FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "company_summaries": "SELECT 'cmp_' || (c_custkey % 10) AS company_id, c_name AS one_liner, c_mktsegment AS footprint, c_custkey AS pos FROM customer",
    "products": """SELECT 'prd_' || p_partkey AS id, 'cmp_' || (p_partkey % 10) AS company_id, p_name AS name, p_type AS category,
        CASE p_partkey % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'Beta program' WHEN 2 THEN 'GA' WHEN 3 THEN 'EOL since May' ELSE NULL END AS stage, p_brand || ' ' || p_type AS short_desc,
        ARR(p_brand, lower(p_type)) AS tags, p_size AS size, p_retailprice AS price FROM part""",
    "capabilities": "SELECT DISTINCT 'cap_' || lower(p_type) AS id, p_type AS name, CASE WHEN p_type = 'SMALL' THEN NULL ELSE 'About ' || lower(p_type) END AS definition, lower(p_type) AS tag FROM part",
    "product_capabilities": """SELECT 'pc_' || p_partkey AS id, 'prd_' || p_partkey AS product_id, 'cap_' || lower(p_type) AS capability_id,
        CASE p_size % 5 WHEN 0 THEN 'Basic' WHEN 1 THEN 'advanced tier' WHEN 2 THEN 'General Availability' WHEN 3 THEN 'reported' ELSE NULL END AS maturity FROM part""",
    "sources": "SELECT 'src_' || n_nationkey AS id, 'https://' || lower(n_name) || '.org' AS origin, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'Author ' || n_regionkey END AS author, CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS credibility FROM nation",
    "signals": """SELECT 'sig_' || event_id AS id, event_type AS type, 'Signal ' || event_type || ' ' || event_id AS headline, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS summary, ts AS published_at,
        (CAST(floor(value) AS INT) % 5 - 2) || '' AS impact, ARR('cmp_' || (user_id % 10)) AS company_ids, ARR('prd_' || (event_id % 200), 'prd_' || (event_id % 7)) AS product_ids, ARR('cap_small') AS capability_ids,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'src_' || (event_id % 30) END AS source_id, event_id AS n FROM events""",
    "crawl_sessions": "SELECT CAST(c_custkey AS INT) AS id, CASE c_nationkey % 3 WHEN 0 THEN 'acme' WHEN 1 THEN 'globex' ELSE 'initech' END AS competitor, 'v' || (c_custkey % 2) AS schema_version, TIMESTAMP '2024-01-01 00:00:00' + MINUTES(c_custkey * 7) AS started_at, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + MINUTES(c_custkey * 7 + 30) END AS completed_at, CAST(c_custkey % 11 AS INT) AS failed, CAST(c_custkey % 11 + c_custkey % 5 AS INT) AS total, CAST(c_custkey % 50 AS INT) AS crawl_id FROM customer",
    "crawled": """SELECT doc_id AS id, CAST(doc_id % 5 AS INT) AS session_id, 'https://www.' || source || '.com/' || lang || '/' || (doc_id % 60) || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '?utm_source=a&x=1' END AS url, source AS domain,
        'https://' || source || '.com/' || lang || '/' || (doc_id % 60) AS canonical_url, CASE doc_id % 8 WHEN 0 THEN 'product' WHEN 1 THEN 'datasheet' WHEN 2 THEN 'docs' WHEN 3 THEN 'pricing' WHEN 4 THEN 'releases' WHEN 5 THEN 'news' WHEN 6 THEN 'other' ELSE 'legal' END AS primary_category,
        CAST(doc_id * 37 % 101 AS DOUBLE) / 100 AS score, CAST(doc_id * 17 % 101 AS DOUBLE) / 100 AS rules_score, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id * 29 % 101 AS DOUBLE) / 100 ELSE NULL END AS ai_score,
        CASE WHEN doc_id % 3 = 0 THEN 'AI scoring attempted' WHEN doc_id % 3 = 1 THEN 'AI scoring disabled in settings' ELSE 'URL matches noise pattern' END AS reason, doc_id % 6 = 0 AS ai_success, CASE WHEN doc_id % 6 = 0 THEN 'ai' ELSE 'rules' END AS scoring_method, CAST(doc_id % 3 AS INT) AS depth, CAST(n_chars AS INT) AS size_bytes, lang || (doc_id % 40) AS content_hash,
        CASE WHEN doc_id % 9 = 0 THEN 404 ELSE 200 END AS status_code, TIMESTAMP '2024-01-01 00:00:00' + MINUTES(doc_id) AS crawled_at FROM documents""",
    "fingerprints": """SELECT doc_id AS id, CAST(doc_id % 5 AS INT) AS fingerprint_session_id, doc_id + (doc_id % 7) * 100000 % 300000 AS page_id, 'https://' || source || '.com/' || (doc_id % 60) AS url, CASE doc_id % 5 WHEN 0 THEN 'product' WHEN 1 THEN 'release' WHEN 2 THEN 'docs' WHEN 3 THEN 'pricing' ELSE 'news' END AS page_type, source AS competitor,
        CASE WHEN doc_id % 13 = 0 THEN 'error' ELSE lang || (doc_id % 40) END AS content_hash, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS extracted_text, CAST(n_chars AS INT) AS normalized_text_len,
        CASE doc_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/plain' ELSE 'image/png' END AS content_type, CAST(doc_id * 7919 % 30000000 AS INT) AS content_length FROM documents""",
    "site_pages": """SELECT page_id, CAST(page_id % 4 AS INT) AS session_id, CAST(page_id % 3 AS INT) AS depth, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status,
        replace(replace(replace(url, '.com/', '.com/' || w || '/'), '.net/', '.net/' || w || '/'), '.org/', '.org/' || w || '/') AS url, replace(html, '<title>', '<title>' || w || ' ') AS html FROM (SELECT page_id, url, html,
        CASE page_id % 10 WHEN 0 THEN 'products' WHEN 1 THEN 'docs' WHEN 2 THEN 'pricing' WHEN 3 THEN 'releases' WHEN 4 THEN 'news' WHEN 5 THEN 'manual' WHEN 6 THEN 'careers' WHEN 7 THEN 'systems' WHEN 8 THEN 'about-team' ELSE 'item.pdf' END AS w FROM pages) q""",
    "versions": "SELECT 'Order' AS entity_type, 'c' || o_custkey AS entity_id, o_orderkey AS n, o_orderdate AS created_at, 'Customer ' || o_custkey AS name, o_orderstatus AS status, o_orderpriority AS version, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS pricing FROM orders",
    "entity_names": "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name || ' v2.' || p_size WHEN 1 THEN p_name || ' Pro' WHEN 2 THEN upper(p_name) || '  API!' WHEN 3 THEN p_name || ' v' || p_size WHEN 4 THEN 'Élan_' || p_name || ' Enterprise 1.2.' || p_size ELSE p_name || ' sdk + ui (x)' END AS name, p_brand AS company, p_type AS category, p_size AS size FROM part",
    "responses": """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN body WHEN 1 THEN 'Let me think about it.' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'Answer: ' || body || ' done' WHEN 3 THEN replace(body, '}', ',}') WHEN 4 THEN 'no object here' ELSE '[' || body || ', 2]' END AS content, doc_id AS n FROM (SELECT doc_id,
        '{"' || CASE WHEN doc_id % 4 = 0 THEN 'category' ELSE 'primary_category' END || '": "' || CASE doc_id % 5 WHEN 0 THEN 'product' WHEN 1 THEN 'docs' WHEN 2 THEN 'weird' ELSE 'news' END || '", "score": ' || CASE WHEN doc_id % 3 = 0 THEN '0.' || (10 + doc_id % 90) WHEN doc_id % 3 = 1 THEN (doc_id % 100) || '' ELSE '500' END || ', "confidence": 0.' || (doc_id % 10) || ', "products": [' || doc_id || '], "reasoning": "ok"}' AS body FROM documents) q""",
    "failures": "SELECT doc_id AS id, 'm' || (doc_id % 3) AS model, CASE doc_id % 7 WHEN 0 THEN 'HTTP 401 Unauthorized' WHEN 1 THEN 'Rate limit reached' WHEN 2 THEN 'Connection reset' WHEN 3 THEN 'Missing required field: score' WHEN 4 THEN 'KeyError' WHEN 5 THEN '503 from upstream' ELSE 'Quota exceeded, timeout' END AS error FROM documents",
    "facts": """SELECT o_orderkey AS id, 'cmp_' || (o_custkey % 40) AS company_id, 'Product ' || (o_orderkey % 90) AS name, 'https://x.com/' || o_orderstatus || '/' || (o_orderkey % 30) AS url, CASE o_orderkey % 5 WHEN 0 THEN 'product' WHEN 1 THEN 'docs' WHEN 2 THEN 'blog' WHEN 3 THEN 'PRICING' ELSE 'other' END AS page_type, CASE WHEN o_orderkey % 2 = 0 THEN 'rules' ELSE 'ai' END AS method,
        CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence, o_orderpriority AS tag, o_orderstatus AS market, CASE o_orderkey % 4 WHEN 0 THEN 'ga' WHEN 1 THEN 'beta' WHEN 2 THEN 'alpha' ELSE CASE WHEN o_orderkey % 360 = 3 THEN 'discontinued' ELSE 'ga' END END AS stage, 'WEIGHT: ' || (o_orderkey % 9) || ' kg' AS bullet, o_orderdate AS seen_at FROM orders""",
    "old_products": "SELECT * FROM (SELECT p_name || ' ' || p_brand AS name, p_type AS category, p_retailprice AS price, p_partkey AS id FROM part) q WHERE id % 3 <> 0",
    "new_products": "SELECT * FROM (SELECT p_name || ' ' || p_brand AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS category, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price, p_partkey AS id FROM part) q WHERE id % 4 <> 0",
    "stored_items": "SELECT 'ent' || p_partkey AS id, 'Item ' || p_partkey AS name, p_type AS category, p_retailprice AS price FROM part WHERE p_partkey % 3 = 0",
    "incoming_items": """SELECT CAST(p_partkey AS BIGINT) AS n, CASE WHEN p_partkey % 2 = 0 THEN 'ITEM ' ELSE ' item  ' END || CAST(floor(p_partkey / 2) AS INT) AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS category, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price,
        'https://x.com/' || (p_partkey % 2) AS url, 'h' || (p_partkey % 2) AS content_hash, 'product' AS page_type, CASE WHEN p_partkey % 3 = 0 THEN 'ai' ELSE 'rules' END AS method, CAST(p_partkey % 10 AS DOUBLE) / 10 AS confidence FROM part""",
    "found_companies": "SELECT CAST(s_suppkey AS BIGINT) AS n, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'New ' || (s_suppkey % 6) END AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'https://n' || s_suppkey || '.com' END AS website, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'dormant' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'About ' || s_suppkey END AS short_desc FROM supplier",
    "found_products": "SELECT CAST(p_partkey AS BIGINT) AS n, s_name AS company, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Thing ' || (p_partkey % 50) END AS name, p_type AS category, CASE p_partkey % 4 WHEN 0 THEN 'beta test' WHEN 1 THEN 'GA' WHEN 2 THEN NULL ELSE 'EOL' END AS stage, p_brand AS short_desc FROM part JOIN supplier ON s_suppkey = p_partkey % 10",
    "found_capabilities": "SELECT CAST(p_partkey AS BIGINT) AS n, s_name AS company, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Thing ' || (p_partkey % 50) END AS product, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'Skill ' || (p_size % 7) END AS name, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Expert level' ELSE 'reported' END AS maturity FROM part JOIN supplier ON s_suppkey = p_partkey % 10",
    "consolidated": """SELECT p_partkey AS id, '{"products": {"' || p_name || '": {"category": ' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"' || p_type || '"' END || ', "stage": "' || CASE p_partkey % 3 WHEN 0 THEN 'GAMMA' WHEN 1 THEN 'Beta' ELSE 'alpha' END || '", "specs": {"weight": ' || p_size || ', "height": null}, "tags": ["' || p_brand || '"], "capabilities": [{"name": "a' || (p_partkey % 4) || '", "tags": null}, "junk", {"definition": "d"}]},
        "second ' || p_partkey || '": {"name": "Named ' || p_size || '", "capabilities": null, "short_desc": ""}}}' AS content FROM part""",
    "page_outcomes": "SELECT CAST(doc_id % 5 AS INT) AS session_id, CASE WHEN doc_id % 7 < 4 THEN 'processed' WHEN doc_id % 7 < 6 THEN 'skipped' ELSE 'failed' END AS outcome, doc_id % 4 = 0 AS cache_hit, CAST(doc_id % 3 AS INT) AS retries FROM documents",
    "found_entities": "SELECT CAST(o_orderkey % 4 AS INT) AS session_id, CASE o_orderkey % 5 WHEN 0 THEN 'company' WHEN 1 THEN 'product' WHEN 2 THEN 'product' WHEN 3 THEN 'release' ELSE 'signal' END AS entity_type, 'e' || (o_orderkey % 60) AS entity_id FROM orders",
    "progress": "SELECT user_id AS session_id, ts, CASE event_type WHEN 'signup' THEN 'session_started' WHEN 'view' THEN 'page_processed' WHEN 'click' THEN 'page_succeeded' WHEN 'error' THEN 'page_failed' ELSE 'page_skipped' END AS kind, value, event_id FROM events",
    "cache": "SELECT o_orderkey AS n, 'k' || (o_orderkey % 700) AS cache_key, 'r' || o_orderkey AS response, TIMESTAMP '2024-01-01 00:00:00' + MINUTES(o_orderkey * 10) AS expires_at FROM orders WHERE o_orderkey % 2 = 0",
    "requests": "SELECT o_orderkey AS request_id, 'k' || (o_orderkey % 900) AS cache_key, o_orderpriority AS prompt, o_orderstatus AS page_type FROM orders",
    "links": "SELECT DISTINCT 'https://x.com/' || (l_partkey % 500) AS from_url, 'https://x.com/' || CASE WHEN l_suppkey % 9 = 0 THEN 'de/' ELSE '' END || (l_orderkey % 500) AS to_url FROM lineitem",
}


def needed(text: str) -> list[str]:
    """Names of the tables above that a statement mentions, dependencies first."""
    found: list[str] = []
    for name in SQL:
        if re.search(rf"\b(?:FROM|JOIN|from|join)\s+{name}\b", text) and name not in found:
            found += [n for n in needed(SQL[name]) if n not in found]
            found.append(name)
    return found


def duckdb(text: str) -> str:
    """A statement with the tables above in front of it, in DuckDB's words."""
    tables = ", ".join(f"{name} AS ({SQL[name]})" for name in needed(text))
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text)
    if tables and head:
        text = f"WITH {head[1] or ''}{tables}, {text[head.end() :]}"
    elif tables:
        text = f"WITH {tables} {text}"
    return re.sub(r"\bARR\(", "list_value(", re.sub(r"\bMINUTES\(", "to_minutes(", text))


class Tables:
    """Attributes are the given tables and the ones above."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in SQL:
            raise AttributeError(name)
        text, frames = SQL[name].replace("{", "{{").replace("}", "}}"), {}
        for t in [*GIVEN, *SQL]:
            if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text):
                frames[t] = getattr(self, t)
                text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
        text = re.sub(r"\bMINUTES\(", "make_dt_interval(0, 0, ", re.sub(r"\bARR\(", "array(", text))
        return self.spark.sql(text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), **frames)
