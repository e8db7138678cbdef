"""Golden cases: small literal tables, values worked out by hand."""

import time

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text, urls
from marketlens.operators import catalog, checks, entities, graph, pages, responses, stats


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize("url,want", [
    ("HTTP://www.Acme.com", "http://acme.com/"), ("https://acme.com/a/?utm_source=x&b=1&flag#top", "https://acme.com/a?b=1"), ("https://a_b.com/x|y/", "https://a_b.com/x|y"), ("", ""), (None, None),
])
def test_canonical_url(spark, url, want):
    assert one(spark, url, urls.canonical_url) == want


@pytest.mark.parametrize("host,want", [("www.shop.acme.co.uk", "acme.co.uk"), ("a.b.com", "b.com"), ("localhost", "localhost"), ("co.uk", "co.uk")])
def test_registrable_domain(spark, host, want):
    assert one(spark, host, urls.registrable_domain) == want


@pytest.mark.parametrize("link,want", [("/a", "https://x.com/a"), ("b", "https://x.com/d/b"), ("../c", "https://x.com/c"), ("./e", "https://x.com/d/e"), ("//y.org/f", "https://y.org/f"), ("mailto:me", "mailto:me")])
def test_resolve_link(spark, link, want):
    assert one(spark, link, lambda c: urls.resolve_link(c, F.lit("https://x.com/d/page.html"))) == want


@pytest.mark.parametrize("typed,ok,reason", [
    ("acme.com", True, None), ("ftp://acme.com", False, "Only HTTP and HTTPS URLs are supported"), ("http://192.168.1.1", False, "Private IP addresses and localhost are not allowed"), ("x y.com", False, "URL cannot contain spaces"),
    ("test.com", False, "Placeholder domains are not allowed"), ("nodots", False, "Invalid domain name"), ("a" * 2001, False, "URL is too long (max 2000 characters)"),
])
def test_validated(spark, typed, ok, reason):
    r = one(spark, typed, urls.validated)
    assert (r.ok, r.reason) == (ok, reason)


@pytest.mark.parametrize("url,want", [
    ("https://x.com/privacy", "URL contains low-value pattern: privacy"), ("https://x.com/a.png", "URL has skip extension: .png"), ("https://x.com/de/a", "URL contains non-English language path: /de/"),
    ("https://x.com/a?sort=1", "URL has skip query parameter: sort="), ("https://x.com/a#tab2", "URL has skip fragment: tab2"), ("https://x.com/products/a", None),
])
def test_skip_reason(spark, url, want):
    assert one(spark, url, urls.skip_reason) == want


def test_names(spark):
    assert one(spark, "  My-Product_Name!  api ", text.normalize_text) == "my-product_name API"
    assert one(spark, None, text.normalize_text) == "" and one(spark, "Élan", text.normalize_text) == "élan"
    assert [one(spark, "Thing v2.1.0", f) for f in (text.without_version, text.version_of)] == ["Thing", "2.1.0"]
    assert [one(spark, "Thing v2", f) for f in (text.without_version, text.version_of)] == ["Thing", "v2"]
    assert [one(spark, "Thing Pro", f) for f in (text.without_tier, text.tier_of)] == ["Thing", "pro"]
    assert one(spark, "Thing", text.version_of) is None


def test_policies(spark):
    assert [one(spark, s, text.stage) for s in ("Public Beta", "now GA", "end of life", None, "pre-order")] == ["beta", "ga", "discontinued", "alpha", "beta"]
    assert [one(spark, s, text.strict_stage) for s in ("Beta", "production", None)] == ["beta", "ga", "ga"]
    assert [one(spark, s, text.maturity) for s in ("Expert level", "released", None)] == ["expert", "ga", "basic"]
    assert one(spark, "85", lambda c: text.rescaled_score(c.cast("double"))) == 0.85 and one(spark, "200", lambda c: text.rescaled_score(c.cast("double"))) is None


def test_token_rules(spark):
    assert one(spark, "a" * 40, text.token_estimate) == 10 and one(spark, "{" + "a" * 39, text.token_estimate) == 12 and one(spark, None, text.token_estimate) == 0
    cut = one(spark, "Word one. " * 40, lambda c: text.truncate_tokens(c, 20))
    assert cut.endswith(".") and len(cut) <= 72
    assert one(spark, "x" * 400, lambda c: text.truncate_tokens(c, 20)) == "x" * 72 + "..."


def test_page_facts_that_the_tables_lack(spark):
    html = "<html><head><TITLE>Acme <b>Product</b></TITLE><link rel='canonical' href='https://www.acme.com/p/?utm_source=x'></head><body><nav>menu</nav><h1>One</h1><h2>Two</h2><h2>Three</h2><h3>x</h3><a class='k' href='/q/'>q</a><div data-url='r'></div><script>var a</script></body></html>"
    df = spark.createDataFrame([(1, "https://acme.com/p", html)], "page_id long, url string, html string")
    m = pages.page_metadata(df).first()
    assert (m.title, m.h1, m.h2, m.h3) == ("Acme Product", "One", "Two Three", "x")
    assert pages.key_urls(df).first().key_url == "https://acme.com/p"
    assert sorted(r.link for r in pages.extract_links(df).collect()) == ["https://acme.com/q", "https://acme.com/r"]
    c = pages.classify_pages(pages.page_metadata(df)).first()
    assert c.category == "product" and c.signals == ["product_title"] and abs(c.base_score - 1.0) < 1e-9
    for parser in (False, True):
        assert "menu" not in pages.clean_text(df, parser).first().clean


def test_product_and_release_facts(spark):
    docs = spark.createDataFrame([(1, "Acme CleanBot. Price: $1,299.00, or 30 per month. 16 GB RAM, 2 TB storage, 8 core"), (2, "Released version 2.4 today. ## 2.5 - Faster\nmore"), (3, "")], "id long, text string")
    f = {r.id: r for r in pages.product_facts(docs).collect()}
    assert (f[1].currency_amount, f[1].per_month_pricing, f[1].memory, f[1].storage, f[1].cpu_cores) == ("1,299.00", "30", "16 GB", "2 TB", "8")
    assert f[3].confidence == 0 and f[3].name is None
    r = {r.id: r for r in pages.release_facts(docs).collect()}
    assert (r[2].version, r[2].release_name, r[2].notes) == ("2.5", "Version 2.4", "Faster\nmore")


def test_caps_where_both_bind(spark):
    rows = [(1, i, f"d{i % 2}", f"c{i % 3}", 1 - i / 100) for i in range(30)]
    df = spark.createDataFrame(rows, "session_id int, id long, domain string, primary_category string, score double")
    kept, room = [], {}
    for _, i, d, c, _ in rows:
        if room.get(d, 0) < 4 and room.get(c, 0) < 2:
            room[d], room[c] = room.get(d, 0) + 1, room.get(c, 0) + 1
            kept.append(i)
    assert sorted(r.id for r in stats.cap_pages(df, 4, 2).collect()) == kept


def test_repair_of_responses(spark):
    texts = ['{"a": 1}', 'so:\n```json\n{"score": 80}\n```', 'x {"a": [1, 2,],} y', "none", None, '{"message": {"content": "hi"}}', '{bad} then {"score": 0.4, "category": "docs"}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    assert {r.id: r.step for r in responses.parse_responses(df).collect()} == {0: "strict", 1: "fenced", 2: "trailing_commas", 3: None, 4: None, 5: "strict", 6: "last_object"}
    assert df.select(responses.unwrap(F.col("content"))).collect()[5][0] == "hi"


def test_long_responses_are_repaired_in_linear_time(spark):
    n = 40_000
    texts = ["a" * n, "{" * n, "```" + " " * n, '{"a": 1' + " " * n + '"b"', '{"a": "x"' + "\n" * n + "b", "{" + '"score" ' * (n // 8) + "{", '{bad} {"score": 1} ' + "a" * n, '["a"' + "\n" * n + '"b"] {"c": ["a" ' + "\n" * n + ' "b"]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").coalesce(1)
    began = time.time()
    got = {r.id: r.step for r in responses.parse_responses(df).select("id", "step").collect()}
    assert time.time() - began < 30  # a search from every character takes minutes
    assert got == dict.fromkeys(range(6)) | {6: "last_object", 7: "missing_commas"}
    gaps = ['{"a": "x"\n\n "b": 1}', '{"a": "x"  "b": 1}', '{"a": ["x" \n "y"]}']
    assert [r.step for r in responses.parse_responses(spark.createDataFrame(list(enumerate(gaps)), "id long, content string")).orderBy("id").collect()] == ["missing_commas", None, "missing_commas"]


@pytest.mark.parametrize("n", [1_000, 20_000, 150_000])
def test_united_sketches_keep_their_promise(spark, n):
    columns = [f"c{i}" for i in range(20)]
    df = spark.range(n).select("id", *[F.concat(F.lit(f"Supplier#{c}-"), "id").alias(c) for c in columns])
    halves = [stats.profile_sketches(df.where(f"id % 2 = {k}"), columns) for k in (0, 1)]
    got = stats.profile_estimates(stats.merge_profiles(halves[0].unionByName(halves[1]))).collect()
    assert len(got) == 20 and max(abs(r.different - n) / n for r in got) <= 0.02


def test_facts_of_long_texts_in_linear_time(spark):
    n = 100_000
    words, lines = "service " + "word " * n, "robot api\n" + "line\n" * n
    texts = [words, lines, "b" * n + "bot", "x" * n, "1" * n + " core", "plan " * n, "Some robot" + " word" * n, "a. " + "word " * n + "API service\nNext Great Cleaner " + "word " * n, "x ab1-Cd2 CleanBotics 12.345 per month"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    began = time.time()
    got = {r.id: r for r in pages.product_facts(df).collect()}
    assert time.time() - began < 60  # a search from every word, line or character takes much longer
    assert [len(got[i].name or "") for i in range(9)] == [0, 5 * n + 9, n + 3, 0, 0, 0, len(texts[6]) - 5, len("Next Great Cleaner"), 8]
    assert got[4].cpu_cores == "1" * n and got[5].pricing_table is None and (got[8].name, got[8].per_month_pricing) == ("CleanBot", "345")


def test_merge_is_idempotent_and_equal_states_do_not_change(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, name string, note string")
    new = spark.createDataFrame([(2, "b", None), (3, "c", "y")], "id long, name string, note string")
    first = entities.upsert(old, new, "id", ["name", "note"])
    assert {r.id: (r.note, r.status) for r in first.collect()} == {1: (None, "kept"), 2: ("x", "unchanged"), 3: ("y", "created")}
    again = entities.upsert(first.select("id", "name", "note"), new, "id", ["name", "note"])
    assert {r.status for r in again.collect()} == {"kept", "unchanged"}


def test_checks_raise_in_strict_mode(spark):
    bad = spark.createDataFrame([("p1", None, "gamma", "c", "x", [], [])], "id string, name string, stage string, company_id string, category string, markets array<string>, tags array<string>")
    assert {(r.path, r.message) for r in checks.check(bad, "product").collect()} == {("name", "required"), ("stage", "not in enum")}
    with pytest.raises(ValueError):
        checks.check(bad, "product", strict=True)


def test_reach_takes_the_least_depth(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("b", "x/de/")], "from_url string, to_url string")
    got = graph.reach(spark.createDataFrame([("a",)], "url string"), links, 2)
    assert {r.url: r.depth for r in got.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert graph.reach(spark.createDataFrame([("a",)], "url string"), links, 2, max_pages=2).count() == 2


def test_reach_rewrites_each_spelling_and_tests_each_reached_one_once(spark, monkeypatch):
    ends = [f"https://www.x.com/{i}" for i in range(12)]
    links = spark.createDataFrame([(a, b) for a in ends for b in ends], "from_url string, to_url string")
    calls = {name: spark.sparkContext.accumulator(0) for name in ("canonical_url", "skip_reason")}

    def counted(name, value):
        def run(u):
            calls[name].add(1)
            return value(u)

        return F.udf(run, "string")

    monkeypatch.setattr(graph.urls, "canonical_url", counted("canonical_url", lambda u: u.replace("www.", "")))
    monkeypatch.setattr(graph.urls, "skip_reason", counted("skip_reason", lambda u: "odd" if u.endswith("3") else None))
    got = graph.reach(spark.createDataFrame([(ends[0],), (ends[0],)], "url string"), links, 2)
    assert {r.url: r.depth for r in got.collect()} == {e.replace("www.", ""): int(e != ends[0]) for e in ends if not e.endswith("3")}
    assert calls["canonical_url"].value == 12 + 1
    assert calls["skip_reason"].value == 1 + 11 + 1  # the seed, the others, and again the one that was skipped


def test_lookups_and_pages(spark):
    df = spark.createDataFrame([(str(i),) for i in range(60)], "id string")
    with pytest.raises(LookupError):
        catalog.children(df, df, "x", "id")
    assert {r.total_pages for r in catalog.paginate(df, 3, [F.asc("id")]).collect()} == {3}
    assert catalog.since_preset("ytd", "2024-05-06") == "2024-01-01" and catalog.since_preset("7d", "2024-05-06") == "2024-04-30"


def test_language_segments_and_deep_links(spark):
    df = spark.createDataFrame([("https://x.com/sesotho-sa-leboa/a",), ("https://x.com/af/a",), ("https://x.com/O'zbek/",), ("https://x.com/plain/af",)], "u string")
    got = [r[0] for r in df.select(urls.skip_reason(F.col("u"))).collect()]
    lead = "URL contains non-English language path: "
    assert got == [lead + "/sesotho-sa-leboa/", lead + "/af/", lead + "/o'zbek/", None]
    assert len(urls.LANGUAGE_SEGMENTS) == 215
    base = "https://x.com/a/b/c/d/e/f/page.html?q=1"
    links = {"../../../../../z": "/a/z", "./y": "/a/b/c/d/e/f/y", "../" * 9 + "z?w=../v": "/z?w=../v", "..": "/a/b/c/d/e/", "/p/./q/../r/.": "/p/r/"}
    rows = spark.createDataFrame([(k, base) for k in links], "l string, b string").select("l", urls.resolve_link(F.col("l"), F.col("b"))).collect()
    assert {r[0]: r[1] for r in rows} == {k: "https://x.com" + v for k, v in links.items()}


def test_payload_hashes_tell_values_apart_and_values_keep_colons(spark):
    from marketlens.operators import entities

    df = spark.createDataFrame([({"a": "1\nb=2"},), ({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},)], "data map<string,string>")
    one, two, same = (r[0] for r in df.select(entities.data_hash(F.col("data"))).collect())
    assert one != two == same
    facts = spark.createDataFrame([(1, "p", "m", "t", "beta", "u", "RATIO: 1:2")], "company_id long, name string, market string, tag string, stage string, url string, bullet string")
    assert entities.consolidate_products(facts).first()["specs"] == "RATIO=1:2"


def test_import_keeps_ids_and_updates_listed_columns_only(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (3, "b", "z", 3)], "id int, name string, category string, price int")
    new = spark.createDataFrame([(7, "a", None, 9), (8, "a", "w", 8), (9, "c", "v", 7), (10, None, "u", 6)], old.schema)
    got = {tuple(r) for r in entities.import_entities(old, new, ["name"], ["category"]).collect()}
    assert got == {(1, "a", None, 1), (2, "a", "y", 2), (3, "b", "z", 3), (9, "c", "v", 7), (10, None, "u", 6)}
    assert {r.id for r in entities.import_entities(old, new, ["name"]).collect()} == {1, 2, 3, 9, 10}


def test_ordered_upserts_give_children_the_ids_of_known_and_new_parents(spark):
    companies = spark.createDataFrame([("c1", "Acme")], "id string, name string").selectExpr("*", "'w' as website")
    more = spark.createDataFrame([("c7", "Acme"), ("c8", "New")], "id string, name string").selectExpr("*", "'w' as website")
    products = spark.createDataFrame([(1, "p", "c1")], "id int, name string, company string")
    incoming = spark.createDataFrame([(5, "p", "Acme"), (6, "q", "New"), (7, "r", "None")], products.schema)
    out = entities.upsert_all({"product": (products, incoming, "name", ["company"]), "company": (companies, more, "name", ["website"])}, {"product": {"company": "company"}})
    assert list(out) == ["company", "product"]
    assert {(r.name, r.company, r.status) for r in out["product"].collect()} == {("p", "c1", "unchanged"), ("q", "c8", "created"), ("r", None, "created")}
