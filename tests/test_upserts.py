"""Merges by natural key, imports, published versions, constraints and rule tables on small inputs."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import checks, entities, pages, patterns, responses, upserts
from marketlens.storage import Published

OLD = "id string, natural_key string, name string, price int"
NEW = "natural_key string, n long, name string, price int, url string, content_hash string, page_type string, method string, confidence double"


def run(spark, old, new, **k):
    rows = [(key, n, name, price, f"u{n % 2}", "h", "product", "rules", 0.5) for key, n, name, price in new]
    return upserts.upsert("item", spark.createDataFrame(old, OLD), spark.createDataFrame(rows, NEW), ["name", "price"], 1, "2024-01-01 00:00:00", **k)


def listed(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_outputs_of_an_upsert(spark):
    old = [("i1", "a", "A", 1), ("i2", "b", "B", 2), ("i3", "c", None, 3), ("i9", "a", "twin", 9), ("i5", None, "no key", 1)]
    new = [("a", 1, None, 5), ("a", 2, "A2", None), ("a", 3, "A2", 5), ("b", 4, "B", 2), ("d", 5, "D", None), ("d", 6, "D", 7), ("d", 7, "D", None), (None, 8, "x", 1)]
    out = run(spark, old, new)
    new_id = out["entities"].where("natural_key = 'd'").first().id
    assert listed(out["entities"], "id", "natural_key", "name", "price", "status") == sorted([("i1", "a", "A2", 5, "updated"), ("i2", "b", "B", 2, "unchanged"), ("i3", "c", None, 3, "kept"), (new_id, "d", "D", 7, "created")], key=str)
    assert listed(out["snapshots"], "entity_id", "n") == sorted([("i1", 1), ("i1", 2), (new_id, 5), (new_id, 6)], key=str)
    assert sorted((r.entity_id, r.previous_n, r.n, [(c.field, c.old, c.new) for c in r.changes]) for r in out["changes"].collect()) == sorted([("i1", 0, 1, [("price", "1", "5")]), ("i1", 1, 2, [("name", "A", "A2")]), (new_id, 5, 6, [("price", None, "7")])])
    assert listed(out["sources"], "entity_id", "n") == sorted([("i1", 1), ("i1", 2), ("i2", 4), (new_id, 5), (new_id, 6)], key=str)
    assert out["log"].first()[:5] == ("item", 7, 1, 6, 3)


def test_a_repeated_upsert_changes_nothing(spark):
    new = [("a", 1, "A", 1), ("b", 2, "B", None), ("a", 3, "A", 4)]
    first = run(spark, [], new)
    last = [("a", 11, "A", 4), ("b", 12, "B", None)]
    again = upserts.upsert("item", first["entities"].select("id", "natural_key", "name", "price"), spark.createDataFrame([(k, n, x, p, "u", "h", "t", "m", 0.1) for k, n, x, p in last], NEW), ["name", "price"], 2, "2024-01-02 00:00:00", stored=first["snapshots"])
    assert {r.status for r in again["entities"].collect()} == {"unchanged"} and again["changes"].isEmpty() and again["snapshots"].isEmpty()
    assert listed(first["entities"], "id", "name") == listed(again["entities"], "id", "name") and again["log"].first()[1:5] == (2, 0, 2, 0)


def test_states_that_were_kept_before_give_no_new_snapshot(spark):
    out = run(spark, [("i", "a", "A", 1)], [("a", 1, "B", 1), ("a", 2, "A", 1), ("a", 3, "B", 1)])
    assert listed(out["snapshots"], "n") == [(1,), (2,)] and out["changes"].count() == 3
    assert run(spark, [], [])["log"].first()[1:5] == (0, 0, 0, 0)


def test_children_get_the_ids_of_parents_that_come_out(spark):
    firm = "id string, natural_key string, name string"
    came = "natural_key string, n long, name string"
    firms = (spark.createDataFrame([("c1", "old", "Old")], firm), spark.createDataFrame([("new", 1, "New"), ("old", 2, "Old")], came), ["name"])
    goods = (spark.createDataFrame([], firm + ", company_id string"), spark.createDataFrame([("p", 1, "P", "new"), ("q", 2, "Q", "old"), ("r", 3, "R", "none")], came + ", company_id string"), ["name", "company_id"])
    out = upserts.upsert_all({"product": goods, "company": firms}, {"product": {"company_id": "company"}}, 1, "2024-01-01 00:00:00")
    both = out["product"]["entities"].join(out["company"]["entities"].select(F.col("id").alias("company_id"), F.col("name").alias("firm")), "company_id", "left")
    assert listed(both, "name", "firm") == [("P", "New"), ("Q", "Old"), ("R", None)]
    assert out["product"]["sources"].count() == 3 and out["product"]["sources"].first().url is None


def test_published_versions(spark, tmp_path):
    store = Published(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.read("a")
    assert store.publish({"a": spark.range(3), "b": spark.range(1)}) == 1
    bad = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        store.publish({"a": spark.range(9), "b": bad})
    assert store.version() == 1 and store.read("a").count() == 3
    assert store.publish({"a": spark.range(5), "b": spark.range(2)}) == 2 and store.read("a").count() == 5 and store.read("a", 1).count() == 3
    with pytest.raises(RuntimeError, match="another writer"):
        store.publish({"a": spark.range(7)}, base=1)
    out = run(spark, [], [("a", 1, "A", 1)])
    assert upserts.publish({"item": out}, str(tmp_path / "entities")) == 1
    assert Published(spark, str(tmp_path / "entities")).read("item_entities").first().name == "A"


def serving(spark):
    none = F.array().cast("array<string>")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    firms = spark.createDataFrame([("c1", "Old", "w", "DE", "active"), ("c0", "Old", "w0", "DE", "active")], "id string, name string, website string, hq_country string, status string").withColumns({"tags": none, "aliases": none})
    return {
        "companies": firms, "company_summaries": empty("company_id string, one_liner string, sources array<string>"),
        "products": empty("id string, name string, company_id string, category string, stage string, short_desc string, product_url string, tags array<string>, markets array<string>"),
        "capabilities": spark.createDataFrame([("k1", "vision", "sees")], "id string, name string, definition string").withColumn("tags", none),
        "product_capabilities": empty("id string, product_id string, capability_id string, maturity string, details string, source_id string, method string"),
    }


def test_import_hands_ids_on_and_can_be_repeated(spark):
    none = F.array().cast("array<string>")
    firms = spark.createDataFrame([(1, "Old", None, None, None, "first"), (2, "Old", "w2", None, "dormant", None), (3, "New", "n", "FR", None, "new one"), (4, None, "x", None, None, None)], "n long, name string, website string, hq_country string, status string, short_desc string").withColumns({"tags": none, "aliases": none, "sources": none})
    goods = spark.createDataFrame([(1, "New", "P", "c1", "Beta"), (2, "New", "P", "c2", None), (3, "Old", "P", "c3", "GA"), (4, "Nobody", "Q", "c", "GA")], "n long, company string, name string, category string, stage string").withColumns({"short_desc": F.lit(None).cast("string"), "product_url": F.lit("u"), "tags": none, "markets": none})
    skills = spark.createDataFrame([(1, "New", "P", "vision", "other", None), (2, "New", "P", "grip", "holds", "Expert"), (3, "New", "P", "grip", "again", "basic"), (4, "Old", "none", "lost", None, None)], "n long, company string, product string, name string, definition string, maturity string").withColumns({"tags": none, **{c: F.lit(None).cast("string") for c in ("details", "source_id", "method")}})
    out = upserts.import_serving(serving(spark), firms, goods, skills)
    ids = {r.name: r.id for r in out["companies"].orderBy(F.desc("id")).collect()}
    assert listed(out["companies"], "id", "website", "status") == sorted([("c0", "w2", "dormant"), ("c1", "w", "active"), (ids["New"], "n", "active")])
    assert listed(out["company_summaries"], "company_id", "one_liner") == sorted([("c0", ""), (ids["New"], "new one")])
    assert listed(out["products"], "company_id", "name", "category", "stage") == sorted([("c0", "P", "c3", "ga"), (ids["New"], "P", "c2", "alpha")])
    assert listed(out["capabilities"], "name", "definition") == [("grip", "holds"), ("lost", None), ("vision", "sees")]
    links = out["product_capabilities"].join(out["products"].select(F.col("id").alias("product_id"), "company_id"), "product_id").join(out["capabilities"].select(F.col("id").alias("capability_id"), "name"), "capability_id")
    assert listed(links, "company_id", "name", "maturity", "details") == sorted([(ids["New"], "grip", "expert", ""), (ids["New"], "vision", "basic", "")])
    again = upserts.import_serving(out, firms, goods, skills)
    assert all(sorted(map(str, again[k].collect())) == sorted(map(str, out[k].select(*again[k].columns).collect())) for k in out)


def test_nested_constraints(spark):
    row = spark.range(1).selectExpr(
        "'p' id", "'c' company_id", "cast(null as string) name", "7 category", "'ga' stage", "array('EU', null) markets", "cast(null as array<string>) tags", "'' product_url", "'nowhere' docs_url", "named_struct('hero', 3) media",
        "map('w', parse_json('{\"type\": \"number\", \"value\": \"3\"}'), 'r', parse_json('{\"type\": \"range\", \"min\": 1}'), 'u', parse_json('{\"type\": \"url\", \"value\": \"x\"}'), 'ok', parse_json('{\"type\": \"array\", \"value\": []}'), 'no', parse_json('{\"value\": 1}')) specs",
        "'2024-02-31T00:00:00Z' released_at", "timestamp'2024-01-01' eol_at", "array(1) compliance",
    )
    found = {(r.path, r.message) for r in checks.check(row, "product").collect()}
    assert found == {
        ("name", "required"), ("category", "expected string"), ("markets[1]", "expected string"), ("tags", "required"), ("docs_url", "not a URL"), ("media.hero", "expected string"), ("specs.w.value", "expected number"), ("specs.r.max", "expected number"),
        ("specs.u.value", "not a URL"), ("specs.no.type", "not in enum"), ("released_at", "not a date-time"), ("compliance[0]", "expected string"),
    }
    good = spark.range(1).selectExpr("'c' id", "'' name", "array() aliases", "'https://a.b' website", "'dormant' status", "array('t') tags", "true is_self")
    assert checks.check(good.withColumn("aliases", F.array().cast("array<string>")), "company", strict=True).isEmpty()
    assert {(r.path, r.message) for r in checks.check(good.drop("status").withColumn("is_self", F.lit("yes")), "company").collect()} == {("status", "required"), ("is_self", "expected boolean"), ("aliases", "expected strings")} - {("aliases", "expected strings")}


def test_rule_tables_agree_with_the_constants(spark, sf):
    text = "The Pudu CleanBot Alpha. Plan: $12.50 per month, 64 GB RAM, 8 core. Released version 2.1 on May 3, 2024.\n## 3.0 - New things\nFeatures: fast, small. Specs: 3 kg"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Some Great Service and 2 TB disk")], "id int, text string")
    names = ["name", *[n for n, _, _ in (*pages.PRICE_PATTERNS, *pages.SPEC_PATTERNS)]]
    want = {r.id: tuple(r[n] for n in names) + (round(r.confidence, 9),) for r in pages.product_facts(docs).collect()}
    got = {r.id: tuple(r.facts.get(n) for n in names) + (round(r.confidence, 9),) for r in patterns.facts(docs, patterns.product_rules(spark)).collect()}
    assert got == want and want[1][0]
    more = patterns.facts(docs, patterns.product_rules(spark, fields=True)).where("id = 1").first().facts
    assert (more["version"], more["features"], more["specifications"]) == ("2.1", "fast, small", "3 kg")
    columns = ("id", "version", "date", "notes", "release_name")
    assert listed(patterns.release_facts(docs, patterns.release_rules(spark)), *columns) == listed(pages.release_facts(docs), *columns)
    own = patterns.rules(spark, [("weight", "weight", r"(\d+) kg", 0.5), ("other", "weight", r"(\d+) GB", 0.9)])
    assert [(r.facts, r.confidence) for r in patterns.facts(docs, own).orderBy("id").collect()] == [({"weight": "3"}, 0.5), ({}, 0.0), ({}, 0.0), ({}, 0.0)]
    for bad in ([("x", "f", "(", 0.1)], [("x", "f", None, 0.1)], [(f"r{i}", "f", "a", 0.1) for i in range(patterns.MOST + 1)]):
        with pytest.raises(ValueError):
            patterns.facts(docs, patterns.rules(spark, bad))


def test_product_tables_of_odd_responses(spark):
    body = '{"products": {"A": {"stage": null, "specs": {"w": 1.5, "o": {"x": 1}}, "markets": ["EU"], "released_at": "2024", "capabilities": [7, {"name": "c", "tags": ["t"], "definition": ""}]}, "B": 3}}'
    rows = spark.createDataFrame([(1, body), (2, '{"products": [1]}'), (3, "no"), (4, '{"products": null}')], "id int, content string")
    products, capabilities = responses.product_tables(responses.parse_responses(rows))
    got = {r.name: r for r in products.where("id = 1").collect()}
    assert set(got) == {"A", "B"} and got["A"].stage == "ga" and {k: v.value for k, v in got["A"].specs.items()} == {"w": "1.5", "o": '{"x":1}'} and got["A"].markets == ["EU"] and got["B"].category == "unknown" and got["B"].specs == {}
    assert listed(capabilities, "id", "product", "pos", "name", "definition", "category") == [(1, "A", 1, "c", None, "general")] and products.where("id > 1").isEmpty()


def test_source_records_have_defaults(spark):
    rows = "id long, entity_type string, entity_id string, url string, data map<string,string>"
    facts = spark.createDataFrame([(2, "Product", "a", None, {"b": "1", "a": "2", "c": None}), (3, "Product", "a", "", None), (1, "Product", "b", "u", None)], rows)
    got = {r.id: r for r in entities.source_records(facts).collect()}
    assert set(got) == {1, 2}  # a null address is an empty one, so the second record of "a" repeats the first
    assert got[2].fields_extracted == ["a", "b"] and got[1].fields_extracted == [] and (got[1].confidence, got[1].cache_hit, got[1].ai_model, got[1].tokens_input) == (0.0, False, None, None)
    cost = entities.source_costs(entities.source_records(facts)).first()
    assert (cost.records, cost.cache_hits, cost.tokens_input, cost.fields) == (2, 0, 0, 2)
    assert entities.source_costs(entities.source_records(facts.limit(0))).count() == 0
