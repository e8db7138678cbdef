"""Natural keys, source ranks, merges, snapshots and change records of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import text, urls

# Authority of the kinds of page.
PAGE_RANKS = {"product": 10, "pricing": 9, "datasheet": 8, "api": 8, "release": 7, "docs": 6, "whitepaper": 5, "manual": 5, "blog": 4, "news": 3, "about": 2, "unknown": 1}
LIST_FIELDS, PROSE_FIELDS = ("tags", "markets", "features", "compliance"), ("description", "summary", "notes")
STAGE_RANK = {"discontinued": 0, "deprecated": 1, "alpha": 2, "beta": 3, "ga": 4}


def natural_key(kind: str, competitor: Column, **c: Column) -> Column:
    """The natural key of a company, product, release, document, signal or capability from its columns."""
    some = lambda x, prefix="": F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(prefix), x))
    norm = text.normalize_text
    if kind == "company":
        host = F.lower(F.regexp_extract(F.coalesce(c["website"], F.lit("")), r"https?://(?:www\.)?([^/]+)", 1))
        return F.concat_ws(":", competitor, F.lit(kind), norm(c["name"]), host)
    if kind == "product":
        base = text.without_version(c["name"])
        company = F.when(c["company_id"] != "unknown", c["company_id"])
        return F.concat_ws(":", competitor, F.lit(kind), norm(text.without_tier(base)), company, some(text.version_of(c["name"]), "v"), some(text.tier_of(base), "tier_"))
    day = lambda d: some(F.split_part(d, F.lit("T"), F.lit(1)))
    if kind == "release":
        return F.concat_ws(":", competitor, F.lit(kind), norm(c["name"]), some(c["version"], "v"), day(c["date"]))
    if kind == "document":
        return F.concat_ws(":", competitor, F.lit(kind), norm(c["title"]), some(c["doc_type"]), some(F.left(F.element_at(F.split(c["url"], "/"), -1), F.lit(50))))
    if kind == "signal":
        return F.concat_ws(":", competitor, F.lit(kind), c["type"], norm(c["title"]), day(c["date"]))
    if kind == "capability":
        return F.concat_ws(":", competitor, F.lit(kind), norm(c["name"]), some(c["category"]))
    return F.concat_ws(":", competitor, F.lit(kind.lower()), F.left(norm(F.concat_ws(" ", *c.values())), F.lit(100)))


def source_rank(url: Column, page_type: Column, method: Column, confidence: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in PAGE_RANKS.items() for x in pair])
    u = F.lower(url)
    depth = F.least(F.greatest(F.size(F.split(url, "/")) - 3, F.lit(0)) * 0.1, F.lit(0.5))
    bonus = F.when(F.contains(u, F.lit("/products/")), 0.2).otherwise(0.0) + F.when(F.contains(u, F.lit("/pricing")), 0.15).otherwise(0.0) + F.when(urls.has_any(u, ["/docs/", "/documentation/"]), 0.1).otherwise(0.0)
    base = F.coalesce(F.element_at(ranks, F.lower(page_type)), F.lit(1))
    return F.greatest((base + F.when(method == "rules", 0.1).otherwise(0.0) + bonus - depth) * confidence, F.lit(0.1))


def resolve_fields(values: DataFrame) -> DataFrame:
    """(entity, field, value, rank, pos) to one value and its confidence for each field.

    The highest rank wins; prose whose two best sources are close keeps four fifths of its confidence. List fields
    keep every value once, without regard to case, and their mean confidence, 1 at most.
    """
    order = Window.partitionBy("entity", "field").orderBy(F.desc("rank"), "pos")
    ranked = values.withColumns({"rn": F.row_number().over(order), "next": F.lead("rank").over(order)})
    lists = F.col("field").isin(*LIST_FIELDS)
    close = F.col("field").isin(*PROSE_FIELDS) & (F.col("rank") - F.col("next") < 0.2)
    one = ranked.where(~lists & (F.col("rn") == 1)).select("entity", "field", F.col("value").alias("resolved"), F.when(close, F.col("rank") * 0.8).otherwise(F.col("rank")).alias("confidence"))
    spelled = Window.partitionBy("entity", "field", F.lower("value")).orderBy("rn")
    kept = ranked.where(lists).withColumn("new", F.row_number().over(spelled) == 1)
    many = kept.groupBy("entity", "field").agg(F.array_sort(F.collect_list(F.when(F.col("new"), F.struct("rn", "value")))).alias("v"), F.sum(F.when(F.col("new"), F.col("rank"))).alias("s"), F.count("*").alias("n"))
    many = many.select("entity", "field", F.array_join("v.value", ", ").alias("resolved"), F.least(F.col("s") / F.col("n"), F.lit(1.0)).alias("confidence"))
    return one.unionByName(many)


def payload(columns: list[str]) -> Column:
    """A map of the columns that are not null, as text."""
    return F.map_filter(F.create_map(*[x for c in sorted(columns) for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())


def data_hash(data: Column) -> Column:
    """SHA-256 of the payload with its keys in order; each value follows its length, so that no two payloads look alike."""
    entries = F.array_sort(F.map_entries(data))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.length(e["value"]), F.lit(":"), e["value"])), "\n"), 256)


def take_snapshots(entities, existing=None):
    """One snapshot for each new state (entity_type, entity_id, data_hash); states already kept are not written again."""
    keyed = entities.withColumn("data_hash", data_hash(F.col("data")))
    first = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("entity_type", "entity_id", "data_hash").orderBy("created_at", "n"))).where("rn = 1").drop("rn")
    return first if existing is None else first.join(existing.select("entity_type", "entity_id", "data_hash").distinct(), ["entity_type", "entity_id", "data_hash"], "left_anti")


def latest_snapshots(snaps, as_of: str | None = None):
    """The last state of each entity, or the last one at a time."""
    known = snaps if as_of is None else snaps.where(F.col("created_at") <= F.to_timestamp_ntz(F.lit(as_of)))
    order = Window.partitionBy("entity_type", "entity_id").orderBy(F.desc("created_at"), F.desc("n"))
    return known.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def field_changes(old: Column, new: Column) -> Column:
    """array of (field, old, new, type) by field."""
    fields = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    changed = F.filter(fields, lambda k: ~F.element_at(old, k).eqNullSafe(F.element_at(new, k)))
    kind = lambda k: F.when(F.element_at(old, k).isNull(), "added").when(F.element_at(new, k).isNull(), "removed").otherwise("modified")
    return F.transform(changed, lambda k: F.struct(k.alias("field"), F.element_at(old, k).alias("old"), F.element_at(new, k).alias("new"), kind(k).alias("type")))


def field_sets(old: Column, new: Column) -> Column:
    """(added, removed, modified): the names of fields that only one of two payloads has, and of those that differ."""
    names = lambda kind: F.transform(F.filter(field_changes(old, new), lambda c: c["type"] == kind), lambda c: c["field"])
    return F.struct(*[names(k).alias(k) for k in ("added", "removed", "modified")])


def history_changes(versions):
    """Changes between successive states of each entity; the first state and equal states give none."""
    order = Window.partitionBy("entity_type", "entity_id").orderBy("created_at", "n")
    pairs = versions.withColumns({"previous": F.lag("data").over(order), "previous_n": F.lag("n").over(order)}).where("previous is not null")
    out = pairs.withColumn("changes", field_changes(F.col("previous"), F.col("data"))).where(F.size("changes") > 0)
    return out.withColumns({"change_hash": F.sha2(F.concat_ws(":", "entity_type", "entity_id", "previous_n", "n"), 256), "summary": change_summary(F.col("data")["name"], F.col("changes"))})


def detect_changes(incoming, snaps):
    """Changes of incoming states (entity_type, entity_id, data) against the latest snapshot."""
    last = latest_snapshots(snaps).select("entity_type", "entity_id", F.col("data").alias("previous"))
    both = incoming.join(last, ["entity_type", "entity_id"])
    return both.withColumn("changes", field_changes(F.col("previous"), F.col("data"))).where(F.size("changes") > 0)


def change_summary(name: Column, changes: Column) -> Column:
    has = lambda *fields: F.exists(changes, lambda c: c["field"].isin(*fields))
    turn = lambda field: F.array_join(F.transform(F.filter(changes, lambda c: c["field"] == field), lambda c: F.concat(F.lit(f"{field} "), F.coalesce(c["old"], F.lit("None")), F.lit(" → "), F.coalesce(c["new"], F.lit("None")))), "")
    state = F.when(has("status"), turn("status")).when(has("stage"), turn("stage"))
    parts = F.array_compact(F.array(F.when(has("version"), turn("version")), state, F.when(has("pricing"), F.lit("pricing updated")), F.when(has("features", "tags"), F.lit("features updated")), F.when(F.exists(changes, lambda c: F.endswith(c["field"], F.lit("_url"))), F.lit("URLs updated"))))
    n = F.size(changes)
    said = F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 3), ", ")).otherwise(F.concat(n, F.when(n > 1, F.lit(" fields updated")).otherwise(F.lit(" field updated"))))
    return F.left(F.concat(F.coalesce(name, F.lit("Unknown")), F.lit(": "), said), F.lit(200))


def change_feed(changes, limit: int = 50, entity_id: str | None = None):
    found = changes if entity_id is None else changes.where(F.col("entity_id") == entity_id)
    return found.orderBy(F.desc("created_at"), F.desc("n")).limit(limit)


def provenance(facts):
    """Source rows, one for each entity, URL and content hash."""
    first = Window.partitionBy("entity_type", "entity_id", "url", "content_hash").orderBy("id")
    return facts.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


#: Columns of a source record besides its keys, with their types and what they are where they are absent or null.
SOURCE_COLUMNS = {
    "url": ("string", ""), "content_hash": ("string", ""), "page_type": ("string", ""), "method": ("string", ""), "ai_model": ("string", None), "confidence": ("double", 0.0),
    "tokens_input": ("long", None), "tokens_output": ("long", None), "processing_time_ms": ("long", None), "cache_hit": ("boolean", False),
}


def source_records(facts, data: str = "data"):
    """provenance() of facts (id, entity_type, entity_id and a map of values) with fields_extracted, the sorted names of the
    fields that the source gave (an empty list for a null map), and what it cost; absent columns and nulls have defaults."""
    filled = lambda c, kind, default: F.coalesce(F.col(c).cast(kind) if c in facts.columns else F.lit(None).cast(kind), F.lit(default).cast(kind)).alias(c)
    given = F.coalesce(F.array_sort(F.map_keys(F.map_filter(data, lambda _, v: v.isNotNull()))), F.array().cast("array<string>"))
    rows = facts.select("id", "entity_type", "entity_id", *[filled(c, *of) for c, of in SOURCE_COLUMNS.items()], given.alias("fields_extracted"))
    return provenance(rows)


def source_costs(records, by=("method",)):
    """What the sources of each group cost: records, those out of the cache, tokens in and out, milliseconds, fields."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return records.groupBy(*by).agg(F.count("*").alias("records"), F.count_if("cache_hit").alias("cache_hits"), *map(total, ("tokens_input", "tokens_output", "processing_time_ms")), F.sum(F.size("fields_extracted")).alias("fields"))


def seen_span(facts, by=("company_id",)):
    return facts.groupBy(*by).agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_updated"))


def upsert(existing, incoming, key: str, fields: list[str]):
    """Merged entities with status: incoming values win, absent ones keep the old; and the changes of updated ones."""
    old = existing.select(key, *[F.col(c).alias(f"old_{c}") for c in fields], F.lit(True).alias("was"))
    new = incoming.select(key, *[F.col(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("comes"))
    both = old.join(new, key, "full_outer")
    merged = both.withColumns({c: F.coalesce(f"new_{c}", f"old_{c}") for c in fields})
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in fields]))
    status = F.when(F.col("was").isNull(), "created").when(F.col("comes").isNull(), "kept").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    return merged.withColumns({"status": status, "changed": F.when(status == "updated", changed).otherwise(F.array().cast("array<string>"))}).select(key, *fields, "status", "changed")


def upsert_summary(merged):
    return merged.agg(F.count_if(F.col("status") != "kept").alias("processed"), F.count_if(F.col("status") == "created").alias("created"), F.count_if(F.col("status") == "updated").alias("updated"), F.sum(F.size("changed")).cast("long").alias("changes"))


def key_map(existing, incoming, key: str):
    """(key, id) of every natural key: the id of the existing entity, else the least id that comes with the key."""
    of = lambda df, age: df.select(F.col(key).alias("key"), "id", F.lit(age).alias("age"))
    both = of(existing, 0).unionByName(of(incoming, 1)).where("key is not null")
    return both.groupBy("key").agg(F.min(F.struct("age", "id"))["id"].alias("id"))


def upsert_all(tables: dict[str, tuple[DataFrame, DataFrame, str, list[str]]], parents: dict[str, dict[str, str]] | None = None) -> dict[str, DataFrame]:
    """Upserts (existing, incoming, key, fields) of each kind in dependency order: companies, products, capabilities, the rest.

    parents has the kind of the parent by kind and column: such a column of incoming rows holds the natural key of the
    parent and gets the id that this has, null where there is none. Of incoming rows of one key that of the least id counts.
    """
    order, ids, out = ["company", "product", "capability"], {}, {}
    for kind in sorted(tables, key=lambda n: (order.index(n) if n in order else len(order), n)):
        existing, incoming, key, fields = tables[kind]
        incoming = incoming.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where("rn = 1").drop("rn")
        for column, parent in (parents or {}).get(kind, {}).items():
            known = ids[parent].select(F.col("key").alias(column), F.col("id").alias("__id"))
            incoming = incoming.join(known, column, "left").withColumn(column, F.col("__id")).drop("__id")
        ids[kind], out[kind] = key_map(existing, incoming, key), upsert(existing, incoming, key, fields)
    return out


def import_entities(existing, incoming, key: list[str], update: list[str] | None = None):
    """existing with the first row of each new key of incoming; a known key keeps its id and takes the columns of update.

    Of several existing rows of one key the first by id is updated; rows with a null in the key are new.
    """
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    first = incoming.withColumn("rn", nth).where("rn = 1").drop("rn")
    fresh = first.join(existing.select(*key).distinct(), key, "left_anti")
    if update:
        known = existing.withColumn("__nth", nth).join(first.select(*key, F.struct(*update).alias("__new")), key, "left")
        takes = (F.col("__nth") == 1) & F.col("__new").isNotNull()
        existing = known.select(*[F.when(takes, F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in update else c for c in existing.columns])
    return existing.unionByName(fresh)


def product_profiles(facts, most: int = 20):
    """consolidate_products() with lists and a map: markets, five tags, stage, sources and the specifications by label.

    A label that pages give different values for keeps the one of the first page by URL.
    """
    ranks = F.create_map(*[F.lit(x) for pair in STAGE_RANK.items() for x in pair])
    label, value = F.trim(F.split_part("bullet", F.lit(":"), F.lit(1))), F.trim(F.regexp_extract("bullet", "(?s)^[^:]*:(.*)$", 1))
    rows = facts.withColumns({"__label": F.when(F.contains("bullet", F.lit(":")) & (label != ""), label), "__value": value})
    specs = rows.where("__label is not null").groupBy("company_id", "name", "__label").agg(F.min_by("__value", F.struct("url", "__value")).alias("value"))
    specs = specs.groupBy("company_id", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__label", "value")))).alias("specs"))
    rest = rows.groupBy("company_id", "name").agg(F.array_sort(F.collect_set("market")).alias("markets"), F.slice(F.array_sort(F.collect_set(F.lower("tag"))), 1, 5).alias("tags"), F.min_by("stage", F.element_at(ranks, F.col("stage"))).alias("stage"), F.array_sort(F.collect_set("url")).alias("sources"))
    out = rest.join(specs, ["company_id", "name"], "left").withColumn("specs", F.coalesce("specs", F.create_map().cast("map<string,string>")))
    return out.withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy("name"))).where(F.col("rn") <= most).drop("rn")


#: Kinds of page that a company's name is taken from, in order.
NAMING = ("about", "home", "product", "docs")


def company_profile(facts):
    """Per company its name, from the best kind of page, other spellings as aliases, shortest website, three tags, six sources."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, NAMING)), F.lower("page_type")), F.lit(0))
    rank = F.when(place > 0, place).otherwise(len(NAMING) + 1)
    out = facts.groupBy("company_id").agg(
        F.min(F.struct(rank, "url", "name"))["name"].alias("name"), F.array_sort(F.collect_set("name")).alias("names"), F.min(F.struct(F.length("url"), "url"))["url"].alias("website"),
        F.slice(F.array_sort(F.collect_set(F.lower("tag"))), 1, 3).alias("tags"), F.slice(F.array_sort(F.collect_set("url")), 1, 6).alias("sources"),
    )
    return out.select("company_id", "name", F.array_remove("names", F.col("name")).alias("aliases"), "website", "tags", "sources")


def consolidate_products(facts, most: int = 20):
    """One row for each product of a company: union of markets, five tags, the most conservative stage, all sources."""
    ranks = F.create_map(*[F.lit(x) for pair in STAGE_RANK.items() for x in pair])
    label, value = F.trim(F.split_part("bullet", F.lit(":"), F.lit(1))), F.trim(F.regexp_extract("bullet", "(?s)^[^:]*:(.*)$", 1))  # the value may hold more colons
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    out = facts.groupBy("company_id", "name").agg(
        joined(F.collect_set("market")).alias("markets"), joined(F.slice(F.array_sort(F.collect_set(F.lower("tag"))), 1, 5)).alias("tags"), F.min_by("stage", F.element_at(ranks, F.col("stage"))).alias("stage"),
        F.count_distinct("url").alias("sources"), joined(F.collect_set(F.concat(label, F.lit("="), value))).alias("specs"),
    )
    return out.withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy("name"))).where(F.col("rn") <= most).drop("rn")


def consolidate_company(facts):
    """Per company the shortest website, three tags and six sources."""
    joined = lambda c, n: F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, n), ",")
    return facts.groupBy("company_id").agg(F.min(F.struct(F.length("url"), "url"))["url"].alias("website"), joined("tag", 3).alias("tags"), joined("url", 6).alias("sources"))
