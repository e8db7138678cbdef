"""Stored model responses: parsing, repair, validation, blending and triage. Tolerant forms only, so bad rows never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions import text, urls
from marketlens.operators.pages import penalised

CATEGORIES = ("product", "datasheet", "docs", "pricing", "releases", "news", "other")
REQUIRED = ("primary_category", "score", "confidence", "reasoning")
#: Where the text of a response may be nested, in order.
PATHS = ("$.result.choices[0].message.content", "$.choices[0].message.content", "$.message.content", "$.result.message", "$.data.content", "$.content", "$.text", "$.response", "$.output")
FINAL_ERRORS, PASSING_ERRORS = ("401", "403", "unauthorized", "quota", "rate limit"), ("timeout", "connection", "temporary", "502", "503", "504")
PARSE_ERRORS = ("failed to parse ai response", "no content found in ai response", "missing required field", "parse_error", "empty message content", "empty direct message", "empty direct content", "does not contain valid json", "no recognizable content fields")


def unwrap(raw: Column) -> Column:
    """The text inside a response object, else the text itself."""
    v = F.try_parse_json(raw)
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in PATHS], raw)


def parse_responses(df, column: str = "content"):
    """Adds parsed (variant) and step: which repair worked; rows without one keep null."""
    # One pass each, whatever the text: no nullif, which would evaluate every step for every row ('' is no JSON anyway),
    # and anchors and possessive quantifiers where a search would start anew at every character.
    t = F.col(column)
    fence = F.regexp_extract(t, r"(?s)```(?:json)?+\s*+(.*?)```", 1)
    braces = F.regexp_extract(t, r"(?s)\A[^{]*+(\{.*\})", 1)
    commas = F.regexp_replace(braces, r",\s*+([}\]])", "$1")
    missing = F.regexp_replace(commas, r'(["\d\]}])(?=[^\S\n]*+\n)\s*+"', '$1,\n"')
    last = F.regexp_extract(t, r'(?s)\A.*(\{(?=[^{}]*+\})[^{}]*"(?:score|category|primary_category)"[^{}]*+\})', 1)
    steps = (("strict", t), ("fenced", fence), ("braces", braces), ("trailing_commas", commas), ("missing_commas", missing), ("last_object", last))
    df = df.withColumns({f"p_{name}": F.try_parse_json(c) for name, c in steps})
    step = F.coalesce(*[F.when(F.col(f"p_{name}").isNotNull(), F.lit(name)) for name, _ in steps])
    return df.withColumn("step", step).withColumn("parsed", F.coalesce(*[F.col(f"p_{name}") for name, _ in steps])).drop(*[f"p_{name}" for name, _ in steps])


def split_parsed(df):
    """(good, quarantined) responses."""
    return df.where("parsed is not null"), df.where("parsed is null").drop("parsed")


def coerce_object(v: Column) -> Column:
    """An object as it is, the first object of a list, else null."""
    kind = F.schema_of_variant(v)
    first = F.try_variant_get(v, "$[0]", "variant")
    return F.when(kind.startswith("OBJECT"), v).when(kind.startswith("ARRAY") & F.schema_of_variant(first).startswith("OBJECT"), first)


def validate_scores(df):
    """Adds category, score, confidence, valid, reasoning, secondary_categories and signals of parsed responses.

    Any failure gives other, 0.1, 0.0 and the signal parse_error; lists that a response doesn't have are empty.
    """
    v = coerce_object(F.col("parsed"))
    of = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    raw = F.coalesce(of("primary_category", "string"), of("category", "string"))
    score, sure = text.rescaled_score(of("score", "double")), of("confidence", "double")
    ok = raw.isNotNull() & score.isNotNull() & sure.between(0, 1) & of("reasoning", "string").isNotNull()
    df = df.withColumns({"valid": F.coalesce(ok, F.lit(False)), "raw_category": raw, "raw_score": score, "raw_confidence": sure})
    known = F.lower("raw_category").isin(*CATEGORIES)
    none = F.array().cast("array<string>")
    listed = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), none)
    df = df.withColumns({
        "reasoning": F.when(F.col("valid"), of("reasoning", "string")).otherwise("Failed to parse AI response"),
        "secondary_categories": F.when(F.col("valid"), listed("secondary_categories")).otherwise(none),
        "signals": F.when(F.col("valid"), listed("signals")).otherwise(F.array(F.lit("parse_error"))),
    })
    return df.withColumns({
        "category": F.when(F.col("valid") & known, F.lower("raw_category")).otherwise("other"),
        "score": F.when(F.col("valid"), F.col("raw_score")).otherwise(0.1),
        "confidence": F.when(F.col("valid"), F.col("raw_confidence")).otherwise(0.0),
    }).drop("raw_category", "raw_score", "raw_confidence")


def blend_scores(pages, scores):
    """pages (id, url, depth, rules_score) with the model's score where it is valid and sure enough, else the rules'."""
    # a condition in the projection: as a filter it would be pushed below, with the parsing in every copy of it
    got = scores.select("id", F.when(F.col("valid") & (F.col("confidence") >= 0.1), F.col("score")).alias("model_score"))
    both = pages.join(got, "id", "left")
    value = F.when(F.col("model_score").isNotNull(), penalised(F.col("model_score"), F.col("url"), F.col("depth"))).otherwise(F.col("rules_score"))
    return both.withColumns({"final_score": value, "method": F.when(F.col("model_score").isNotNull(), "ai").otherwise("rules")}).drop("model_score")


def retryable(error: Column) -> Column:
    e = F.lower(error)
    return ~urls.has_any(e, FINAL_ERRORS) & urls.has_any(e, (*PASSING_ERRORS, *PARSE_ERRORS))


def failure_triage(df):
    return df.withColumn("retry", retryable(F.col("error"))).groupBy("model", "retry").agg(F.count("*").alias("n"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def stage1_split(df):
    """Adds is_valid: an object with products."""
    return df.withColumn("is_valid", F.coalesce(F.try_variant_get(coerce_object(F.col("parsed")), "$.products", "variant").isNotNull(), F.lit(False)))


def split_products(df):
    """(id, product) for each element of products of valid responses."""
    v = F.try_variant_get(coerce_object(F.col("parsed")), "$.products", "array<variant>")
    return df.select("id", F.explode(v).alias("product"))


def flatten_specs(df, id_col: str = "id", specs: str = "specs"):
    """Tagged specification values (a variant object) to rows (id, path, type, value_text, value_num, unit)."""
    entries = F.explode(F.try_variant_get(F.col(specs), "$", "map<string,variant>")).alias("path", "v")
    rows = df.select(F.col(id_col), entries)
    of = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    return rows.select(id_col, "path", of("type", "string").alias("type"), F.coalesce(of("value", "string"), of("url", "string")).alias("value_text"), of("value", "double").alias("value_num"), of("min", "double").alias("value_min"), of("max", "double").alias("value_max"), of("unit", "string").alias("unit"))


def product_tables(df):
    """(products, capabilities) of consolidated responses (id, parsed) whose products are an object by name.

    products (id, name, category, stage, markets, tags, compliance, specs, short_desc, product_url, docs_url, released_at,
    confidence) has defaults where a response has nothing; capabilities (id, product, pos, name, definition, tags,
    category) has one row for each object in a product's list; whatever else stands in the list is left out.
    """
    held = df.select("id", F.try_variant_get(coerce_object(F.col("parsed")), "$.products", "variant").alias("products"))
    each = held.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("products").outer())).where("key is not null").select("id", "key", "value")
    of = lambda v, name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
    some = lambda name: F.nullif(of("value", name), F.lit(""))
    listed = lambda v, name: F.coalesce(of(v, name, "array<string>"), F.array().cast("array<string>"))
    name = F.coalesce(of("value", "name"), F.col("key"))
    specs = F.coalesce(text.specs_as_text(of("value", "specs", "map<string,string>")), F.create_map().cast("map<string,struct<type:string,value:string>>"))
    products = each.select(
        "id", name.alias("name"), F.coalesce(some("category"), F.lit("unknown")).alias("category"), text.strict_stage(of("value", "stage")).alias("stage"), *[listed("value", c).alias(c) for c in ("markets", "tags", "compliance")],
        specs.alias("specs"), *[some(c).alias(c) for c in ("short_desc", "product_url", "docs_url", "released_at")], F.lit(0.90).alias("confidence"),
    )
    rows = each.select("id", name.alias("product"), F.posexplode(of("value", "capabilities", "array<variant>")).alias("pos", "c")).where(F.schema_of_variant("c").startswith("OBJECT"))
    capabilities = rows.select("id", "product", "pos", F.coalesce(of("c", "name"), F.lit("")).alias("name"), F.nullif(of("c", "definition"), F.lit("")).alias("definition"), listed("c", "tags").alias("tags"), F.lit("general").alias("category"))
    return products, capabilities
