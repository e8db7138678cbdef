"""Extraction rules as tables: a user's own patterns in place of, or beside, the built-in ones.

A rule is a row (pos, name, field, regex, confidence, grp, pick, source, priority): the group grp of regex on the text
that source names gives a value of field; pick is first, longest (of all matches, more than three characters) or found
(whether there is a match). The table is counted, its patterns are compiled once by the driver, so that a wrong one is
named before a job starts, and its rows reach every task as one array. Texts are read once, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import pages

SCHEMA = "pos int, name string, field string, regex string, confidence double, grp int, pick string, source string, priority int"
#: Most rules of a table.
MOST = 1000

# Patterns for further fields of products.
PRODUCT_FIELDS = (
    ("version_pattern", "version", r"(?i)(?:version|v\.?|release)\s*(\d+(?:\.\d+)*(?:\.\d+)*)", 0.9),
    ("feature_list", "features", r"(?im)(?:features?|capabilities?):\s*(.+?)(?:\n\n|\.|$)", 0.7),
    ("tech_specs", "specifications", r"(?im)(?:specifications?|specs?|technical\s+details?):\s*(.+?)(?:\n\n|\.|$)", 0.75),
)


def rules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A table of rules from (name, field, regex, confidence[, grp, pick, source, priority]) rows, in their order."""
    rest = (1, "first", "text", 0)
    return spark.createDataFrame([(i, *row, *rest[len(row) - 4 :]) for i, row in enumerate(rows)], SCHEMA)


def product_rules(spark: SparkSession, fields: bool = False) -> DataFrame:
    """The built-in rules for products; fields: with those for version, features and specifications."""
    names = [(f"name_{i}", "name", pages.ONE_PASS[p][0], c, 1, "longest") for i, (p, c) in enumerate(pages.NAME_PATTERNS)]
    facts = [(n, n, pages.ONE_PASS[p][0], c) for n, p, c in (*pages.PRICE_PATTERNS, *pages.SPEC_PATTERNS)]
    return rules(spark, [*names, *facts, *(PRODUCT_FIELDS if fields else ())])


def release_rules(spark: SparkSession) -> DataFrame:
    changelog = [("changelog_version", "changelog", pages.CHANGELOG, 0.8, 1), ("changelog_entry", "notes", pages.CHANGELOG, 0.8, 2)]
    return rules(spark, [("release_version", "version", pages.RELEASE_VERSION, 0.9), ("release_date", "date", pages.RELEASE_DATE, 0.85), *changelog])


def page_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules of page categories: on URLs, titles and first headings."""
    by_url = [(n, c, p, s, 0, "found", "url", pages.PRIORITY[c]) for n, c, s, p in pages.URL_RULES]
    by_word = [(n, c, "|".join(map(re.escape, words)), s, 0, "found", column, pages.PRIORITY[c]) for n, c, s, column, words in pages.WORD_RULES]
    order = ["product_url", "product_title", "product_h1", "docs_url", "docs_title", "pricing_url", "pricing_title", "releases_url", "releases_title", "news_url", "news_title"]
    return rules(spark, sorted(by_url + by_word, key=lambda r: order.index(r[0])))


def checked(table: DataFrame) -> DataFrame:
    """The table, if its rules are few enough, complete and can be compiled; else an error that names the first bad one."""
    rows = table.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    compiler = table.sparkSession._jvm.java.util.regex.Pattern
    for r in rows:
        if None in (r.pos, r.name, r.field, r.regex, r.confidence) or r.pick not in ("first", "longest", "found"):
            raise ValueError(f"rule {r.name} is not complete")
        try:
            compiler.compile(r.regex)
        except Exception as e:
            raise ValueError(f"the pattern of rule {r.name} can't be compiled") from e
    return table


def hits(docs: DataFrame, table: DataFrame, **sources: Column) -> DataFrame:
    """docs with hits: (pos, name, field, value, confidence, priority) of the rules that match, in their order.

    sources: the text of each source that the rules name; a null one is an empty text.
    """
    listed = checked(table).agg(F.array_sort(F.collect_list(F.struct(*[c.split()[0] for c in SCHEMA.split(", ")]))).alias("__rules"))

    def hit(rule: Column) -> Column:
        t = F.lit("")
        for name, value in sources.items():
            t = F.when(rule["source"] == name, F.coalesce(value, F.lit(""))).otherwise(t)
        found = F.when(rule["pick"] == "found", F.when(F.regexp_like(t, rule["regex"]), F.lit("found")).otherwise(F.lit("")))
        first = F.call_function("regexp_extract", t, rule["regex"], rule["grp"])
        longest = pages.longest(F.regexp_extract_all(t, rule["regex"], rule["grp"]))
        value = found.when(rule["pick"] == "longest", F.when(F.length(longest) > 3, longest).otherwise(F.lit(""))).otherwise(first)
        return F.struct(rule["pos"].alias("pos"), rule["name"].alias("name"), rule["field"].alias("field"), value.alias("value"), rule["confidence"].alias("confidence"), rule["priority"].alias("priority"))

    # one row, so the join adds a column
    both = docs.join(F.broadcast(listed), F.lit(True), "left")
    return both.withColumn("hits", F.filter(F.transform("__rules", hit), lambda h: h["value"] != "")).drop("__rules")


def facts(docs: DataFrame, table: DataFrame, text: str = "text") -> DataFrame:
    """docs with facts (a map of fields to the value of their first rule that matches) and confidence, the mean of those."""
    df = hits(docs, table, text=F.col(text))
    used = F.filter("hits", lambda h: ~F.exists("hits", lambda g: (g["field"] == h["field"]) & (g["pos"] < h["pos"])))
    df = df.withColumn("hits", used)
    total = F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["confidence"])
    return df.withColumns({"facts": F.map_from_entries(F.transform("hits", lambda h: F.struct(h["field"].alias("key"), h["value"].alias("value")))), "confidence": F.when(F.size("hits") > 0, total / F.size("hits")).otherwise(0.0)}).drop("hits")


def release_facts(docs: DataFrame, table: DataFrame) -> DataFrame:
    """version, date, notes and release_name by a table of rules; a changelog entry overrides the version."""
    df = facts(docs, table)
    v, entry, date = (F.col("facts")[k] for k in ("version", "changelog", "date"))
    name = F.when(v.isNotNull(), F.concat(F.lit("Version "), v)).when(F.coalesce(entry, date).isNotNull(), F.concat(F.lit("Release "), F.coalesce(entry, F.lit("Unknown"))))
    return df.withColumns({"version": F.coalesce(entry, v), "date": date, "notes": F.trim(F.col("facts")["notes"]), "release_name": name}).drop("facts")


def classify(df: DataFrame, table: DataFrame) -> DataFrame:
    """Adds category, base_score and signals to pages (url, title, h1) by a table of rules whose fields are categories."""
    df = hits(df, table, url=F.lower("url"), title=F.lower("title"), h1=F.lower("h1"))
    some = F.size("hits") > 0
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["priority"].alias("p"), h["confidence"].alias("s"), h["field"].alias("c"))))
    df = df.withColumn("best", best)
    return df.withColumns({
        "category": F.when(some, F.col("best.c")).otherwise("other"), "base_score": F.when(some, F.least(F.lit(1.0), F.col("best.s") + F.size("hits") * 0.05)).otherwise(0.1),
        "signals": F.when(some, F.transform("hits", lambda h: h["name"])).otherwise(F.array(F.lit("no_classification"))),
    }).drop("best", "hits")
