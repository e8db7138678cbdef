"""Text, version, stage and token rules as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.urls import has_any

# Spellings that normalised names must have.
ACRONYMS = {"api": "API", "sdk": "SDK", "sso": "SSO", "saml": "SAML", "oauth": "OAuth", "ai": "AI", "ml": "ML", "ui": "UI", "ux": "UX"}
TIERS = "Pro|Professional|Enterprise|Business|Premium|Plus|Lite|Basic|Standard|Free"
VERSION = r"(?i)^(.+?)\s+v?(\d+\.\d+(?:\.\d+)?)\s*$"
MAJOR = r"(?i)^(.+?)\s+(v\d+)\s*$"
TIER = rf"(?i)^(.+?)\s+({TIERS})\s*$"


def normalize_text(text: Column) -> Column:
    """Lower case, single blanks, only word characters and + # . / -, then known acronyms; '' for null."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")), r"(?U)[^\w\s+#./\-]", "")
    names = F.create_map(*[F.lit(x) for pair in ACRONYMS.items() for x in pair])
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(names, w), w)), " ")


def _cut(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(F.trim(text), pattern, group)
    return F.when(found != "", found)


def version_of(name: Column) -> Column:
    return F.coalesce(_cut(name, VERSION, 2), _cut(name, MAJOR, 2))


def without_version(name: Column) -> Column:
    return F.coalesce(_cut(name, VERSION, 1), _cut(name, MAJOR, 1), name)


def tier_of(name: Column) -> Column:
    return F.lower(_cut(name, TIER, 2))


def without_tier(name: Column) -> Column:
    return F.coalesce(_cut(name, TIER, 1), name)


def stage(text: Column) -> Column:
    """The lenient policy: free text to a stage, alpha by default."""
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    rules = (("alpha", ["alpha"]), ("beta", ["beta"]), ("ga", ["ga", "general availability", "released"]), ("discontinued", ["discontinued", "eol", "end of life"]), ("deprecated", ["deprecated"]), ("beta", ["pre-order", "preorder"]))
    return _first_rule(t, rules, "alpha")


def strict_stage(text: Column) -> Column:
    """The allow-list policy: anything unknown is ga."""
    t = F.lower(text)
    return F.when(t.isin("alpha", "beta", "ga", "discontinued"), t).otherwise("ga")


def maturity(text: Column) -> Column:
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    rules = tuple((m, [m]) for m in ("basic", "intermediate", "advanced", "expert")) + (("ga", ["ga", "general availability", "released"]),)
    return _first_rule(t, rules, "basic")


def _first_rule(t: Column, rules, default: str) -> Column:
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(has_any(t, words), name).otherwise(out)
    return out


def token_estimate(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.floor(F.length(t) / 4 * F.when(t.rlike(r"[{\[]"), 1.2).otherwise(1.0)).cast("int")


def truncate_tokens(text: Column, most: int) -> Column:
    """At most so many estimated tokens: cut after the last sentence end beyond 80 % of the room, else with '...'."""
    room = int(most * 4 * 0.9)
    head = F.left(text, F.lit(room))
    end = F.length(head) - F.instr(F.reverse(head), ".") + 1
    cut = F.when(F.contains(head, F.lit(".")) & (end - 1 > room * 0.8), F.left(head, end)).otherwise(F.concat(head, F.lit("...")))
    return F.when(token_estimate(text) <= most, text).otherwise(cut)


def stable_id(prefix: str, *parts: Column) -> Column:
    """A prefix and twelve hexadecimal digits that depend on the parts only."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(12)))


def rescaled_score(score: Column) -> Column:
    """Above 1 means a scale to 100; what is then outside 0 to 1 is null."""
    s = F.when(score > 1, score / 100).otherwise(score)
    return F.when((s >= 0) & (s <= 1), s)


def specs_as_text(specs: Column) -> Column:
    """map of values to map of struct(type='text', value); null values drop out."""
    return F.transform_values(F.map_filter(specs, lambda _, v: v.isNotNull()), lambda _, v: F.struct(F.lit("text").alias("type"), v.cast("string").alias("value")))


def union_ci(arrays: Column) -> Column:
    """Union of an array of arrays of strings without regard to case; the first spelling stays."""
    return F.aggregate(F.flatten(arrays), F.array().cast("array<string>"), lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.array_append(seen, x)))


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def outcome_summary(df: DataFrame, outcome: Column, by: list[str] | None = None) -> DataFrame:
    """Rows for each outcome of a rule, by further columns."""
    return df.withColumn("outcome", outcome).groupBy(*(by or []), "outcome").agg(F.count("*").alias("n"))
