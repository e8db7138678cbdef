"""Constraints on entity tables: violations as rows, or an error where they must not occur.

A rule set names the fields of an entity and what each must be. The walker knows the schema of the table, so what the
types settle costs nothing at run time: only enumerations, URLs, date-times, nulls and nested elements are looked at, in
one pass over the rows and without a shuffle. Paths go down into elements: aliases[2], specs.weight.value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The rules of the entities.
STAGES = ("alpha", "beta", "ga", "discontinued", "deprecated")
COMPANY_STATUS = ("active", "dormant")
MATURITIES = ("basic", "intermediate", "advanced", "expert", "ga")
METHODS = ("measured", "reported", "inferred")
SIGNAL_TYPES = ("news", "job", "paper", "funding", "release", "social")
IMPACTS = ("-2", "-1", "0", "1", "2")
CREDIBILITY = ("low", "medium", "high")
SPEC_TYPES = ("text", "number", "boolean", "enum", "range", "array", "url")

URL = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^\s/?#]+\S*|[^\s/]\S*)$"
DATE_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?Z$"


@dataclass(frozen=True)
class Rule:
    """What a field must be; optional: it may be missing or null; blank: an empty text counts as null."""

    kind: str
    optional: bool = False
    values: tuple = ()
    of: dict = field(default_factory=dict)
    blank: bool = False
    low: float | None = None
    high: float | None = None


def text(**k) -> Rule:
    return Rule("string", **k)


def enum(values, **k) -> Rule:
    return Rule("enum", values=tuple(values), **k)


def url(**k) -> Rule:
    return Rule("url", **k)


def moment(**k) -> Rule:
    return Rule("date-time", **k)


def number(**k) -> Rule:
    return Rule("number", **k)


def texts(**k) -> Rule:
    return Rule("strings", **k)


RULES: dict[str, dict[str, Rule]] = {
    "company": {"id": text(), "name": text(), "aliases": texts(), "hq_country": text(optional=True), "website": url(optional=True), "status": enum(COMPANY_STATUS), "tags": texts(), "logo_url": text(optional=True), "is_self": Rule("boolean", optional=True)},
    "company_summary": {"company_id": text(), "one_liner": text(), "founded_year": number(optional=True), "hq_city": text(optional=True), "employees": text(optional=True), "footprint": text(optional=True), "sites": texts(optional=True), "sources": texts()},
    "product": {
        "id": text(), "company_id": text(), "name": text(), "category": text(), "stage": enum(STAGES), "markets": texts(), "tags": texts(), "short_desc": text(optional=True), "product_url": url(optional=True, blank=True), "docs_url": url(optional=True, blank=True),
        "media": Rule("object", optional=True, of={"hero": text(optional=True), "video": text(optional=True)}), "spec_profile": text(optional=True), "specs": Rule("specs", optional=True), "released_at": moment(optional=True), "eol_at": moment(optional=True), "compliance": texts(optional=True),
    },
    "capability": {"id": text(), "name": text(), "definition": text(optional=True), "tags": texts()},
    "product_capability": {"id": text(), "product_id": text(), "capability_id": text(), "maturity": enum(MATURITIES), "details": text(optional=True), "metrics": Rule("map", optional=True), "observed_at": moment(optional=True), "source_id": text(optional=True), "method": enum(METHODS, optional=True)},
    "signal": {"id": text(), "type": enum(SIGNAL_TYPES), "headline": text(), "summary": text(optional=True), "published_at": moment(), "url": url(), "company_ids": texts(), "product_ids": texts(), "capability_ids": texts(), "impact": enum(IMPACTS), "source_id": text(optional=True)},
    "source": {"id": text(), "origin": text(), "author": text(optional=True), "retrieved_at": moment(optional=True), "credibility": enum(CREDIBILITY, optional=True)},
    "page": {"score": number(low=0, high=1), "primary_category": Rule("filled")},
}

FITS = {
    "string": (T.StringType,), "enum": (T.StringType,), "url": (T.StringType,), "filled": (T.StringType,), "date-time": (T.StringType, T.TimestampType, T.TimestampNTZType), "number": (T.NumericType,), "boolean": (T.BooleanType,),
    "strings": (T.ArrayType,), "object": (T.StructType,), "specs": (T.MapType,), "map": (T.MapType,),
}
FOUND = "array<struct<path:string,message:string>>"


def _one(path: Column, said: str, bad: Column) -> Column:
    """An array of one violation where bad is true, else an empty one."""
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(said).alias("message")))).otherwise(F.array().cast(FOUND))


def _each(values: Column, found) -> Column:
    """The violations of all elements of an array; a null array has none."""
    return F.coalesce(F.flatten(F.transform(values, found)), F.array().cast(FOUND))


def _value(value: Column, kind: T.DataType, path: Column, rule: Rule) -> list[Column]:
    """The violations of a value that is there."""
    if not isinstance(kind, FITS[rule.kind]):
        return [_one(path, f"expected {rule.kind}", value.isNotNull())]
    if rule.kind == "enum":
        return [_one(path, "not in enum", ~value.isin(*rule.values))]
    if rule.kind == "filled":
        return [_one(path, "blank", F.trim(value) == "")]
    if rule.kind == "number" and rule.low is not None:
        return [_one(path, "out of range", ~value.between(rule.low, rule.high))]
    if rule.kind == "url":
        return [_one(path, "not a URL", ~value.rlike(URL) & ((value != "") if rule.blank else F.lit(True)))]
    if rule.kind == "date-time" and isinstance(kind, T.StringType):
        return [_one(path, "not a date-time", value.isNotNull() & (~value.rlike(DATE_TIME) | F.try_to_timestamp(value).isNull()))]
    if rule.kind == "strings":
        inner = kind.elementType
        if not isinstance(inner, T.StringType):
            return [_each(value, lambda x, i: _one(F.concat(path, F.lit("["), i, F.lit("]")), "expected string", F.lit(True)))]
        return [_each(value, lambda x, i: _one(F.concat(path, F.lit("["), i, F.lit("]")), "expected string", x.isNull()))]
    if rule.kind == "object":
        return _fields(value, kind, path, rule.of)
    if rule.kind == "specs":
        return [_each(F.map_entries(value), lambda e: F.concat(*_spec(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"]))))]
    return []


def _spec(spec: Column, kind: T.DataType, path: Column) -> list[Column]:
    """A tagged value: a struct of a type and the fields that this type needs, all as text or numbers, or a variant."""
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    if isinstance(kind, T.VariantType):
        tag = F.try_variant_get(spec, "$.type", "string")
        held = {n: F.try_variant_get(spec, f"$.{n}", "variant") for n in ("value", "min", "max", "unit")}
        type_of = lambda n: F.coalesce(F.regexp_extract(F.schema_of_variant(held[n]), r"^[A-Z]+", 0), F.lit("VOID"))
        is_text, is_number, is_flag = (lambda n: type_of(n) == "STRING"), (lambda n: type_of(n).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")), (lambda n: type_of(n) == "BOOLEAN")
        value_text = F.try_variant_get(spec, "$.value", "string")
        is_list = lambda n: type_of(n) == "ARRAY"
    else:
        names = kind.fieldNames() if isinstance(kind, T.StructType) else []
        has = lambda n: spec[n].isNotNull() if n in names else F.lit(False)
        tag = spec["type"] if "type" in names else F.lit(None).cast("string")
        is_text = is_flag = is_list = has
        is_number = lambda n: F.coalesce(spec[n].try_cast("double").isNotNull(), F.lit(False)) if n in names else F.lit(False)
        value_text = spec["value"].cast("string") if "value" in names else F.lit(None).cast("string")
    known = F.coalesce(tag.isin(*SPEC_TYPES), F.lit(False))
    wants = lambda types, name, said, ok: _one(at(name), said, tag.isin(*types) & ~ok)
    return [
        _one(at("type"), "not in enum", ~known), wants(("text", "enum", "url"), "value", "expected string", is_text("value")), wants(("number",), "value", "expected number", is_number("value")), wants(("boolean",), "value", "expected boolean", is_flag("value")),
        wants(("array",), "value", "expected array", is_list("value")), wants(("range",), "min", "expected number", is_number("min")), wants(("range",), "max", "expected number", is_number("max")), _one(at("value"), "not a URL", (tag == "url") & ~value_text.rlike(URL)),
    ]


def _fields(parent: Column | None, schema: T.StructType, prefix: Column | None, rules: dict[str, Rule]) -> list[Column]:
    types, out = {f.name: f.dataType for f in schema}, []
    for name, rule in rules.items():
        path = F.lit(name) if prefix is None else F.concat(prefix, F.lit(f".{name}"))
        there = F.lit(True) if parent is None else parent.isNotNull()
        if name not in types:
            out += [] if rule.optional else [_one(path, "required", there)]
            continue
        value = F.col(name) if parent is None else parent[name]
        if not rule.optional:
            out.append(_one(path, "required", there & value.isNull()))
        out += _value(value, types[name], path, rule)
    return out


def check(df: DataFrame, entity: str, strict: bool = False, key: str = "id", rules: dict[str, Rule] | None = None) -> DataFrame:
    """(entity, id, path, message) for each broken rule; strict raises if there is any."""
    broken = F.flatten(F.array(*_fields(None, df.schema, None, rules or RULES[entity])))
    out = df.select(F.lit(entity).alias("entity"), F.col(key).alias("id"), F.inline(broken))
    if strict and not out.isEmpty():
        raise ValueError(f"{entity}: {out.first()}")
    return out


def check_unique(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
