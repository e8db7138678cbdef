"""Entities merged by natural key, with snapshots, changes, sources and a log; and imports into the serving tables.

An upsert puts the stored row of each natural key and all rows that come in behind each other and fills every field
with its last value that is not null: that is what taking the rows one by one would give, so repeated keys make no
further rows. The states are written once; all five outputs are derived from them, and published together or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import text
from marketlens.operators.entities import change_summary, data_hash, field_changes, payload
from marketlens.storage import Published, new_folder

ORDER = ("company", "product", "capability", "release", "document", "signal")
SOURCE = ("url", "content_hash", "page_type", "method", "confidence")
OUTPUTS = ("entities", "snapshots", "changes", "sources", "log")


def matched(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming with the id of the existing entity of its natural key: the least one, null where there is none."""
    ids = existing.where("natural_key is not null").groupBy("natural_key").agg(F.min("id").alias("id"))
    return incoming.join(ids, "natural_key", "left")


def _steps(existing: DataFrame, incoming: DataFrame, fields: list[str], kind: str) -> DataFrame:
    """The state of each entity after each step: its stored row (step 0), then its incoming rows by n."""
    first = F.row_number().over(Window.partitionBy("natural_key").orderBy("id"))
    kept = existing.where("natural_key is not null").withColumn("step", first).where("step = 1")
    old = kept.select("natural_key", "id", F.lit(0).alias("age"), F.lit(None).cast("long").alias("n"), *fields, *[F.lit(None).cast(t).alias(c) for c, t in zip(SOURCE, ("string",) * 4 + ("double",), strict=True)])
    given = {c: (F.col(c) if c in incoming.columns else F.lit(None)).cast("double" if c == "confidence" else "string") for c in SOURCE}
    new = incoming.where("natural_key is not null").select("natural_key", F.lit(None).cast(old.schema["id"].dataType).alias("id"), F.lit(1).alias("age"), F.col("n").cast("long").alias("n"), *fields, *[v.alias(c) for c, v in given.items()])
    by_step = Window.partitionBy("natural_key").orderBy("age", "n")
    so_far, whole = by_step.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("natural_key")
    rows = old.unionByName(new).withColumn("given", F.map_keys(payload(fields)))
    rows = rows.withColumns({"id": F.coalesce(F.max("id").over(whole), text.stable_id("ent_", F.lit(kind), F.col("natural_key"))), "known": F.min("age").over(whole) == 0, **{f: F.last(f, ignorenulls=True).over(so_far) for f in fields}})
    rows = rows.withColumn("data", payload(fields))
    return rows.withColumns({"step": F.row_number().over(by_step), "last": F.row_number().over(Window.partitionBy("natural_key").orderBy(F.desc("age"), F.desc("n"))) == 1, "previous": F.lag("data").over(by_step), "previous_n": F.coalesce(F.lag("n").over(by_step), F.lit(0))})


def upsert(kind: str, existing: DataFrame, incoming: DataFrame, fields: list[str], session_id: int, at: str, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five outputs of merging incoming (natural_key, n, fields, and of SOURCE what is there) into existing (id, natural_key, fields).

    entities: every entity with its id, fields and status (created, updated, unchanged, kept). snapshots: the states that
    are new, each once (stored: snapshots already kept). changes: differences between successive states. sources: one row
    for each entity, URL and content. log: the counts. Incoming rows count in the order of n, which must be unique for a
    key; null values keep what is known; rows without a key are left out. Of several existing rows of a key the first by
    id counts. An entity that is created has the id that its kind and key give, so a repeated run gives the same.
    """
    spark = existing.sparkSession
    folder = new_folder(spark, f"upsert-{kind}")
    _steps(existing, incoming, fields, kind).write.parquet(folder)
    rows = spark.read.parquet(folder)
    stamp, who = F.to_timestamp_ntz(F.lit(at)), [F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id")]
    came = rows.where("age = 1")
    changed = came.where("previous is not null").withColumn("changes", field_changes(F.col("previous"), F.col("data"))).where(F.size("changes") > 0)
    changes = changed.select(*who, "previous_n", "n", "changes", F.transform("changes", lambda c: c["field"]).alias("fields_changed"), F.sha2(F.concat_ws(":", F.lit(kind), "id", "previous_n", "n"), 256).alias("change_hash"), change_summary(F.col("data")["name" if "name" in fields else fields[0]], F.col("changes")).alias("summary"), F.lit(session_id).alias("session_id"), stamp.alias("created_at"))
    moved = F.col("previous").isNull() | ~data_hash(F.col("previous")).eqNullSafe(data_hash(F.col("data")))
    states = came.where(moved).select(*who, "n", "data", data_hash(F.col("data")).alias("data_hash"), F.lit(session_id).alias("session_id"), stamp.alias("created_at"))
    states = states.withColumn("nth", F.row_number().over(Window.partitionBy("entity_id", "data_hash").orderBy("n"))).where("nth = 1").drop("nth")
    if stored is not None:
        states = states.join(stored.where(F.col("entity_type") == kind).select("entity_id", "data_hash").distinct(), ["entity_id", "data_hash"], "left_anti")
    touched = rows.groupBy("natural_key").agg(F.max("age").alias("came"), F.count_if((F.col("age") == 1) & moved & F.col("previous").isNotNull()).alias("moves"))
    status = F.when(F.col("came") == 0, "kept").when(~F.col("known"), "created").when(F.col("moves") > 0, "updated").otherwise("unchanged")
    entities = rows.where("last").join(touched, "natural_key").select("id", "natural_key", *fields, status.alias("status"))
    one = Window.partitionBy("id", "url", "content_hash").orderBy("n")
    sources = came.withColumn("nth", F.row_number().over(one)).where("nth = 1").select(*who, "n", *SOURCE, F.col("given").alias("fields_extracted"), F.lit(session_id).alias("session_id"))
    created = (F.col("step") == 1) & ~F.col("known")
    log = came.agg(F.count("*").alias("processed"), F.count_if(created).alias("created"), F.count_if(~created).alias("updated"), F.count_if(moved & F.col("previous").isNotNull()).alias("changes")).select(F.lit(kind).alias("entity_type"), "*", F.lit(session_id).alias("session_id"))
    return dict(zip(OUTPUTS, (entities, states, changes, sources, log), strict=True))


def upsert_all(tables: dict[str, tuple[DataFrame, DataFrame, list[str]]], parents: dict[str, dict[str, str]], session_id: int, at: str) -> dict[str, dict[str, DataFrame]]:
    """upsert() of each kind (existing, incoming, fields), parents before children.

    parents has the kind of the parent by kind and column; such a column of incoming rows holds the parent's natural key
    and gets the id under which the parent stands in the entities that come out, null where it is in none.
    """
    out: dict[str, dict[str, DataFrame]] = {}
    for kind in sorted(tables, key=lambda k: (ORDER.index(k) if k in ORDER else len(ORDER), k)):
        existing, incoming, fields = tables[kind]
        for column, parent in parents.get(kind, {}).items():
            ids = out[parent]["entities"].select(F.col("natural_key").alias(column), F.col("id").alias("__id"))
            incoming = incoming.join(ids, column, "left").withColumn(column, F.col("__id")).drop("__id")
        out[kind] = upsert(kind, existing, incoming, fields, session_id, at)
    return out


def publish(results: dict[str, dict[str, DataFrame]], path: str) -> int:
    """All outputs of all kinds as one version under path; the number of the version."""
    tables = {f"{kind}_{name}": df for kind, outputs in results.items() for name, df in outputs.items()}
    return Published(next(iter(tables.values())).sparkSession, path).publish(tables)


# --- import into the serving tables -----------------------------------------------------------------------------


def put(existing: DataFrame, incoming: DataFrame, key: list[str], update: list[str], new_id: Column | None = None) -> DataFrame:
    """existing with the rows of incoming (n and the columns of existing, but for its id) taken in the order of n.

    A new key gives one row, from the first row that has it, under new_id; a known one keeps its row (the first by id).
    Either takes the columns of update from the last row of its key, null or not; so a repeated import changes nothing.
    Rows with a null in the key are left out.
    """
    columns = [c for c in existing.columns if c != "id" or new_id is None]
    rows = incoming.dropna(subset=key)
    ends = rows.groupBy(*key).agg(F.min_by(F.struct(*columns), "n").alias("__first"), F.max_by(F.struct(F.lit(1).alias("__"), *update), "n").alias("__last"))
    order = [F.col("id")] if "id" in existing.columns else [F.lit(0)]
    known = existing.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).join(ends, key, "left")
    takes = (F.col("__nth") == 1) & F.col("__last").isNotNull()
    kept = known.select(*[F.when(takes, F.col("__last")[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in existing.columns])
    fresh = ends.join(existing.select(*key).distinct(), key, "left_anti")
    made = {c: F.col("__last")[c] if c in update else F.col("__first")[c] for c in columns} | ({"id": new_id} if new_id is not None else {})
    return kept.unionByName(fresh.select(*[made[c].alias(c) for c in existing.columns]))


def _ids(table: DataFrame, *key: str) -> DataFrame:
    """The first id of each key."""
    return table.dropna(subset=list(key)).groupBy(*key).agg(F.min("id").alias("id"))


def import_serving(serving: dict[str, DataFrame], companies: DataFrame, products: DataFrame, capabilities: DataFrame) -> dict[str, DataFrame]:
    """The five serving tables after an import of consolidated records, in order, with ids handed on.

    companies (n, name, website, hq_country, status, tags, aliases, short_desc, sources) are matched by name and updated;
    their summaries by company and updated; products (n, company, name, category, stage, short_desc, product_url, tags,
    markets) by name and company and updated; capabilities (n, company, product, name, definition, tags, maturity,
    details, source_id, method) by name and never updated; their links to products by both ids and never updated.
    """
    none = F.array().cast("array<string>")
    firms = companies.withColumns({"status": F.coalesce("status", F.lit("active")), "tags": F.coalesce("tags", none), "aliases": F.coalesce("aliases", none)})
    out = {"companies": put(serving["companies"], firms, ["name"], ["website", "hq_country", "status", "tags", "aliases"], text.stable_id("cmp_", F.col("name")))}
    of_firm = _ids(out["companies"], "name").withColumnsRenamed({"name": "company", "id": "company_id"})
    notes = companies.withColumnRenamed("name", "company").join(of_firm, "company").select("n", "company_id", F.coalesce("short_desc", F.lit("")).alias("one_liner"), F.coalesce("sources", none).alias("sources"))
    out["company_summaries"] = put(serving["company_summaries"], notes, ["company_id"], ["one_liner", "sources"])
    goods = products.join(of_firm, "company").withColumns({"stage": text.stage(F.col("stage")), "tags": F.coalesce("tags", none), "markets": F.coalesce("markets", none)})
    out["products"] = put(serving["products"], goods, ["name", "company_id"], ["category", "stage", "short_desc", "product_url", "tags", "markets"], text.stable_id("prd_", F.col("company_id"), F.col("name")))
    skills = capabilities.withColumn("tags", F.coalesce("tags", none))
    out["capabilities"] = put(serving["capabilities"], skills, ["name"], [], text.stable_id("cap_", F.col("name")))
    of_good = _ids(out["products"], "name", "company_id").withColumnsRenamed({"name": "product", "id": "product_id"})
    of_skill = _ids(out["capabilities"], "name").withColumnsRenamed({"id": "capability_id"})
    links = capabilities.join(of_firm, "company").join(of_good, ["product", "company_id"]).join(of_skill, "name")
    links = links.withColumns({"maturity": text.maturity(F.col("maturity")), "details": F.coalesce("details", F.lit("")), "source_id": F.coalesce("source_id", F.lit(""))})
    out["product_capabilities"] = put(serving["product_capabilities"], links, ["product_id", "capability_id"], [], text.stable_id("pc_", F.col("product_id"), F.col("capability_id")))
    return out
