"""Readers and writers at the edges: seed bundles, profiles, stage exports. JSON in, Parquet or JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.storage import Published

SEED = {
    "companies": "id string, name string, aliases array<string>, hqCountry string, website string, status string, tags array<string>, logoUrl string, isSelf boolean",
    "company_summaries": "company_id string, one_liner string, founded_year int, hq_city string, employees string, footprint string, sites array<string>, sources array<string>",
    "products": "id string, company_id string, name string, category string, stage string, markets array<string>, tags array<string>, short_desc string, product_url string, released_at string",
    "capabilities": "id string, name string, definition string, tags array<string>",
    "product_capabilities": "id string, product_id string, capability_id string, maturity string, details string, observed_at string",
    "signals": "id string, type string, headline string, summary string, published_at string, url string, company_ids array<string>, product_ids array<string>, capability_ids array<string>, impact string, source_id string",
    "sources": "id string, origin string, author string, retrieved_at string, credibility string",
}
DEFAULTS = {"status": "active", "isSelf": False}
RENAMED = {"logoUrl": "logo_url", "isSelf": "is_self", "hqCountry": "hq_country"}


def read_seed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The seven tables of a seed bundle; missing arrays become empty, times are UTC."""
    schema = ", ".join(f"{name} array<struct<{', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>>" for name, fields in SEED.items())
    bundle = spark.read.schema(schema).option("multiLine", True).json(path)
    out = {}
    for name in SEED:
        df = bundle.select(F.posexplode(name).alias("pos", "r")).select("pos", "r.*")
        for f in df.schema:
            if f.dataType.typeName() == "array":
                df = df.withColumn(f.name, F.coalesce(f.name, F.array().cast("array<string>")))
            elif f.name in DEFAULTS:
                df = df.withColumn(f.name, F.coalesce(f.name, F.lit(DEFAULTS[f.name])))
            elif f.name.endswith("_at"):
                df = df.withColumn(f.name, F.try_to_timestamp(F.col(f.name)))
        out[name] = df.withColumnsRenamed(RENAMED)
    out["company_summaries"] = first_summaries(out["company_summaries"])
    return {name: df.drop("pos") for name, df in out.items()}


def first_summaries(df: DataFrame) -> DataFrame:
    """The first summary of each company."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy("pos"))).where("rn = 1").drop("rn")


def load_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def write_if_empty(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def read_profiles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Flat tables of a nested profile bundle; specs stay variants."""
    nested = "array<struct<name: string, specs: variant>>"
    schema = f"entities array<struct<role: string, name: string, slug: string, website: string, products: {nested}, signals: array<struct<headline: string, date: string>>, releases: array<struct<name: string, version: string>>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("entities"))
    flat = lambda c: e.select(F.col("name").alias("entity"), F.inline(c))
    return {"entities": e.select("role", "name", "slug", "website"), **{c: flat(c) for c in ("products", "signals", "releases")}}


def latest_exports(files: DataFrame) -> DataFrame:
    """(competitor, stage, file_name): the last file by name of both stages of each competitor; a missing stage skips it."""
    last = files.groupBy("competitor", "stage").agg(F.max("file_name").alias("file_name"))
    both = last.groupBy("competitor").agg(F.count_distinct("stage").alias("stages")).where("stages = 2").select("competitor")
    return last.join(both, "competitor", "left_semi")


#: A stage's folder and, below it, an export: a file, or a folder of part files.
EXPORT = r"/(?:Step|stage=)(2A|2B)/(?:file_name=)?([^/]+)"


def export_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stage, file_name) of the exports below a folder; files are listed, not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return listed.select("path", F.regexp_extract("path", EXPORT, 1).alias("stage"), F.url_decode(F.regexp_extract("path", EXPORT, 2)).alias("file_name")).where("stage <> ''")


def read_latest_exports(spark: SparkSession, folder: str, competitors: DataFrame, schema: str) -> DataFrame:
    """The rows of the newest exports below a folder, with competitor, stage and file_name before the columns of schema.

    For each competitor the last file by name of both stages whose lower-cased name has the competitor's (blanks as _);
    a competitor without one of the stages is left out. Only the files that are chosen are opened: their paths, two for
    each competitor, are what the driver gets.
    """
    files = export_files(spark, folder)
    wanted = competitors.select("competitor").distinct()
    named = files.select("stage", "file_name").distinct().join(F.broadcast(wanted), F.contains(F.lower("file_name"), F.lower(F.replace("competitor", F.lit(" "), F.lit("_")))))
    last = latest_exports(named)
    chosen = last.join(files, ["stage", "file_name"]).select("competitor", "stage", "file_name", "path").distinct()
    paths = sorted({r.path for r in chosen.select("path").collect()})
    if not paths:
        return spark.createDataFrame([], f"competitor string, stage string, file_name string, {schema}")
    rows = spark.read.schema(schema).json(paths)
    data = rows.columns
    return rows.withColumn("path", F.col("_metadata.file_path")).join(F.broadcast(chosen), "path").select("competitor", "stage", "file_name", *data)


def latest_runs(runs: DataFrame, by: str = "started_at") -> DataFrame:
    """(competitor, id) of the last run of each competitor, null times before all others."""
    return runs.groupBy("competitor").agg(F.max_by("id", F.struct(by, "id")).alias("id"))


def export_latest(crawls: DataFrame, pages: DataFrame, prints: DataFrame, fingerprints: DataFrame, extractions: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Exports of the last run of each stage of every competitor: pages of the last crawl and fingerprints of the last
    fingerprint run (runs: id, competitor, started_at; the latter by id), and the last extraction run itself."""
    of = lambda runs, by, name: latest_runs(runs, by).withColumnRenamed("id", name)
    out = {
        "crawl": pages.join(of(crawls, "started_at", "session_id"), "session_id").select("competitor", "session_id", "id", "url", "canonical_url", "primary_category", "score", "content_hash"),
        "fingerprints": fingerprints.drop("competitor").join(of(prints, "id", "fingerprint_session_id"), "fingerprint_session_id").select("competitor", "fingerprint_session_id", "id", "url", "page_type", "content_hash", F.left("extracted_text", F.lit(5000)).alias("extracted_text_preview")),
        "extraction": extractions.join(of(extractions, "started_at", "id").select("id"), "id", "left_semi"),
    }
    if path:
        for name, df in out.items():
            df.write.mode("overwrite").partitionBy("competitor").json(f"{path}/{name}")
    return out


def export_crawl(pages: DataFrame, session_id: int, path: str | None = None) -> DataFrame:
    columns = ["session_id", "url", "canonical_url", "status_code", "primary_category", "score", "depth", "size_bytes", "content_hash", "crawled_at", "id"]
    out = pages.where(F.col("session_id") == session_id).select(*columns).orderBy(F.desc("score"), "id")
    return _written(out, path)


def export_fingerprints(fps: DataFrame, session_id: int, path: str | None = None) -> DataFrame:
    out = fps.where(F.col("fingerprint_session_id") == session_id).select("id", "url", "page_type", "content_hash", "normalized_text_len", F.left("extracted_text", F.lit(5000)).alias("extracted_text_preview"))
    return _written(out.orderBy(F.desc("normalized_text_len"), "id"), path)


def export_session(sessions: DataFrame, session_id: int, path: str | None = None) -> DataFrame:
    out = sessions.where(F.col("id") == session_id)
    if out.isEmpty():
        raise LookupError(f"no such session: {session_id}")
    return _written(out, path)


def _written(df: DataFrame, path: str | None) -> DataFrame:
    if path:
        df.write.mode("overwrite").json(path)
    return df


def stage_audit(responses: DataFrame, path: str | None = None) -> DataFrame:
    out = responses.select("stage", "competitor", "url", F.length("prompt").cast("long").alias("prompt_length"), F.length("response").cast("long").alias("response_size"))
    if path:
        out.write.mode("append").partitionBy("stage").json(path)
    return out


def purge_sessions(sessions: DataFrame, pages: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions left, pages left, counts removed); without ids everything goes. The caller writes to a new path."""
    gone = (sessions.select("id") if ids is None else ids).distinct()
    left = sessions.join(gone, "id", "left_anti")
    pages_left = pages.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_anti")
    counts = sessions.join(gone, "id", "left_semi").agg(F.count("*").alias("sessions_removed")).crossJoin(pages.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_semi").agg(F.count("*").alias("pages_removed")))
    return left, pages_left, counts


def purge(store: Published, ids: DataFrame | None = None) -> DataFrame:
    """Removes runs (id), all without ids, with their pages and the fingerprints of these; one row of counts.

    store publishes the tables sessions, pages (id, session_id) and fingerprints (page_id). What is left is written beside
    it and becomes the next version at once; a failure midway leaves the version before, and readers see either.
    """
    base = store.version()
    sessions, pages, prints = (store.read(n, base) for n in ("sessions", "pages", "fingerprints"))
    gone = (sessions.select("id") if ids is None else ids.select("id")).distinct()
    dead = pages.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_semi").select(F.col("id").alias("page_id")).distinct()
    left = {"sessions": sessions.join(gone, "id", "left_anti"), "pages": pages.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_anti"), "fingerprints": prints.join(dead, "page_id", "left_anti")}
    number = store.publish(left, base)
    per = load_counts({"sessions": sessions, "pages": pages, "fingerprints": prints}).withColumnRenamed("n", "before").join(load_counts({n: store.read(n, number) for n in left}), "table_name")
    return per.select("table_name", (F.col("before") - F.col("n")).alias("removed"), F.col("n").alias("kept"))
