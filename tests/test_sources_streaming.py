import json

from pyspark.sql import functions as F

from marketlens.sources import files
from marketlens.streaming import progress


def test_seed_bundle(spark, tmp_path):
    bundle = {"companies": [{"id": "c1", "name": "A", "isSelf": True}, {"id": "c2", "name": "B"}], "company_summaries": [{"company_id": "c1", "one_liner": "first"}, {"company_id": "c1", "one_liner": "second"}], "signals": [{"id": "s", "published_at": "2024-01-01T00:00:00Z"}]}
    (tmp_path / "seed.json").write_text(json.dumps(bundle))
    t = files.read_seed(spark, str(tmp_path / "seed.json"))
    assert [(r.id, r.status, r.is_self, r.tags) for r in t["companies"].orderBy("id").collect()] == [("c1", "active", True, []), ("c2", "active", False, [])]
    assert [r.one_liner for r in t["company_summaries"].collect()] == ["first"]
    assert t["products"].count() == 0 and t["signals"].first().published_at.isoformat() == "2024-01-01T00:00:00"
    assert {r.table_name: r.n for r in files.load_counts(t).collect()}["companies"] == 2
    files.write_if_empty(t["companies"], str(tmp_path / "out"))
    files.write_if_empty(t["companies"].limit(1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_profiles(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"entities": [{"role": "self", "name": "A", "products": [{"name": "P", "specs": {"w": {"type": "number", "value": 3}}}], "releases": []}]}))
    t = files.read_profiles(spark, str(tmp_path / "p.json"))
    assert t["products"].select("entity", "name", F.variant_get("specs", "$.w.value", "int").alias("w")).first() == ("A", "P", 3)
    assert t["releases"].count() == 0


def test_exports_and_purge(spark, tmp_path):
    pages = spark.createDataFrame([(1, i, i / 10) for i in range(4)] + [(2, 9, 0.1)], "session_id int, id long, score double")
    for c in ("url", "canonical_url", "primary_category", "content_hash"):
        pages = pages.withColumn(c, F.lit("x"))
    pages = pages.withColumns({"status_code": F.lit(200), "depth": F.lit(0), "size_bytes": F.lit(1), "crawled_at": F.lit("t")})
    assert [r.id for r in files.export_crawl(pages, 1, str(tmp_path / "e")).collect()] == [3, 2, 1, 0]
    assert spark.read.json(str(tmp_path / "e")).count() == 4
    sessions = pages.select(F.col("session_id").alias("id")).distinct()
    left, rest, counts = files.purge_sessions(sessions, pages, sessions.where("id = 1"))
    assert (left.count(), rest.count(), counts.first()) == (1, 1, (1, 4))


def replay(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_match_their_batch_forms(spark, sf, tmp_path):
    from marketlens.fixtures import Tables

    events = Tables(spark, sf).progress.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = replay(spark, events, str(tmp_path / "events"))
    got = run(spark, progress.progress_state(stream), "state", "complete", tmp_path)
    assert sorted(map(str, got.collect())) == sorted(map(str, progress.progress_state(events).collect()))
    got = run(spark, progress.progress_metrics_stream(stream), "metrics", "complete", tmp_path)
    assert sorted(map(str, got.collect())) == sorted(map(str, progress.progress_metrics_stream(events).collect()))
    signals = Tables(spark, sf).signals
    got = run(spark, progress.alerts_stream(replay(spark, signals, str(tmp_path / "signals"))), "alerts", "append", tmp_path)
    assert got.count() == progress.alerts_stream(signals).count()
    pages = events.withColumn("url", F.col("event_id") % 20)
    got = run(spark, progress.dedupe_stream(replay(spark, pages, str(tmp_path / "pages"), 1), ["url"], watermark="400 days"), "unique", "append", tmp_path)
    assert got.count() == 20


def test_silent_sessions(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session_id long, kind string, ts timestamp"
    rows = [(1, "page_processed", "2024-01-01 00:00:00"), (2, "session_completed", "2024-01-01 00:00:10")]
    late = [(3, "page_processed", "2024-01-01 01:00:00")]
    for k, part in enumerate((rows, late, [(3, "page_processed", "2024-01-01 01:00:05")])):
        spark.createDataFrame(part, "session_id long, kind string, t string").selectExpr("session_id", "kind", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = progress.stalled_sessions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.session_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1}
