"""Streams with keyed state: successive states, replays, order of arrival, and the batch forms as the measure."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import entities
from marketlens.streaming import changes, progress
from tests.test_sources_streaming import run

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def keyed(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


STATE = "entity_type string, entity_id string, n long, created_at timestamp, data map<string,string>"


def states(spark, rows):
    from datetime import datetime, timedelta

    return spark.createDataFrame([("Order", e, n, datetime(2024, 1, 1) + timedelta(hours=n), d) for e, n, d in rows], STATE)


def feed(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def found(spark, path):
    return sorted((r.entity_id, r.previous_n, r.n, sorted((c.field, c.old, c.new, c.type) for c in r.changes)) for r in spark.read.parquet(path).collect())


def test_successive_states_replays_and_restarts(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "ck")}
    first = states(spark, [("a", 1, {"name": "A", "status": "x"}), ("a", 2, {"name": "A", "status": "y"}), ("a", 3, {"name": "A"}), ("b", 1, {"name": "B"}), ("b", 2, {"name": "B"})])
    feed(first, at["in"])

    def go():
        stream = spark.readStream.schema(STATE).parquet(at["in"])
        changes.write_changes(stream, at["out"], at["ck"]).awaitTermination()
        return found(spark, at["out"])

    want = [("a", 1, 2, [("status", "x", "y", "modified")]), ("a", 2, 3, [("status", "y", None, "removed")])]
    assert go() == want
    feed(first, at["in"])  # the same rows once more, in another file
    assert go() == want
    feed(states(spark, [("a", 9, {"name": "A", "price": "1"}), ("b", 0, {"name": "late"}), ("b", 5, {"name": "C"})]), at["in"])
    want += [("a", 3, 9, [("price", None, "1", "added")]), ("b", 2, 5, [("name", "B", "C", "modified")])]
    assert go() == sorted(want) and go() == sorted(want)
    row = spark.read.parquet(at["out"]).where("n = 5").first()
    assert row.summary == "C: 1 field updated" and len(row.change_hash) == 64


def test_state_starts_from_snapshots(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "ck")}
    feed(states(spark, [("a", 5, {"name": "A2"}), ("c", 5, {"name": "new"})]), at["in"])
    known = states(spark, [("a", 1, {"name": "A0"}), ("a", 4, {"name": "A1"}), ("z", 1, {"name": "Z"})])
    changes.write_changes(spark.readStream.schema(STATE).parquet(at["in"]), at["out"], at["ck"], known).awaitTermination()
    assert found(spark, at["out"]) == [("a", 4, 5, [("name", "A1", "A2", "modified")])]


def test_large_numbers_and_many_entities_in_a_batch(spark, tmp_path):
    n = 2**53 + 1  # no double holds it
    rows = states(spark, [(f"e{i}", k, {"name": f"v{k}"}) for i in range(3000) for k in (1, 0)]).withColumn("n", F.col("n") * 2 + n)
    feed(rows, str(tmp_path / "in"))
    query = changes.write_changes(spark.readStream.schema(STATE).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert found(spark, str(tmp_path / "out")) == sorted((f"e{i}", n, n + 2, [("name", "v0", "v1", "modified")]) for i in range(3000))


def test_batches_in_order_give_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"e{rng.randrange(5)}", n, {f: str(rng.randrange(3)) for f in rng.sample(["name", "status", "version", "pricing"], rng.randrange(1, 5))}) for n in range(1, 90)]
    want = entities.history_changes(states(spark, rows))
    for k in range(0, len(rows), 30):
        part = rows[k : k + 30]
        rng.shuffle(part)
        feed(states(spark, part), str(tmp_path / "in"))
        stream = spark.readStream.schema(STATE).parquet(str(tmp_path / "in"))
        changes.write_changes(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    key = lambda r: (r.entity_id, r.previous_n, r.n, r.change_hash, r.summary, [tuple(c) for c in r.changes])
    got = sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(key, want.collect())) and len(got) > 40


EVENT = "session_id long, event_id long, ts timestamp, kind string, payload map<string,string>"


def events(spark, n, sessions=4, seed=1):
    from datetime import datetime, timedelta

    rng, out = random.Random(seed), []
    for i in range(n):
        payload = {f: rng.choice([None, str(rng.randrange(50))]) for f in rng.sample(["page", "reason", "type", "errors"], rng.randrange(0, 4))}
        out.append((rng.randrange(sessions), i, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(40)), rng.choice(progress.KINDS), payload or None))
    return spark.createDataFrame(out, EVENT)


def test_merged_state_does_not_depend_on_the_order_of_arrival(spark, tmp_path):
    df = events(spark, 120)
    want = {r.session_id: (r.state, r.kinds, r.last_seen, r.events) for r in progress.merged_state(df).collect()}
    for seed in (1, 2):
        path = str(tmp_path / f"in{seed}")
        df.orderBy(F.xxhash64("event_id", F.lit(seed))).repartition(5).write.parquet(path)
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
        rows = run(spark, progress.merged_state_stream(stream), f"merged{seed}", "update", tmp_path).collect()
        last = {}
        for r in sorted(rows, key=lambda r: r.events):
            last[r.session_id] = (r.state, r.kinds, r.last_seen, r.events)
        assert last == want and len(rows) > len(want)
    rows = df.collect()
    for s, (state, kinds, _, n) in want.items():
        mine = sorted((r for r in rows if r.session_id == s), key=lambda r: (r.ts, r.event_id))
        merged = {}
        for r in mine:
            merged |= r.payload or {}
        assert state == merged and n == len(mine) == sum(kinds.values())
        assert json.loads(json.dumps(kinds)) == {k: sum(r.kind == k for r in mine) for k in {r.kind for r in mine}}


def test_live_metrics_of_closed_windows(spark, tmp_path):
    df = events(spark, 150).withColumn("total", F.when(F.col("kind") == "session_started", F.lit(60) + F.col("event_id") % 7)).drop("payload")
    want = sorted(map(str, progress.live_metrics(df, "10 minutes").collect()))
    late = spark.range(1).selectExpr("99L session_id", "999L event_id", "timestamp'2024-01-02' ts", "'page_skipped' kind", "cast(null as long) total")
    df.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "a"))
    files = sorted((tmp_path / "a").glob("*.parquet"))
    for f in files:
        feed(spark.read.parquet(str(f)), str(tmp_path / "in"))
    late = late.withColumn("total", F.col("total").cast(df.schema["total"].dataType))
    for _ in range(2):
        feed(late, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, progress.live_metrics_stream(stream, "10 minutes", "1 minute"), "live", "append", tmp_path)
    assert sorted(map(str, got.where("session_id < 99").collect())) == want and len(want) > 12
