"""Progress events, pages and signals as streams. Every function takes batch or streaming tables alike, where it says so."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketlens.operators.stats import progress_metrics


KINDS = ("page_processed", "page_succeeded", "page_failed", "page_skipped", "session_started")


def progress_state(events: DataFrame) -> DataFrame:
    """Latest value and counters of each session; batch, or a stream in update mode."""
    return events.groupBy("session_id").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.max("ts").alias("last_seen"), F.count("*").alias("events"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS],
    )


def _fields(events: DataFrame) -> DataFrame:
    """One row for each field of each event (session_id, event_id, ts, kind, payload); first marks one row an event."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    return events.select("session_id", F.col("event_id").cast("long").alias("event_id"), at, "kind", F.posexplode_outer("payload").alias("pos", "field", "value")).withColumn("first", F.coalesce(F.col("pos"), F.lit(0)) == 0).drop("pos")


def merged_state(events: DataFrame) -> DataFrame:
    """(session_id, state, kinds, last_seen, events): each field's newest value, by (ts, event_id); a batch table.

    A field that an event doesn't have keeps its value; one that it has as null becomes null.
    """
    rows = _fields(events)
    newest = rows.where("field is not null").groupBy("session_id", "field").agg(F.max_by(F.struct("value"), F.struct("at", "event_id"))["value"].alias("value"))
    state = newest.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("state"))
    per = rows.where("first").groupBy("session_id", "kind").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    counts = per.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"), F.timestamp_micros(F.max("at")).alias("last_seen"), F.sum("n").alias("events"))
    return counts.join(state, "session_id", "left").select("session_id", "state", "kinds", "last_seen", "events")


class MergedState(StatefulProcessor):
    """Fields of a session by name, each with the time of its value; order of arrival doesn't matter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "at long, event_id long, value string")
        self.kinds = handle.getMapState("kinds", "kind string", "n long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            newest = part[part["field"].notna()].sort_values(["at", "event_id"]).drop_duplicates("field", keep="last")
            for field, at, event, value in newest[["field", "at", "event_id", "value"]].itertuples(index=False, name=None):
                old = self.fields.getValue((field,)) if self.fields.containsKey((field,)) else None
                if old is None or (old[0], old[1]) < (at, event):
                    self.fields.updateValue((field,), (int(at), int(event), value))
            for kind, rest in part[part["first"]].groupby("kind"):
                n, at = self.kinds.getValue((kind,)) if self.kinds.containsKey((kind,)) else (0, 0)
                self.kinds.updateValue((kind,), (n + len(rest), max(at, int(rest["at"].max()))))
        state = {k[0]: v[2] for k, v in self.fields.iterator()}
        kinds = {k[0]: tuple(v) for k, v in self.kinds.iterator()}
        out = {"session_id": key[0], "state": json.dumps(state, sort_keys=True), "kinds": json.dumps({k: n for k, (n, _) in kinds.items()}, sort_keys=True), "at": max(at for _, at in kinds.values()), "events": sum(n for n, _ in kinds.values())}
        yield pd.DataFrame([out])

    def close(self) -> None:
        pass


def merged_state_stream(events: DataFrame) -> DataFrame:
    """merged_state() of a stream, in update mode: a row for each session that a batch touches (RocksDB state store)."""
    rows = _fields(events).groupBy("session_id").transformWithStateInPandas(MergedState(), "session_id long, state string, kinds string, at long, events long", "Update", "None")
    return rows.select("session_id", F.from_json("state", "map<string,string>").alias("state"), F.from_json("kinds", "map<string,bigint>").alias("kinds"), F.timestamp_micros("at").alias("last_seen"), "events")


def progress_metrics_stream(events: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Counts of each event-time window; batch, or a stream whose state the watermark bounds."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "page_failed").alias("failed"), F.count_if(F.col("kind") == "page_skipped").alias("skipped"))
    return out.select(F.col("w.start").alias("window_start"), "events", "failed", "skipped")


COUNTED = ("processed", "succeeded", "failed", "skipped")


def _windows(events: DataFrame, window: str) -> DataFrame:
    """Counts of events (session_id, ts, kind, total) by session and window; total is null or the pages of the session."""
    counts = [F.count_if(F.col("kind") == f"page_{c}").alias(c) for c in COUNTED]
    return events.groupBy("session_id", F.window("ts", window).alias("w")).agg(*counts, F.min("ts").alias("first"), F.max("total").alias("total"))


def _rates(rows: DataFrame) -> DataFrame:
    """Pages a minute (processed and failed, since the session's first event) and the seconds that the rest will take."""
    done, elapsed = F.col("processed") + F.col("failed"), (F.unix_micros("window_end") - F.unix_micros("started")) / 1e6
    rated = progress_metrics(rows.withColumns({"done": done, "elapsed": elapsed, "all": F.coalesce("total", F.lit(0)) - F.col("skipped")}), total="all")
    return rated.select("session_id", "window_start", "window_end", *COUNTED, "total", "pages_per_minute", "eta_seconds")


def live_metrics(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """What a session has done by the end of each of its windows, and its rate and remaining time; a batch table."""
    so_far = Window.partitionBy("session_id").orderBy("w.start").rowsBetween(Window.unboundedPreceding, 0)
    rows = _windows(events, window)
    run = rows.select("session_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[F.sum(c).over(so_far).alias(c) for c in COUNTED], F.min("first").over(so_far).alias("started"), F.max("total").over(so_far).alias("total"))
    return _rates(run)


class Totals(StatefulProcessor):
    """Running totals of the closed windows of a session, which come in the order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "processed long, succeeded long, failed long, skipped long, started long, total long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("start")
        old = self.totals.get() if self.totals.exists() else (0, 0, 0, 0, None, None)
        for i, c in enumerate(COUNTED):
            part[c] = part[c].cumsum() + old[i]
        part["started"] = part["first"].cummin() if old[4] is None else part["first"].cummin().clip(upper=old[4])
        known = part["total"].astype("float64").cummax().ffill()
        part["total"] = known if old[5] is None else known.fillna(old[5]).clip(lower=old[5])
        last = part.iloc[-1]
        self.totals.update((*(int(last[c]) for c in COUNTED), int(last["started"]), None if pd.isna(last["total"]) else int(last["total"])))
        out = part[["start", "end", *COUNTED, "started", "total"]].copy()
        out["total"] = out["total"].astype("Int64")
        out.insert(0, "session_id", key[0])
        yield out

    def close(self) -> None:
        pass


def live_metrics_stream(events: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """live_metrics() of a stream, in append mode: windows that the watermark closes go on to the totals of their session.

    Two stateful operators, one behind the other (RocksDB state store).
    """
    closed = _windows(events.withWatermark("ts", watermark), window)
    micros = closed.select("session_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), *COUNTED, F.unix_micros("first").alias("first"), F.col("total").cast("long").alias("total"))
    schema = f"session_id long, start long, end long, {', '.join(f'{c} long' for c in COUNTED)}, started long, total long"
    run = micros.groupBy("session_id").transformWithStateInPandas(Totals(), schema, "Append", "None")
    times = {"window_start": "start", "window_end": "end", "started": "started"}
    return _rates(run.withColumns({new: F.timestamp_micros(old) for new, old in times.items()}))


def session_gaps(events: DataFrame, gap: str = "30 seconds", watermark: str = "1 hour") -> DataFrame:
    """Runs of events without a pause of gap; batch, or a stream."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    out = timed.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("session_id", F.col("w.start").alias("first_seen"), F.col("w.end").alias("silent_from"), "events")


class Heartbeat(StatefulProcessor):
    """One row when a session was silent for some time; a terminal event ends its state."""

    def __init__(self, silence_ms: int = 30_000, terminal: str = "session_completed"):
        self.silence_ms, self.terminal = silence_ms, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ended, last = False, self.last.get()[0] if self.last.exists() else 0
        for part in rows:
            ended |= bool((part["kind"] == self.terminal).any())
            last = max(last, int(part["ts"].max().timestamp() * 1000))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if ended:
            self.last.clear()
        else:
            self.last.update((last,))
            self.handle.registerTimer(last + self.silence_ms)
        yield pd.DataFrame({"session_id": [], "silent_since": []}).astype({"session_id": "int64", "silent_since": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"session_id": [key[0]], "silent_since": [self.last.get()[0]]})
        self.last.clear()

    def close(self) -> None:
        pass


def stalled_sessions(events: DataFrame, silence_ms: int = 30_000, watermark: str = "1 minute") -> DataFrame:
    """Streaming only (needs the RocksDB state store): sessions silent for so long, by event-time timers."""
    timed = events.withWatermark("ts", watermark).groupBy("session_id")
    return timed.transformWithStateInPandas(Heartbeat(silence_ms), "session_id long, silent_since long", "Append", "EventTime")


def dedupe_stream(pages: DataFrame, keys: list[str], time: str = "ts", watermark: str = "1 day") -> DataFrame:
    """The first row of each key; a stream forgets keys when the watermark passes."""
    if pages.isStreaming:
        return pages.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)
    return pages.dropDuplicates(keys)


def alerts_stream(signals: DataFrame, self_id: str = "cmp_self", least: int = 2) -> DataFrame:
    """Signals of high impact, in either direction, that aren't about the own company; batch or stream."""
    return signals.where((F.abs(F.col("impact").cast("int")) >= least) & ~F.array_contains("company_ids", self_id))
