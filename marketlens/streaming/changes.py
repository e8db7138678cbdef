"""Changes between successive states of entities, by keyed state: history is never read again.

The operator keeps the last payload of each entity, in buckets of entities. Rows of one batch are taken in the order of (created_at, n), so
states that follow each other inside a batch give their changes; a row that is not newer than the last state is a replay,
or came late, and is dropped, so a batch that is read twice adds nothing. The state starts from stored snapshots where
they are given. The difference itself is computed behind the operator, by the column expressions of the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketlens.operators.entities import change_summary, field_changes, latest_snapshots

KEY = ["entity_type", "entity_id"]
STATE = [*KEY, "at", "n", "data"]
PAIRS = "entity_type string, entity_id string, previous_n long, n long, at long, previous string, data string"
#: Keys of the state; fixed, as stored states are found by them.
BUCKETS = 1024


class LastStates(StatefulProcessor):
    """Pairs of each state with the one before it, a bucket of entities at a time; data are payloads as JSON, at is in microseconds.

    Every call of the state store from Python is a message of its own, and four for each entity were nearly all of the time.
    So a bucket is one key: its entities' last states are a list, read and written whole by a batch that has rows of it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "entity_type string, entity_id string, at long, n long, data string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):
            self.last.appendList(list(initialState[STATE].itertuples(index=False, name=None)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states = pd.concat([part[STATE] for part in rows])
        held = pd.DataFrame([tuple(r) for r in self.last.get()], columns=STATE).astype({"at": "int64", "n": "int64"})
        held, states = held.assign(held=True), states.assign(held=False)
        # the held one stays first of equal ones; what lies before it came late
        both = pd.concat([held, states] if len(held) else [states], ignore_index=True).sort_values([*KEY, "at", "n"], kind="stable").drop_duplicates([*KEY, "at", "n"])
        entity = both.groupby(KEY, dropna=False, sort=False).ngroup()
        late = both["held"].groupby(entity).transform("any") & (both["held"].groupby(entity).cumsum() == 0)
        both, entity = both[~late], entity[~late].to_numpy()
        if both["held"].all():
            return
        after = np.flatnonzero(entity[1:] == entity[:-1]) + 1
        self.last.put(list(both.drop_duplicates(KEY, keep="last")[STATE].itertuples(index=False, name=None)))
        if len(after):
            old, new = both.iloc[after - 1], both.iloc[after].reset_index(drop=True)
            yield new.assign(previous_n=old["n"].to_numpy(), previous=old["data"].to_numpy())[[c.split()[0] for c in PAIRS.split(", ")]]

    def close(self) -> None:
        pass


def _plain(states: DataFrame) -> DataFrame:
    """States as the operator keeps them; the payload's keys in order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries("data")))
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).alias("bucket")
    return states.select(bucket, *KEY, F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.col("n").cast("long").alias("n"), F.to_json(ordered).alias("data"))


def changes(states: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Changes of a stream of states (entity_type, entity_id, n, created_at, data); needs the RocksDB state store.

    (entity_type, entity_id, previous_n, n, created_at, changes, change_hash, summary): the first state of an entity and
    equal states give none. snapshots, a batch table of the same columns, holds the states known before the stream.
    """
    initial = None if snapshots is None else _plain(latest_snapshots(snapshots)).groupBy("bucket")
    pairs = _plain(states).groupBy("bucket").transformWithStateInPandas(LastStates(), PAIRS, "Append", "None", initialState=initial)
    old, new = (F.from_json(c, "map<string,string>") for c in ("previous", "data"))
    found = pairs.withColumn("changes", field_changes(old, new)).where(F.size("changes") > 0)
    return found.select(
        *KEY, "previous_n", "n", F.timestamp_micros("at").alias("created_at"), "changes",
        F.sha2(F.concat_ws(":", *KEY, "previous_n", "n"), 256).alias("change_hash"), change_summary(F.from_json("data", "map<string,string>")["name"], F.col("changes")).alias("summary"),
    )


def write_changes(states: DataFrame, path: str, checkpoint: str, snapshots: DataFrame | None = None):
    """Starts the stream into Parquet files, each change once; it ends when all that is there is read."""
    return changes(states, snapshots).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
