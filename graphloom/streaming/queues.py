"""Queues of work and of saves as streams with state: a key is busy until it is done or its time is up.

Both read rows ``(key, id, done, at)`` in the order of ``at`` within a trigger. State is one small
row for each busy key, and a timer ends a key whose ``done`` never comes. The stream
needs a state store that keeps timers; :func:`use_rocksdb` names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.session import reach_workers

#: Fixed value: how long a task may take, in seconds.
LIMIT = 360
STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB from now on, as state with timers needs it."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """A trigger's rows of one key by time; of one time, what is done comes first."""
    own = pd.concat(list(rows))
    own = own.assign(later=~own["done"].astype(bool)).sort_values(["millis", "later", "id"], kind="stable")
    return zip(own["id"], own["done"].astype(bool), own["millis"].tolist())


class _Busy(StatefulProcessor):
    """What is at work for a key, and until when."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "id string, until long")
        self.pending = handle.getValueState("pending", "id string")

    def begin(self, task: str, millis: int) -> None:
        self.stop()
        until = millis + self.seconds * 1000
        self.running.update((task, until))
        self.handle.registerTimer(until)

    def stop(self) -> None:
        if self.running.exists():
            self.handle.deleteTimer(self.running.get()[1])
            self.running.clear()

    def lapsed(self, millis: int) -> bool:
        """Whether the key's time was up before this row, which may come in the same trigger."""
        return self.running.exists() and self.running.get()[1] <= millis

    def close(self) -> None:
        pass


class Tasks(_Busy):
    """A task is taken if its key is not busy; else the id of the one at work is given back."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for task, done, millis in _in_order(rows):
            if self.lapsed(millis):
                self.stop()
            if done:
                self.stop()
            elif self.running.exists():
                out.append((key[0], task, False, self.running.get()[0], millis))
            else:
                self.begin(task, millis)
                out.append((key[0], task, True, task, millis))
        yield pd.DataFrame(out, columns=["key", "id", "taken", "serving", "millis"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.running.exists() and self.running.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.running.clear()
        yield pd.DataFrame([], columns=["key", "id", "taken", "serving", "millis"])


class Saves(_Busy):
    """A save begins if none runs for its key; else it waits, in place of the one that waited before it."""

    def follow(self, key, millis: int, out: list) -> None:
        """The save that ran is over: the one that waits begins, or the key is drained."""
        self.stop()
        if self.pending.exists():
            (save,) = self.pending.get()
            self.pending.clear()
            self.begin(save, millis)
            out.append((key[0], save, "begins", millis))
        else:
            out.append((key[0], None, "drained", millis))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list = []
        for save, done, millis in _in_order(rows):
            while self.lapsed(millis):
                self.follow(key, self.running.get()[1], out)
            if done:
                if self.running.exists():
                    self.follow(key, millis, out)
            elif self.running.exists():
                self.pending.update((save,))
            else:
                self.begin(save, millis)
                out.append((key[0], save, "begins", millis))
        yield pd.DataFrame(out, columns=["key", "id", "what", "millis"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        if self.lapsed(expiredTimerInfo.getExpiryTimeInMs()):
            self.follow(key, self.running.get()[1], out)
        yield pd.DataFrame(out, columns=["key", "id", "what", "millis"])


def _stateful(events: DataFrame, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    reach_workers(events.sparkSession)
    # timers count milliseconds since 1970, whatever zone the session has
    rows = events.where("key is not null and at is not null").select("key", "id", "done", "at", F.unix_millis("at").alias("millis")).withWatermark("at", late)
    found = rows.groupBy("key").transformWithStateInPandas(processor, f"{schema}, millis long", "Append", "EventTime")
    return found.withColumn("at", F.timestamp_millis("millis")).drop("millis")


def take_tasks(events: DataFrame, seconds: int = LIMIT, late: str = "0 seconds") -> DataFrame:
    """``(key, id, taken, serving, at)`` of every task of a stream ``(key, id, done, at)``.

    A task is taken unless one of its key is at work; then ``serving`` is that one's id. A row with ``done`` frees its
    key, and so does the passing of ``seconds``, by the watermark or by a later row of the key. Null keys are never deduplicated and are left out.
    """
    return _stateful(events, Tasks(seconds), "key string, id string, taken boolean, serving string", late)


def run_saves(events: DataFrame, seconds: int = LIMIT, late: str = "0 seconds") -> DataFrame:
    """``(key, id, what, at)``: which saves of a stream ``(key, id, done, at)`` begin, and when a key is drained.

    One save of a key runs at a time; of those that wait only the latest is kept. A row with ``done`` ends the
    running one, and so does the passing of ``seconds``, so that a save that waits is never lost.
    """
    return _stateful(events, Saves(seconds), "key string, id string, what string", late)
