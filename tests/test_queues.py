"""Streams of tasks and saves: keys that end before and after the watermark."""

import datetime as dt

import pytest

from graphloom.streaming import queues

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(queues.STORE, None)
    queues.use_rocksdb(spark)
    yield
    spark.conf.set(queues.STORE, before) if before else spark.conf.unset(queues.STORE)


def played(spark, tmp_path, make, triggers):
    """Rows that a stream gives after each trigger, which is a list of (key, id, done, second)."""
    schema = "key string, id string, done boolean, at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    found = []
    for rows in triggers:
        spark.createDataFrame([(k, i, d, T0 + dt.timedelta(seconds=s)) for k, i, d, s in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        known = sum(found, [])
        now = [tuple(r) for r in spark.read.parquet(out).collect()]
        for r in known:
            now.remove(r)
        found.append(now)
    return [[(*r[:-1], int((r[-1] - T0).total_seconds())) for r in sorted(rows, key=lambda r: (r[-1], str(r)))] for rows in found]


def test_tasks(spark, tmp_path, rocksdb):
    got = played(spark, tmp_path, lambda s: queues.take_tasks(s, seconds=60), [
        [("k", "a", False, 0), ("k", "b", False, 1), ("m", "x", False, 2)],
        # done before the watermark passes: the key is free at once
        [("k", "a", True, 10), ("k", "c", False, 11), ("k", "d", False, 12)],
        # nobody says that c is done: a later row of the key, and for m the watermark, end it
        [("k", "e", False, 80), ("z", "y", False, 200)],
        [("m", "w", False, 210), ("k", "f", False, 211)],
    ])
    assert got == [
        [("k", "a", True, "a", 0), ("k", "b", False, "a", 1), ("m", "x", True, "x", 2)],
        [("k", "c", True, "c", 11), ("k", "d", False, "c", 12)],
        [("k", "e", True, "e", 80), ("z", "y", True, "y", 200)],
        [("m", "w", True, "w", 210), ("k", "f", True, "f", 211)],
    ]


def test_saves(spark, tmp_path, rocksdb):
    got = played(spark, tmp_path, lambda s: queues.run_saves(s, seconds=60), [
        [("k", "1", False, 0), ("k", "2", False, 1), ("k", "3", False, 2)],
        # the latest that waited begins, then nothing waits
        [("k", None, True, 5), ("k", None, True, 9), ("k", None, True, 10)],
        [("k", "4", False, 20), ("k", "5", False, 21)],
        # the watermark passes the limit of 4, so that 5 begins without any word from the key
        [("z", "9", False, 100)],
        [("z", None, True, 200)],
    ])
    assert got[0] == [("k", "1", "begins", 0)]
    assert got[1] == [("k", "3", "begins", 5), ("k", None, "drained", 9)]
    assert got[2] == [("k", "4", "begins", 20)]
    assert ("z", "9", "begins", 100) in got[3]
    assert [r for rows in got[3:] for r in rows if r[0] == "k"] == [("k", "5", "begins", 80), ("k", None, "drained", 140)]
