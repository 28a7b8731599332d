"""Streams with timers against what batches give, for shuffled arrivals and after restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import windows as W
from tallyloom.streaming.timers import expiry_notices, restocks_by_time

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run(spark, made, where, name):
    """Everything that is there so far, from the checkpoint on; the rows told in all runs."""
    q = made.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in spark.read.schema(made.schema).parquet(f"{where}/out").collect())


def test_turns_of_shuffled_arrivals_are_those_of_the_batch(rocks, tmp_path):
    rng = random.Random(12)
    turns = [(rng.randrange(5), at(seq // 2), seq, rng.random() < 0.5) for seq in range(120)]
    schema = "offer long, ts timestamp, seq long, available boolean"
    parts = [turns[30 * i : 30 * i + 30] for i in range(4)]
    late = [parts[i].pop(rng.randrange(20)) for i in range(3)]  # some come a batch later
    for i, one in enumerate(late):
        parts[i + 1].append(one)
    parts[3].append((99, at(10_000), 999, False))  # the watermark passes all others
    want = {tuple(r) for r in W.transitions(rocks.createDataFrame(turns, schema), ["offer"], ["ts", "seq"], F.col("available")).select("offer", "seq").collect()}
    stream = lambda: restocks_by_time(rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "60 minutes")
    for i, part in enumerate(parts):
        rng.shuffle(part)
        rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i % 2:  # a restart between the halves
            got = run(rocks, stream(), tmp_path, f"turns{i}")
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_codes_are_told_once_and_ends_move(rocks, tmp_path):
    schema = "code string, ts timestamp, seq long, ends timestamp"
    batches = [
        [("a", at(0), 1, at(100)), ("b", at(0), 2, at(100)), ("c", at(1), 3, at(5000))],
        [("b", at(30), 4, at(400)), ("b", at(20), 5, at(90))],  # the later word counts, not the later arrival
        [("x", at(200), 6, at(9000))],  # a is near its end
        [("a", at(210), 7, at(9999)), ("x", at(500), 8, at(9000))],  # a was told already; b is near
    ]
    told = []
    for i, batch in enumerate(batches):
        rocks.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        told.append([r[0] for r in run(rocks, expiry_notices(stream, dt.timedelta(minutes=30)), tmp_path, f"told{i}")])
    assert told == [[], [], ["a"], ["a", "b"]]
