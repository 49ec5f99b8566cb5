"""Streams against the batch forms, at several cuts of the events, with a stop and a new start between."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assay.operators import coordination
from assay.streaming import guard

START = datetime(2024, 1, 1)
END = START + timedelta(days=4000)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def in_two_runs(spark, schema, batches, last, make, top):
    """The rows of a stream over one file per batch; the query is stopped half way. The last file ends the watermark's wait."""
    half = len(batches) // 2
    for i, rows in enumerate([*batches, [last]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
        if i in (half, len(batches)):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
            found = guard.run_available(make(stream), f"{top}/out")
    return found


@pytest.mark.parametrize("cut", [1, 4])
def test_guard(spark, tmp_path, few_partitions, cut):
    rng = random.Random(cut)
    states = ["a", "a", "a", "a", "b", None]
    rows = [(f"s{rng.randrange(4)}", START + timedelta(seconds=i // 2), i, rng.choice(states)) for i in range(120)]
    rows += [("long", START + timedelta(seconds=i, microseconds=i), 1000 + i, "same") for i in range(60)]
    schema = "session string, ts timestamp, seq long, s string"
    rows.sort(key=lambda r: r[1])
    # neighbours within the delay change places, so order inside and between batches is broken
    for i in range(0, len(rows) - 8, 8):
        rows[i : i + 8] = rng.sample(rows[i : i + 8], 8)
    size = -(-len(rows) // cut)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    found = in_two_runs(spark, schema, batches, ("end", END, 0, "x"), lambda s: guard.block_runs(s, "session", "ts", "seq", F.col("s"), "10 seconds"), tmp_path)
    batch = coordination.block_runs(spark.createDataFrame(rows, schema).withColumn("of", F.struct("ts", "seq")), "session", "of", F.col("s")).withColumn("seq", F.col("of.seq"))
    columns = ["session", "seq", "state", "blocks", "released"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.select(columns).collect()), key=key) == sorted(map(tuple, batch.select(columns).collect()), key=key)
    assert found.filter("released").count() >= 60 - coordination.RELEASE_AFTER


def test_fold(spark, tmp_path, few_partitions):
    rng = random.Random(9)
    rows, n = [], 0
    for seq in range(9):
        for w in range(5):
            action = ["open", "start", "start", "seal", "return", "return"][seq] if seq < 6 and rng.random() < 0.9 else rng.choice(["open", "start", "seal", "return", "abandon", "odd"])
            leaf = "a" if seq in (1, 4) else "b"
            n += 1
            rows.append((f"w{w}", seq, action, ["a", "b"] if action == "open" else None, leaf, f"h{seq % 4}", "no time", START + timedelta(seconds=n)))
    schema = coordination.EVENT + ", ts timestamp"
    batches = [rows[:7], rows[7:8], rows[8:30], rows[30:]]
    found = in_two_runs(spark, schema, batches, ("end", 0, "odd", None, None, None, None, END), lambda s: guard.fold_waves(s, "ts", "1 second"), tmp_path)
    batch = coordination.fold_waves(spark.createDataFrame(rows, schema))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.select(batch.columns).collect()), key=key) == sorted(map(tuple, batch.collect()), key=key)


def test_state_store_is_put_back(spark):
    before = spark.conf.get(guard.PROVIDER, None)
    with guard.state_store(spark):
        assert spark.conf.get(guard.PROVIDER) == guard.ROCKS
    assert spark.conf.get(guard.PROVIDER, None) == before


def test_a_key_waits_with_one_call_to_the_store():
    """However many rows of a key come together."""
    from unittest.mock import MagicMock

    from pyspark.sql import Row

    processor = guard.Guard()
    processor.init(MagicMock())
    processor.held, rows = MagicMock(), [Row(at=1000 * n, seq=n, state="a") for n in range(5)]
    assert list(processor.handleInputRows(("s",), iter(rows), None)) == []
    assert [c[0] for c in processor.held.method_calls] == ["appendList"]
    assert processor.held.appendList.call_args[0][0] == [(1000 * n, n, "a") for n in range(5)]
    processor.handle.registerTimer.assert_called_once_with(4)
