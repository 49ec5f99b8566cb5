"""The guard and the wave fold as streams over tables that arrive in slices (T-1, T-4, W13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.config import shared_folder
from assay.plans import ORACLE, query, table
from assay.plans.ledgers import RUNS, wave_events
from assay.streaming import guard

SLICES = 3


def arriving(spark, rows, time, end, label):
    """A stream over ``rows`` that arrive in SLICES by their time, and one row ``end`` that is later than all; the delay, of two
    slices, in which its events are in disorder, however their files meet in micro-batches; and a folder for the results."""
    folder = shared_folder(spark, label)
    lo, hi = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    width = ((hi or 0) - (lo or 0)) // SLICES + 1
    part = F.floor((F.unix_micros(time) - F.lit(lo or 0)) / width)
    for i in range(SLICES):
        rows.filter(part == i).write.mode("append").parquet(folder)
    later = F.timestamp_micros(F.lit((hi or 0) + 10**15))
    end(later).select(rows.columns).coalesce(1).write.mode("append").parquet(folder)
    files = max(1, -(-len(spark.read.parquet(folder).inputFiles()) // (SLICES + 1)))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream, f"{2 * width // 1_000_000 + 1} seconds", shared_folder(spark, f"{label}-out")


@query(RUNS.format(state="case when event_type in ('view', 'click', 'error') then 'a' else 'b' end").replace("order by event_id", "order by ts, event_id").replace("as was from", "as was, ts from"))
def guard_stream(spark, sf_dir):
    """T-4, W13: runs of equal states in the order of time, as the events arrive."""
    state = F.when(F.col("event_type").isin("view", "click", "error"), "a").otherwise("b")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", state.alias("state"))
    end = lambda later: spark.range(1).select(F.lit("").alias("user_id"), later.alias("ts"), F.lit(0).cast("long").alias("event_id"), F.lit("").alias("state"))
    stream, delay, out = arriving(spark, rows, "ts", end, "guard")
    found = guard.run_available(guard.block_runs(stream, "user_id", "ts", "event_id", F.col("state"), delay), out)
    return found.select(F.col("session").cast("long").alias("user_id"), F.col("seq").alias("event_id"), "state", "blocks", "released")


@query(ORACLE["dispatch_lifecycle"])
def fold_stream(spark, sf_dir):
    """T-1: the waves of dispatch_lifecycle, their events arriving over time."""
    events = wave_events(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("seq") * 3600 + 1_700_000_000))
    end = lambda later: events.limit(0).unionByName(spark.range(1).select(F.lit("end").alias("wave"), later.alias("ts")), allowMissingColumns=True)
    stream, delay, out = arriving(spark, events, "ts", end, "fold")
    found = guard.run_available(guard.fold_waves(stream, "ts", delay), out)
    return found.select(F.col("wave").cast("long").alias("conv_id"), "seq", "action", "refused", "state")
