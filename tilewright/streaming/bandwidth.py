"""Running bandwidth of clients as a stateful stream, and windowed traffic with a watermark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.session import with_checkpoints
from ..operators.metrics import FIRST_BANDWIDTH

STATE = "ema long, samples long"
OUT = "client long, ema long, samples long"


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of transfers from the ``events`` table in a folder: one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    return e.select(F.col("user_id").alias("client"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), (F.col("event_id") % 50 + 1).cast("long").alias("duration_us"))


def smooth(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds a client's new transfers, in order, into its running mean; the state is two numbers.

    Transfers of no time say nothing about the bandwidth and are left out. A batch is put in order as four numbers a
    transfer; how much of a client comes at once is set by the source (``maxFilesPerTrigger``).
    """
    ema, samples = state.get if state.exists else (FIRST_BANDWIDTH, 0)
    parts = [frame.loc[frame["duration_us"] > 0, ["ts", "event_id", "bytes", "duration_us"]] for frame in frames]
    rows = pd.concat(parts).sort_values(["ts", "event_id"])
    for size, us in zip(rows["bytes"].to_numpy(), rows["duration_us"].to_numpy()):
        ema, samples = int(ema * 0.8 + (int(size) * 1_000_000 // int(us)) * 0.2), samples + 1
    state.update((ema, samples))
    yield pd.DataFrame({"client": [key[0]], "ema": [ema], "samples": [samples]})


def smoothed(stream: DataFrame) -> DataFrame:
    """client, ema, samples after each batch. Transfers of one batch are put in order of time; later batches follow."""
    return stream.groupBy("client").applyInPandasWithState(smooth, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def traffic(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Bytes in windows of event time; rows later than the watermark are dropped (an addition of ours)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "client").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))


def last_states(spark: SparkSession, folder: str) -> DataFrame:
    """Runs the stream over ``events`` in ``folder`` and returns each client's state, as the state store has it: one row, however many batches there were."""
    state = f"{with_checkpoints(spark).sparkContext.getCheckpointDir()}/bandwidth_{uuid.uuid4().hex}"
    smoothed(transfers(spark, folder)).writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    held = spark.read.format("statestore").option("path", state).load()
    return held.select(F.col("key.client").alias("client"), F.col("value.groupState.ema").alias("ema"), F.col("value.groupState.samples").alias("samples"))
