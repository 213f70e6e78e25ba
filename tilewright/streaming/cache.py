"""A tile cache per client as a stateful stream: least recently used tiles go when the budget is used up."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.session import with_checkpoints
from .bandwidth import transfers

OUT = "client long, tiles long, bytes long, hits long, misses long, evictions long"


@dataclass(frozen=True)
class Settings:
    """Of a client's decoder: bytes of its cache, milliseconds for a frame, levels to look ahead, first bandwidth, loads at a time.

    ``progressive``: lower qualities are shown until better ones come; ``wait`` is how long a tile may take.
    """

    cache_bytes: int = 1000 * 1024 * 1024
    progressive: bool = True
    wait: str = "1 minute"
    frame_ms: int = 16
    prefetch_levels: int = 2
    bandwidth: int = 1_000_000
    most_loads: int = 8


class Lru:
    """Tiles and sizes of one client, oldest access first, within a budget of bytes."""

    def __init__(self, budget: int, held: list | None = None, hits: int = 0, misses: int = 0, evictions: int = 0):
        self.budget, self.held = budget, {tile: size for tile, size in held or []}
        self.used = sum(self.held.values())
        self.hits, self.misses, self.evictions = hits, misses, evictions

    def contains(self, tile: int) -> bool:
        return tile in self.held

    def touch(self, tile: int) -> None:
        """The tile becomes the one used last."""
        self.held[tile] = self.held.pop(tile)

    def insert(self, tile: int, size: int) -> None:
        """Makes room by letting the least recently used tiles go; what is larger than the cache is not kept."""
        while self.held and self.used + size > self.budget:
            self.used -= self.held.pop(next(iter(self.held)))
            self.evictions += 1
        if size <= self.budget:
            self.held[tile] = size
            self.used += size

    def access(self, tile: int, size: int) -> None:
        if self.contains(tile):
            self.hits += 1
            self.touch(tile)
        else:
            self.misses += 1
            self.insert(tile, size)

    def saved(self) -> tuple[str]:
        return (json.dumps([list(self.held.items()), self.hits, self.misses, self.evictions]),)


#: State of a client: where its queue begins and ends, what it holds and has counted.
TOTALS = "head long, turns long, bytes long, tiles long, hits long, misses long, evictions long, expired long"
NAMES = [c.split()[0] for c in TOTALS.split(", ")]


class Written:
    """A map state of which what a batch reads and changes is kept until its end: each key is read once and written once at most."""

    def __init__(self, state):
        self.state, self.held, self.changed = state, {}, set()

    def get(self, key: int) -> tuple | None:
        if key not in self.held:
            self.held[key] = tuple(self.state.getValue((key,))) if self.state.containsKey((key,)) else None
        return self.held[key]

    def put(self, key: int, value: tuple | None) -> None:
        self.held[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue((key,), self.held[key])
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))


class StoredLru:
    """:class:`Lru` over two map states, tile to (size, turn) and turn to (tile, size), of which a batch touches what it accesses and evicts.

    A tile has the turn of its last access; the queue is walked from its head, over turns that are gone. A tile
    that the state has dropped since (its time to live is over) is released, and counted as expired, when the walk comes to it.
    """

    def __init__(self, budget: int, tiles, queue, totals: tuple | None):
        self.budget, self.tiles, self.queue = budget, Written(tiles), Written(queue)
        self.n = dict(zip(NAMES, totals or [0] * len(NAMES)))

    def access(self, tile: int, size: int) -> None:
        now = self.tiles.get(tile)
        if now is not None:
            self.n["hits"] += 1
            self.queue.put(now[1], None)
            self.place(tile, now[0])
            return
        self.n["misses"] += 1
        while self.n["tiles"] and self.n["bytes"] + size > self.budget:
            self.release()
        if size <= self.budget:
            self.place(tile, size)
            self.n["bytes"] += size
            self.n["tiles"] += 1

    def place(self, tile: int, size: int) -> None:
        self.tiles.put(tile, (size, self.n["turns"]))
        self.queue.put(self.n["turns"], (tile, size))
        self.n["turns"] += 1

    def release(self) -> None:
        """Lets the tile at the head of the queue go."""
        while True:
            turn = self.n["head"]
            self.n["head"] += 1
            entry = self.queue.get(turn)
            if entry is not None:
                break
        tile, size = entry
        self.queue.put(turn, None)
        now = self.tiles.get(tile)
        if now is not None and now[1] == turn:
            self.tiles.put(tile, None)
            self.n["evictions"] += 1
        else:
            self.n["expired"] += 1
        self.n["bytes"] -= size
        self.n["tiles"] -= 1

    def write(self) -> tuple:
        self.tiles.write()
        self.queue.write()
        return tuple(self.n[name] for name in NAMES)


class Serve(StatefulProcessor):
    """Accesses of a client, batch by batch. With ``keep_ms`` a tile that is not accessed for so long (by the clock) is dropped."""

    def __init__(self, budget: int, keep_ms: int | None = None):
        self.budget, self.keep_ms = budget, keep_ms

    def init(self, handle) -> None:
        self.tiles = handle.getMapState("tiles", "tile long", "size long, turn long", ttlDurationMs=self.keep_ms)
        self.queue = handle.getMapState("queue", "turn long", "tile long, size long")
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        cache = StoredLru(self.budget, self.tiles, self.queue, self.totals.get() if self.totals.exists() else None)
        frame = pd.concat([r[["ts", "event_id", "tile", "bytes"]] for r in rows]).sort_values(["ts", "event_id"])
        for tile, size in zip(frame["tile"].tolist(), frame["bytes"].tolist()):
            cache.access(tile, size)
        self.totals.update(cache.write())
        yield pd.DataFrame({"client": [key[0]], **{c: [cache.n[c]] for c in ("tiles", "bytes", "hits", "misses", "evictions")}})

    def close(self) -> None:
        pass


def cached(stream: DataFrame, budget: int, keep_ms: int | None = None) -> DataFrame:
    """Cache statistics of each client after each batch of accesses (client, event_id, ts, tile, bytes).

    The state is kept per tile: a batch reads and writes what it accesses and evicts, whatever a cache holds. The session needs
    a state store that can hold several variables (:func:`with_stores`).
    """
    return stream.groupBy("client").transformWithStateInPandas(Serve(budget, keep_ms), OUT, "update", "none" if keep_ms is None else "processingTime")


#: RocksDB state stores hold several variables. Batches without rows would go on for ever where tiles expire by the clock.
STORES = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def with_stores(spark: SparkSession) -> Iterator[None]:
    """``STORES`` for the queries that are started inside; the session is as it was afterwards."""
    before = {key: spark.conf.get(key, None) for key in STORES}
    for key, value in STORES.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def accesses(spark: SparkSession, folder: str) -> DataFrame:
    """The accesses of ``events`` in ``folder`` as a stream: 23 tiles of sizes below 5000."""
    return transfers(spark, folder).select("client", "event_id", "ts", (F.col("event_id") % 23).alias("tile"), (F.col("bytes") % 5000).alias("bytes"))


def run(stream: DataFrame, state: str, budget: int, keep_ms: int | None = None) -> None:
    """Runs a stream of accesses to its end; what the caches hold is then in the state at ``state``, and goes on from there when run again."""
    with with_stores(stream.sparkSession):
        cached(stream, budget, keep_ms).writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def held_stats(spark: SparkSession, state: str) -> DataFrame:
    """client and statistics as the state at ``state`` has them, read from the state store: one row a client, however many batches there were."""
    found = spark.read.format("statestore").option("path", state).option("stateVarName", "totals").load()
    return found.select(F.col("key.client").alias("client"), *(F.col(f"value.{c}").alias(c) for c in ("tiles", "bytes", "hits", "misses", "evictions")))


def last_stats(spark: SparkSession, folder: str, budget: int = 20_000) -> DataFrame:
    """Runs the accesses of ``events`` in ``folder`` through the caches and returns the last state of each client."""
    state = f"{with_checkpoints(spark).sparkContext.getCheckpointDir()}/cache_{uuid.uuid4().hex}"
    run(accesses(spark, folder), state, budget)
    return held_stats(spark, state)
