"""What clients look at, as a stream: views meet the tiles that arrive for them, and show the best quality so far."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import with_checkpoints
from .bandwidth import transfers
from .cache import Settings

SHOWN = "client long, view long, tile long, quality long, asked timestamp, arrived timestamp"


def wanted_tiles(viewports: DataFrame, tile: int, ahead: int) -> DataFrame:
    """client, view, asked, tile: the tiles that views (client, view, asked, x, width) touch, and ``ahead`` more to the right."""
    first, last = F.floor(F.col("x") / tile), F.floor((F.col("x") + F.col("width") - 1) / tile) + ahead
    return viewports.select("client", "view", "asked", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("tile"))


def met(viewports: DataFrame, arrivals: DataFrame, settings: Settings = Settings(), tile: int = 64, late: str = "10 minutes") -> DataFrame:
    """``SHOWN``: every arrival (client, tile, quality, arrived) for every view of its client that wants the tile and began at most ``wait`` before.

    Two streams, or two tables, joined on client and tile within a span of event time: a stream keeps a view for ``wait`` and an arrival for
    ``late`` beyond the watermarks, and drops what comes later. Unless settings are progressive only the best quality is taken.
    """
    views = wanted_tiles(viewports.withWatermark("asked", late), tile, settings.prefetch_levels)
    come = arrivals.withWatermark("arrived", late).select(F.col("client").alias("to"), F.col("tile").alias("which"), "quality", "arrived")
    if not settings.progressive:
        come = come.where(F.col("quality") == BEST)
    span = (F.col("arrived") >= F.col("asked")) & (F.col("arrived") <= F.col("asked") + F.expr(f"interval {settings.wait}"))
    out = views.join(come, (F.col("client") == F.col("to")) & (F.col("tile") == F.col("which")) & span)
    return out.select("client", "view", "tile", "quality", "asked", "arrived")


#: The best quality, of 0 to 4.
BEST = 4


def rank() -> list[Column]:
    """Better qualities first, then what came first."""
    return [F.desc("quality"), F.col("arrived").asc()]


def best_so_far(shown: DataFrame) -> DataFrame:
    """client, view, tile, quality, arrived, steps: the best of what came for each tile of a view, when it came first, and how many times the view got sharper.

    A later tile of a better quality takes the place of the one before; one that is not better changes nothing.
    """
    key = ["client", "view", "tile"]
    before = Window.partitionBy(*key).orderBy("arrived", F.desc("quality")).rowsBetween(Window.unboundedPreceding, -1)
    sharper = shown.withColumn("sharper", F.col("quality") > F.coalesce(F.max("quality").over(before), F.lit(-1)))
    return sharper.groupBy(*key).agg(F.max("quality").alias("quality"), F.min_by("arrived", F.struct(-F.col("quality"), "arrived")).alias("arrived"), F.count_if("sharper").alias("steps"))


def events_as_views(events: DataFrame) -> DataFrame:
    """Even events: a view 100 pixels wide somewhere in eight tiles of 64."""
    return events.where("event_id % 2 = 0").select("client", F.col("event_id").alias("view"), F.col("ts").alias("asked"), (F.col("bytes") % 400).alias("x"), F.lit(100).alias("width"))


def events_as_arrivals(events: DataFrame) -> DataFrame:
    """Odd events: a tile of some quality."""
    return events.where("event_id % 2 = 1").select("client", (F.col("bytes") % 9).alias("tile"), (F.col("event_id") % 5).alias("quality"), F.col("ts").alias("arrived"))


def run(spark: SparkSession, folder: str, work: str, settings: Settings) -> DataFrame:
    """Runs both streams over ``events`` in ``folder`` to their end; ``SHOWN`` of all batches so far. State and matches lie in ``work``."""
    stream = met(events_as_views(transfers(spark, folder)), events_as_arrivals(transfers(spark, folder)), settings)
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{work}/shown").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SHOWN).parquet(f"{work}/shown")


def last_views(spark: SparkSession, folder: str, settings: Settings = Settings(prefetch_levels=1, wait="12 hours")) -> DataFrame:
    work = f"{with_checkpoints(spark).sparkContext.getCheckpointDir()}/views_{uuid.uuid4().hex}"
    return best_so_far(run(spark, folder, work, settings))
