"""Measurements, transfers, viewports and caches: statistics and order-dependent features."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import div

FIRST_BANDWIDTH = 1_000_000
# Bytes a second above which a quality is served.
QUALITIES = ((10_000_000, "full"), (5_000_000, "high"), (1_000_000, "medium"), (500_000, "low"))
QUALITY_ORDER = ("thumbnail", "low", "medium", "high", "full")


def operation_totals(measured: DataFrame) -> DataFrame:
    """operation, count, total, min, max, avg (cut)."""
    d = F.col("duration_ns")
    out = measured.groupBy("operation").agg(F.count("*").alias("count"), F.sum(d).alias("total"), F.min(d).alias("min"), F.max(d).alias("max"))
    return out.withColumn("avg", div(F.col("total"), F.col("count")))


def operation_stats(measured: DataFrame) -> DataFrame:
    """:func:`operation_totals`, p95 and p99 (shares of the maximum), and real percentiles."""
    out = operation_totals(measured)
    real = percentiles(measured, "operation", "duration_ns", [0.95, 0.99]).groupBy(F.col("operation").alias("of")).agg(*(F.max(F.when(F.col("share") == q, F.col("value"))).alias(name) for q, name in ((0.95, "real_p95"), (0.99, "real_p99"))))
    share = lambda q: F.floor(F.col("max") * q).cast("long")
    out = out.join(real, F.col("operation").eqNullSafe(F.col("of")), "left")
    return out.select("operation", "count", "total", "min", "max", "avg", share(0.95).alias("p95"), share(0.99).alias("p99"), "real_p95", "real_p99")


#: Bits of a value that a pass of :func:`percentiles` looks at.
PASS_BITS = 16


def percentiles(rows: DataFrame, by: str, of: str, shares: list[float]) -> DataFrame:
    """``by``, share, value: exact percentiles of a column of whole numbers, between two neighbours in proportion.

    Selection by leading bits: passes (as many as the largest value needs, four at most) count the values of each group by their next 16
    bits, of those only that begin like a wanted one, and follow the ranks into the stretch that holds them. A pass is a
    partial aggregation and no task sees more of a group than 65,536 counts, whatever its size. Nulls do not count; a group without values has no rows.
    """
    values = rows.where(F.col(of).isNotNull()).select(F.col(by).isNull().alias("none"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("key"), F.col(by).alias("by"), F.col(of).cast("long").alias("v"))
    least, most = values.agg(F.min("v"), F.max("v")).first()
    bits = max(abs(least or 0), abs(most or 0)).bit_length() + 1
    passes = -(-bits // PASS_BITS)
    place = F.col("share") * (F.col("n") - 1)
    sizes = values.groupBy("none", "key").agg(F.first("by").alias("by"), F.count("*").alias("n"))
    asked = sizes.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumns({"low": F.floor(place), "part": place - F.floor(place)})
    ranks = asked.select("none", "key", F.explode(F.array("low", F.when(F.col("part") > 0, F.col("low") + 1).otherwise(F.col("low")))).alias("wanted")).distinct()
    wanted = ranks.select("none", "key", "wanted", F.col("wanted").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for k in range(passes):
        shift = PASS_BITS * (passes - 1 - k)
        group = ["none", "key", "prefix"]
        own = values.select("none", "key", (F.shiftright("v", shift + PASS_BITS) if k else F.lit(0).cast("long")).alias("prefix"), (F.shiftright("v", shift) if shift else F.col("v")).alias("next"))
        if k:
            own = own.join(wanted.select(*group).distinct(), group, "left_semi")
        counts = own.groupBy(*group, "next").agg(F.count("*").alias("c"))
        counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy(*group).orderBy("next")) - F.col("c"))
        inside = (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("c"))
        wanted = wanted.join(counts, group).where(inside).select("none", "key", "wanted", (F.col("left") - F.col("before")).alias("left"), F.col("next").alias("prefix"))
    found = wanted.select("none", "key", "wanted", F.col("prefix").cast("double").alias("at"))
    low, high = (found.select("none", "key", F.col("wanted").alias(f"{name}_rank"), F.col("at").alias(f"{name}_at")) for name in ("l", "h"))
    out = asked.withColumns({"l_rank": F.col("low"), "h_rank": F.when(F.col("part") > 0, F.col("low") + 1).otherwise(F.col("low"))}).join(low, ["none", "key", "l_rank"]).join(high, ["none", "key", "h_rank"])
    return out.select(F.col("by").alias(by), "share", (F.col("l_at") + (F.col("h_at") - F.col("l_at")) * F.col("part")).alias("value"))


def bottlenecks(stats: DataFrame, slow_ns: int = 1_000_000, spread: int = 10) -> DataFrame:
    """operation, report: operations that are slow on average or vary widely."""
    wide = F.col("max") / F.greatest(F.col("min"), F.lit(1)) > spread
    return stats.where((F.col("avg") > slow_ns) | wide).select("operation", F.format_string("%s: avg %d ns, max %d ns", "operation", "avg", "max").alias("report"))


def in_order(client: str = "client"):
    return Window.partitionBy(client).orderBy("us", "event_id")


def recent_bandwidth(transfers: DataFrame, seconds: int = 10) -> DataFrame:
    """Adds recent_bytes and recent_us: sums over the transfers of the last ``seconds``, both ends included."""
    frame = Window.partitionBy("client").orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    return transfers.withColumns({"recent_bytes": F.sum("bytes").over(frame), "recent_us": F.sum("duration_us").over(frame)})


def bandwidth(transfers: DataFrame) -> Column:
    return F.when(F.col("recent_us") > 0, div(F.col("recent_bytes") * 1_000_000, F.col("recent_us"))).otherwise(F.lit(FIRST_BANDWIDTH))


def smoothed(samples: DataFrame) -> DataFrame:
    """client, ema: the running 0.8 / 0.2 mean of ``bps`` in order, cut at each step.

    Each step depends on the one before, so a client's samples pass through one task, sorted and batch by batch:
    memory does not grow with a client.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ema = None, None
        for batch in batches:
            clients, means = [], []
            for client, bps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ema is None or client != now:
                    if ema is not None:
                        clients.append(now)
                        means.append(ema)
                    now, ema = client, FIRST_BANDWIDTH
                ema = int(ema * 0.8 + bps * 0.2)
            yield pa.RecordBatch.from_arrays([pa.array(clients, pa.int64()), pa.array(means, pa.int64())], ["client", "ema"])
        if ema is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([ema], pa.int64())], ["client", "ema"])

    ordered = samples.select(F.col("client").cast("long"), "bps", "us", "event_id").repartition("client").sortWithinPartitions("client", "us", "event_id")
    return ordered.select("client", "bps").mapInArrow(fold, "client long, ema long")


def quality(bps: Column) -> Column:
    """The quality that a bandwidth allows; limits themselves belong to the quality below."""
    out = None
    for limit, name in QUALITIES:
        out = (F if out is None else out).when(bps > limit, name)
    return out.otherwise("thumbnail")


def motion(viewports: DataFrame, value: str = "x") -> DataFrame:
    """Adds velocity, acceleration (per second), moves and confidence of ``value``.

    Steps of no time change nothing: they neither have a velocity nor count.
    """
    own = viewports.withColumns({"_us": F.lag("us").over(in_order()), "_v": F.lag(value).over(in_order())})
    dt = (F.col("us") - F.col("_us")) / 1e6
    own = own.withColumn("_dt", dt).withColumn("_step", F.when(F.col("_dt") > 0, (F.col(value) - F.col("_v")) / F.col("_dt")))
    until = in_order().rowsBetween(Window.unboundedPreceding, 0)
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    velocity = F.coalesce(F.last("_step", ignorenulls=True).over(until), F.lit(0.0))
    earlier = F.coalesce(F.last("_step", ignorenulls=True).over(before), F.lit(0.0))
    own = own.withColumns({"velocity": velocity, "_turn": F.when(F.col("_dt") > 0, (F.col("_step") - earlier) / F.col("_dt"))})
    moves = F.count("_step").over(until)
    own = own.withColumns({"acceleration": F.coalesce(F.last("_turn", ignorenulls=True).over(until), F.lit(0.0)), "moves": moves})
    return own.withColumn("confidence", 1 - F.pow(F.lit(0.9), "moves")).drop("_us", "_v", "_dt", "_step", "_turn")


def predicted(moving: DataFrame, value: str = "x", seconds: float = 0.5) -> DataFrame:
    """Adds predicted: where ``value`` will be after ``seconds``."""
    return moving.withColumn("predicted", F.col(value) + F.col("velocity") * seconds + F.col("acceleration") * seconds * seconds / 2)


def ring(viewports: DataFrame, size: int = 50) -> DataFrame:
    """Adds held, first_x: how many viewports the ring holds and the oldest one's x."""
    frame = in_order().rowsBetween(1 - size, 0)
    return viewports.withColumns({"held": F.count("*").over(frame), "first_x": F.first("x").over(frame)})


def accesses(events: DataFrame, key: list[str]) -> DataFrame:
    """Adds nth: the running number of accesses of each key."""
    return events.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("us", "event_id")))


def recency(events: DataFrame, key: list[str]) -> DataFrame:
    return events.groupBy(*key).agg(F.count("*").alias("accesses"), F.max(F.struct("us", "event_id")).alias("_last")).select(*key, "accesses", F.col("_last.us").alias("last_us"), F.col("_last.event_id").alias("last_event"))


def evicted(cached: DataFrame, by: list[str]) -> DataFrame:
    """by and the least recently used entry of each cache: the next to go."""
    rest = [c for c in cached.columns if c not in by]
    return cached.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("last_us", "last_event")).alias("s")).select(*by, "s.*")


def fitting(cached: DataFrame, by: list[str], budget: int) -> DataFrame:
    """The most recently used entries that fit into ``budget`` bytes together; older ones are evicted."""
    order = Window.partitionBy(*by).orderBy(F.desc("last_us"), F.desc("last_event")).rowsBetween(Window.unboundedPreceding, 0)
    return cached.withColumn("used", F.sum("bytes").over(order)).where(F.col("used") <= budget)


def cache_stats(events: DataFrame, key: list[str]) -> DataFrame:
    """entries, bytes, hits, misses, hit_ratio of a cache that keeps every key: its first access misses, the others hit."""
    per = events.groupBy(*key).agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    return per.agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.sum(F.col("n") - 1).alias("hits"), F.count("*").alias("misses"), ((F.sum("n") - F.count("*")) / F.sum("n")).alias("hit_ratio"))


def allocations(events: DataFrame) -> DataFrame:
    """Adds current and peak: running bytes in use per client (``delta`` may be negative) and their largest value so far."""
    until = in_order().rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("current", F.sum("delta").over(until)).withColumn("peak", F.max("current").over(until))


def queue(requests: DataFrame, most: int | None = None) -> DataFrame:
    """Load requests by priority, then deadline (none last), then key; with ``most`` the first ones only."""
    ordered = requests.orderBy(F.desc("priority"), F.asc_nulls_last("deadline"), "request_id")
    return ordered if most is None else ordered.limit(most)


def ranked_queue(requests: DataFrame) -> DataFrame:
    """Adds place: that of each request in :func:`queue`. Counts of a priority and deadline first, then places within it."""
    turn = ["priority", "deadline"]
    before = Window.orderBy(F.desc("priority"), F.asc_nulls_last("deadline")).rowsBetween(Window.unboundedPreceding, -1)
    starts = requests.groupBy(*turn).agg(F.count("*").alias("n")).select(F.col("priority").alias("_p"), F.col("deadline").alias("_d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*turn).orderBy("request_id")
    local = requests.withColumn("local", F.row_number().over(inside))
    on = F.col("priority").eqNullSafe(F.col("_p")) & F.col("deadline").eqNullSafe(F.col("_d"))
    return local.join(starts, on).withColumn("place", (F.col("base") + F.col("local")).cast("long")).drop("_p", "_d", "base", "local")


def wanted(predicted_tiles: DataFrame, cached: DataFrame, loading: DataFrame, key: list[str]) -> DataFrame:
    """Predicted tiles that are neither cached nor being loaded."""
    return predicted_tiles.join(cached.select(*key), key, "left_anti").join(loading.select(*key), key, "left_anti")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positional zip on idx: all of ``a``, with the larger confidence of both."""
    other = b.select("idx", F.col("confidence").alias("_other"))
    return a.join(other, "idx", "left").withColumn("confidence", F.greatest("confidence", F.coalesce("_other", "confidence"))).drop("_other")


def timed(marks: DataFrame) -> DataFrame:
    """client, name, start_us, duration_us: each end paired with the oldest start of its name that is still open, per client.

    Rows (client, us, event_id, name, kind: start or end). The n-th end closes the n-th start of a name, unless it
    comes before it: an end without an open start is dropped and closes nothing later.
    """
    order = Window.partitionBy("client", "name").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "start", 1).otherwise(-1)
    # Ends beyond the starts so far are the new lows of the running balance.
    own = marks.withColumn("balance", F.sum(step).over(order))
    own = own.withColumn("low", F.least(F.min("balance").over(order), F.lit(0)))
    before = F.coalesce(F.lag("low").over(Window.partitionBy("client", "name").orderBy("us", "event_id")), F.lit(0))
    own = own.withColumn("void", (F.col("kind") == "end") & (F.col("low") < before)).where("not void")
    nth = Window.partitionBy("client", "name", "kind").orderBy("us", "event_id")
    own = own.withColumn("n", F.row_number().over(nth)).select("client", "name", "kind", "us", "n")
    starts, ends = (own.where(F.col("kind") == k).select("client", "name", "n", F.col("us").alias(f"{k}_us")) for k in ("start", "end"))
    return starts.join(ends, ["client", "name", "n"]).select("client", "name", "start_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"))
