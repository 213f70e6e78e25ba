import json
import time

import numpy as np
import pandas as pd
import pytest

from tilewright.streaming import bandwidth, cache, viewports


def test_state_goes_on_between_batches(spark, tmp_path):
    """Two files, one batch each: the mean is that of all transfers in order."""
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    when = pd.Timestamp("2024-01-01")
    for k in range(2):
        rows = pd.DataFrame({"event_id": [50 * k, 50 * k + 50_000], "ts": [when + pd.Timedelta(seconds=2 * k), when + pd.Timedelta(seconds=2 * k + 1)], "user_id": [1, 1], "value": [0.01, 0.02]})
        rows.to_parquet(folder / f"{k}.parquet", coerce_timestamps="us")
    got = bandwidth.last_states(spark, str(tmp_path)).collect()
    ema = 1_000_000
    for size in (1, 2, 1, 2):
        ema = int(ema * 0.8 + size * 1_000_000 * 0.2)
    assert [(r.client, r.ema, r.samples) for r in got] == [(1, ema, 4)]


def test_traffic_has_a_watermark(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    pd.DataFrame({"event_id": [1], "ts": [pd.Timestamp("2024-01-01")], "user_id": [1], "value": [1.0]}).to_parquet(folder / "0.parquet", coerce_timestamps="us")
    plan = bandwidth.traffic(bandwidth.transfers(spark, str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    assert "EventTimeWatermark" in plan


def test_transfers_of_no_time_are_left_out():
    class State:
        exists = False

        def update(self, value):
            self.value = value

    state, when = State(), pd.Timestamp("2024-01-01")
    frames = [pd.DataFrame({"ts": [when], "event_id": [2], "bytes": [5], "duration_us": [0]}), pd.DataFrame({"ts": [when], "event_id": [1], "bytes": [7], "duration_us": [2]})]
    (out,) = bandwidth.smooth((1,), iter(frames), state)
    assert state.value == (int(1_000_000 * 0.8 + 3_500_000 * 0.2), 1) and out["samples"].tolist() == [1]


def test_the_cache_counts_what_it_holds():
    lru = cache.Lru(10)
    for tile, size in ((1, 4), (2, 4), (1, 4), (3, 4), (4, 11), (3, 4)):
        lru.access(tile, size)
    assert list(lru.held) == [3] and lru.used == 4 and (lru.hits, lru.misses, lru.evictions) == (1, 5, 3)
    again = cache.Lru(10, *json.loads(lru.saved()[0]))
    assert again.held == lru.held and again.used == 4 and again.contains(3)


class MapState:
    """A map state in memory that counts what is asked of it."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.rows

    def getValue(self, key):  # noqa: N802
        return self.rows[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.rows[key]


def statistics(c):
    return len(c.held), c.used, c.hits, c.misses, c.evictions


def test_the_stored_cache_is_the_plain_one():
    """Whatever the batches: the same counts, the same tiles."""
    rng = np.random.default_rng(1)
    plain, tiles, queue, totals = cache.Lru(100), MapState(), MapState(), None
    for _ in range(60):
        stored = cache.StoredLru(100, tiles, queue, totals)
        for tile, size in zip(rng.integers(0, 30, 9).tolist(), rng.integers(1, 40, 9).tolist()):
            size = 101 if rng.random() < 0.05 else size
            plain.access(tile, size)
            stored.access(tile, size)
        totals = stored.write()
        n = dict(zip(cache.NAMES, totals))
        assert (n["tiles"], n["bytes"], n["hits"], n["misses"], n["evictions"]) == statistics(plain) and not n["expired"]
        assert [t for _, (t, _) in sorted(queue.rows.items())] == list(plain.held) and {t: s for (t,), (s, _) in tiles.rows.items()} == plain.held


def test_a_batch_touches_what_it_accesses_only():
    tiles, queue = MapState(), MapState()
    big = cache.StoredLru(10**9, tiles, queue, None)
    for tile in range(5000):
        big.access(tile, 10)
    totals = big.write()
    tiles.calls = queue.calls = 0
    again = cache.StoredLru(10**9, tiles, queue, totals)
    for tile in (5, 7, 5, 6000):
        again.access(tile, 10)
    again.write()
    assert tiles.calls + queue.calls < 20 and len(tiles.rows) == len(queue.rows) == 5001


def test_expired_tiles_are_released_in_their_turn():
    tiles, queue = MapState(), MapState()
    first = cache.StoredLru(10, tiles, queue, None)
    for tile in (1, 2):
        first.access(tile, 4)
    totals = first.write()
    del tiles.rows[1,]  # its time to live is over
    second = cache.StoredLru(10, tiles, queue, totals)
    second.access(1, 4)
    second.access(3, 4)
    n = dict(zip(cache.NAMES, second.write()))
    assert (n["expired"], n["evictions"], n["misses"], n["hits"], n["tiles"], n["bytes"]) == (1, 1, 4, 0, 2, 8)
    assert {t for (t,) in tiles.rows} == {1, 3}


def events(folder, k, rows):
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "value"])
    frame["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(frame["ts"], unit="s")
    frame.to_parquet(folder / f"{k}.parquet", coerce_timestamps="us")


def test_a_restarted_cache_goes_on(spark, tmp_path):
    folder, state = tmp_path / "events.parquet", f"file://{tmp_path}/state"
    folder.mkdir()
    rng, plain = np.random.default_rng(2), {}
    for k in range(3):
        rows = [(int(e), 1000 * k + i, int(rng.integers(0, 3)), float(v)) for i, (e, v) in enumerate(zip(rng.integers(0, 60, 40), rng.integers(1, 49, 40)))]
        events(folder, k, rows)
        for e, _, client, value in rows:
            plain.setdefault(client, cache.Lru(20_000)).access(e % 23, int(value * 100) % 5000)
        cache.run(cache.accesses(spark, str(tmp_path)), state, 20_000)
        got = {r.client: tuple(r)[1:] for r in cache.held_stats(spark, state).collect()}
        assert got == {c: statistics(p) for c, p in plain.items()}
    tiles = spark.read.format("statestore").option("path", state).option("stateVarName", "tiles").load()
    assert tiles.count() == sum(len(p.held) for p in plain.values())


def test_tiles_that_are_not_accessed_expire(spark, tmp_path):
    folder, state = tmp_path / "events.parquet", f"file://{tmp_path}/state"
    folder.mkdir()
    events(folder, 0, [(1, 0, 1, 1.0)])
    cache.run(cache.accesses(spark, str(tmp_path)), state, 20_000, keep_ms=1)
    events(folder, 1, [(1, 1, 1, 1.0)])
    time.sleep(0.1)
    cache.run(cache.accesses(spark, str(tmp_path)), state, 20_000, keep_ms=1)
    assert [(r.hits, r.misses) for r in cache.held_stats(spark, state).collect()] == [(0, 2)]


def test_later_tiles_replace_worse_ones(spark, tmp_path):
    """A view of tile 0 and what comes for it, a batch each; what comes too late or for others does not count."""
    folder, work = tmp_path / "events.parquet", f"file://{tmp_path}/work"
    folder.mkdir()
    settings = cache.Settings(prefetch_levels=0, wait="100 seconds")
    steps = [[(2, 0, 1, 0.1)], [(11, 10, 1, 0.09)], [(13, 20, 1, 0.09), (15, 21, 2, 0.09)], [(21, 30, 1, 0.09), (17, 31, 1, 0.0), (19, 120, 1, 0.09)]]
    want = [[], [(0, 1, 1)], [(0, 3, 2)], [(0, 3, 2), (1, 1, 1)]]
    for k, (rows, found) in enumerate(zip(steps, want)):
        events(folder, k, rows)
        shown = viewports.run(spark, str(tmp_path), work, settings)
        got = sorted((r.tile, r.quality, r.steps) for r in viewports.best_so_far(shown).where("view = 2 and tile = 0").collect())
        assert got == [x for x in found if x[0] == 0], k
    shown = viewports.run(spark, str(tmp_path), work, settings)
    assert {(r.client, r.view) for r in shown.collect()} == {(1, 2)}
    assert {r.quality for r in viewports.met(viewports.events_as_views(batch(spark, tmp_path)), viewports.events_as_arrivals(batch(spark, tmp_path)), cache.Settings(progressive=False, wait="1 hour")).collect()} <= {viewports.BEST}


def batch(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    return e.selectExpr("user_id as client", "event_id", "ts", "cast(floor(value * 100) as long) as bytes")


def test_watermarks_bound_what_is_kept(spark, tmp_path):
    plan = viewports.met(viewports.events_as_views(bandwidth.transfers(spark, "/root/testdata/sf0.001")), viewports.events_as_arrivals(bandwidth.transfers(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("EventTimeWatermark") == 2


@pytest.mark.parametrize("low, high", [(0, 50), (-(2**40), 2**40), (-(2**63), 2**63 - 1), (7, 8)])
def test_percentiles_by_selection(spark, low, high):
    from tilewright.operators import metrics

    rng = np.random.default_rng(3)
    rows = [(name, int(v)) for name, n in (("a", 1), ("b", 2), (None, 500), ("c", 301)) for v in rng.integers(low, high, n, endpoint=True)] + [("d", None)]
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {(r.name, r.share): r.value for r in metrics.percentiles(spark.createDataFrame(rows, "name string, v long"), "name", "v", shares).collect()}
    for name in ("a", "b", None, "c"):
        values = sorted(v for n, v in rows if n == name and v is not None)
        for q in shares:
            at = q * (len(values) - 1)
            k = int(at)
            a, b = float(values[k]), float(values[min(k + 1, len(values) - 1)])
            assert got.pop((name, q)) == pytest.approx(a + (b - a) * (at - k), rel=1e-12)
    assert not got
