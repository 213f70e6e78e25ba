"""Queries on measurements, transfers, viewports, caches and settings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plugins, scalars
from ..functions.session import with_checkpoints
from ..operators import metrics as M
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


STATS = "(select operation, count(*) as count, sum(duration_ns)::bigint as total, min(duration_ns) as min, max(duration_ns) as max, (sum(duration_ns) // count(*))::bigint as avg, quantile_cont(duration_ns, 0.95) as q95, quantile_cont(duration_ns, 0.99) as q99 from v_measurements group by 1)"


@query("agg1_operation_stats", f"select operation, count, total, min, max, avg, floor(max * 0.95::double)::bigint as p95, floor(max * 0.99::double)::bigint as p99, round(q95, 3) as real_p95, round(q99, 3) as real_p99 from {STATS}")
def operation_stats(spark, sf_dir):
    s = M.operation_stats(V.measurements(spark, sf_dir))
    return s.withColumns({"real_p95": F.round("real_p95", 3), "real_p99": F.round("real_p99", 3)})


@query("agg2_bottlenecks", f"select operation, printf('%s: avg %d ns, max %d ns', operation, avg, max) as report from {STATS} where avg > 1000000 or max / greatest(min, 1) > 10")
def bottlenecks(spark, sf_dir):
    return M.bottlenecks(M.operation_totals(V.measurements(spark, sf_dir)))


@query("flt21_slow_operations", f"select operation from {STATS} where avg > 400000 or max / greatest(min, 1) > 100000")
def slow_operations(spark, sf_dir):
    return M.bottlenecks(M.operation_totals(V.measurements(spark, sf_dir)), 400_000, 100_000).select("operation")


RECENT = "(select *, sum(bytes) over w as rb, sum(duration_us) over w as rd from v_transfers window w as (partition by client order by us range between 10000000000 preceding and current row))"


def recent(spark, sf_dir):
    return M.recent_bandwidth(V.transfers(spark, sf_dir), 10_000)


@query("win2_recent_bandwidth", f"select client, event_id, rb::bigint as recent_bytes, rd::bigint as recent_us from {RECENT}")
def recent_bandwidth(spark, sf_dir):
    return recent(spark, sf_dir).select("client", "event_id", "recent_bytes", "recent_us")


@query("agg18_bandwidth", f"select client, event_id, (rb * 1000000 // rd)::bigint as bps from {RECENT}")
def bandwidth(spark, sf_dir):
    return recent(spark, sf_dir).select("client", "event_id", M.bandwidth(recent(spark, sf_dir)).alias("bps"))


QUALITY = "case when bps > 10000000 then 'full' when bps > 5000000 then 'high' when bps > 1000000 then 'medium' when bps > 500000 then 'low' else 'thumbnail' end"


@query("str8_adaptive_quality", f"select client, event_id, {QUALITY} as quality from (select client, event_id, (rb * 1000 // rd)::bigint as bps from {RECENT})")
def adaptive_quality(spark, sf_dir):
    r = recent(spark, sf_dir).withColumn("bps", F.expr("(recent_bytes * 1000) div recent_us"))
    return r.select("client", "event_id", M.quality(F.col("bps")).alias("quality"))


@query("win3_smoothed_bandwidth", "with recursive o as (select client, (bytes * 1000000 // duration_us)::bigint as bps, row_number() over (partition by client order by us, event_id) as n from v_transfers), e as (select distinct client, 0::bigint as n, 1000000::bigint as ema from o union all select e.client, o.n, floor(e.ema * 0.8::double + o.bps * 0.2::double)::bigint from e join o on o.client = e.client and o.n = e.n + 1) select client, arg_max(ema, n) as ema from e group by client")
def smoothed_bandwidth(spark, sf_dir):
    return M.smoothed(V.transfers(spark, sf_dir).withColumn("bps", F.expr("(bytes * 1000000) div duration_us")))


def moving_sql(value: str) -> str:
    return f"""(select *, last_value(step ignore nulls) over (partition by client order by us, event_id rows between unbounded preceding and current row) as v0,
      count(step) over (partition by client order by us, event_id rows between unbounded preceding and current row) as moves,
      last_value(turn ignore nulls) over (partition by client order by us, event_id rows between unbounded preceding and current row) as a0 from
      (select *, case when dt > 0 then (step - coalesce(last_value(step ignore nulls) over (partition by client order by us, event_id rows between unbounded preceding and 1 preceding), 0.0)) / dt end as turn from
      (select *, case when dt > 0 then ({value} - pv) / dt end as step from
      (select *, (us - lag(us) over (partition by client order by us, event_id)) / 1e6::double as dt, lag({value}) over (partition by client order by us, event_id) as pv from v_viewports))))"""


def moving(spark, sf_dir, value="x"):
    return M.motion(V.viewports(spark, sf_dir), value)


@query("win4_velocity", f"select client, event_id, round(coalesce(v0, 0.0), 6) as velocity, round(coalesce(a0, 0.0), 6) as acceleration from {moving_sql('x')}")
def velocity(spark, sf_dir):
    return moving(spark, sf_dir).select("client", "event_id", F.round("velocity", 6).alias("velocity"), F.round("acceleration", 6).alias("acceleration"))


@query("win5_confidence", f"select client, event_id, round(1 - power(0.9::double, moves), 9) as confidence from {moving_sql('x')}")
def confidence(spark, sf_dir):
    return moving(spark, sf_dir).select("client", "event_id", F.round("confidence", 9).alias("confidence"))


@query("win6_predicted_centre", f"select client, event_id, round(x + coalesce(v0, 0.0) * 0.5 + coalesce(a0, 0.0) * 0.5 * 0.5 / 2, 5) as predicted from {moving_sql('x')}")
def predicted_centre(spark, sf_dir):
    return M.predicted(moving(spark, sf_dir)).select("client", "event_id", F.round("predicted", 5).alias("predicted"))


@query("win7_zoom_velocity", f"select client, event_id, round(coalesce(v0, 0.0), 6) as velocity from {moving_sql('zoom')}")
def zoom_velocity(spark, sf_dir):
    return moving(spark, sf_dir, "zoom").select("client", "event_id", F.round("velocity", 6).alias("velocity"))


@query("win8_viewport_ring", "select client, event_id, count(*) over w as held, first(x) over w as first_x from v_viewports window w as (partition by client order by us, event_id rows between 49 preceding and current row)")
def viewport_ring(spark, sf_dir):
    return M.ring(V.viewports(spark, sf_dir)).select("client", "event_id", "held", "first_x")


ACCESS = "(select client, (event_id % 23)::bigint as tile, us, event_id, bytes % 5000 as bytes from v_transfers)"


def access(spark, sf_dir):
    return V.transfers(spark, sf_dir).select("client", (F.col("event_id") % 23).alias("tile"), "us", "event_id", (F.col("bytes") % 5000).alias("bytes"))


CACHED = f"(select client, tile, count(*) as accesses, max((us, event_id))[1] as last_us, max((us, event_id))[2] as last_event, max(bytes) as bytes from {ACCESS} group by all)"


def cached(spark, sf_dir):
    a = access(spark, sf_dir)
    return M.recency(a, ["client", "tile"]).join(a.groupBy("client", "tile").agg(F.max("bytes").alias("bytes")), ["client", "tile"])


@query("win9_access_counts", f"select client, tile, event_id, row_number() over (partition by client, tile order by us, event_id) as nth from {ACCESS}")
def access_counts(spark, sf_dir):
    return M.accesses(access(spark, sf_dir), ["client", "tile"]).select("client", "tile", "event_id", F.col("nth").cast("long").alias("nth"))


@query("top5_eviction_victim", f"select client, arg_min(tile, (last_us, last_event)) as tile from {CACHED} group by client")
def eviction_victim(spark, sf_dir):
    return M.evicted(cached(spark, sf_dir), ["client"]).select("client", "tile")


@query("top6_fitting_entries", f"select client, tile, used::bigint as used from (select client, tile, sum(bytes) over (partition by client order by last_us desc, last_event desc rows between unbounded preceding and current row) as used from {CACHED}) where used <= 20000")
def fitting_entries(spark, sf_dir):
    return M.fitting(cached(spark, sf_dir), ["client"], 20_000).select("client", "tile", "used")


@query("agg19_cache_stats", f"select count(*) as entries, sum(b)::bigint as bytes, sum(n - 1)::bigint as hits, count(*) as misses, (sum(n) - count(*))::double / sum(n) as hit_ratio from (select client, tile, count(*) as n, max(bytes) as b from {ACCESS} group by all)")
def cache_stats(spark, sf_dir):
    return M.cache_stats(access(spark, sf_dir), ["client", "tile"])


REQUESTS = "(select event_id as request_id, event_id % 4 as priority, case when event_id % 5 = 0 then null else event_id % 100 end as deadline from events)"


def requests(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("request_id"), (F.col("event_id") % 4).alias("priority"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 100).alias("deadline"))


@query("top4_concurrent_loads", f"select request_id, priority, deadline from {REQUESTS} order by priority desc, deadline nulls last, request_id limit 8")
def concurrent_loads(spark, sf_dir):
    """The eight requests that are loaded at once."""
    return M.queue(requests(spark, sf_dir), 8)


@query("top3_next_request", f"select request_id from {REQUESTS} order by priority desc, deadline nulls last, request_id limit 1")
def next_request(spark, sf_dir):
    """The request that is loaded next."""
    return M.queue(requests(spark, sf_dir), 1).select("request_id")


DELTAS = "(select client, us, event_id, case when event_id % 3 = 0 then -(bytes % 700) else bytes % 900 end as delta from v_transfers)"


@query("agg22_allocations", f"select client, event_id, current_::bigint as current_, max(current_) over (partition by client order by us, event_id rows between unbounded preceding and current row)::bigint as peak from (select *, sum(delta) over (partition by client order by us, event_id rows between unbounded preceding and current row) as current_ from {DELTAS})")
def allocations(spark, sf_dir):
    delta = F.when(F.col("event_id") % 3 == 0, -(F.col("bytes") % 700)).otherwise(F.col("bytes") % 900)
    return M.allocations(V.transfers(spark, sf_dir).withColumn("delta", delta)).select("client", "event_id", F.col("current").alias("current_"), "peak")


@query("str5_predicted_tiles", f"select distinct client, cx + dx as x, dy::bigint as y from (select client, (floor(round(x + coalesce(v0, 0.0) * 0.5 + coalesce(a0, 0.0) * 0.5 * 0.5 / 2, 3) / 64.0::double))::bigint as cx from {moving_sql('x')}), range(-1, 2) a(dx), range(-1, 2) b(dy) where cx + dx >= 0 and dy >= 0")
def predicted_tiles(spark, sf_dir):
    """The tiles around where each client will look."""
    from ..operators.tiles import rings

    ahead = M.predicted(moving(spark, sf_dir))
    centre = ahead.select("client", F.floor(F.round("predicted", 3) / 64.0).alias("cx"), F.lit(0).cast("long").alias("cy"))
    return rings(centre, 1).select("client", "x", "y").distinct()


@query("str4_prefetch", f"select * from ({SQL['str5_predicted_tiles']}) where not ((x + client) % 3 = 0 and y = 0) and (x, y) not in ((1, 1), (4, 0))")
def prefetch(spark, sf_dir):
    """Tiles where clients will look, by their motion, that are neither cached nor being loaded."""
    ahead = predicted_tiles(spark, sf_dir)
    cached = ahead.where("(x + client) % 3 = 0 and y = 0")
    loading = spark.createDataFrame([(1, 1), (4, 0)], "x long, y long")
    return M.wanted(ahead.join(cached, ["client", "x", "y"], "left_anti"), loading, loading, ["x", "y"]).select("client", "x", "y")


MARKS = "(select user_id as client, event_id, epoch_us(ts) as us, event_type as name, case when event_id % 3 = 0 then 'end' else 'start' end as kind from events)"


@query("agg25_timers", f"with recursive m as (select *, row_number() over (partition by client, name order by us, event_id) as i from {MARKS}), r as (select client, name, 0::bigint as i, []::bigint[] as open, null::bigint as start_us, null::bigint as duration_us from (select distinct client, name from m) union all select r.client, r.name, m.i, case when m.kind = 'start' then list_append(r.open, m.us) else r.open[2:] end, case when m.kind = 'end' then r.open[1] end, case when m.kind = 'end' then m.us - r.open[1] end from r join m on m.client = r.client and m.name = r.name and m.i = r.i + 1) select client, name, start_us, duration_us from r where start_us is not null")
def timers(spark, sf_dir):
    """Starts and ends of named timers as durations; an end closes the oldest open start of its name."""
    e = V.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "end").otherwise("start")
    return M.timed(e.select(F.col("user_id").alias("client"), "event_id", V.micros().alias("us"), F.col("event_type").alias("name"), kind.alias("kind")))


PLUGINS = ("brightness", "identity", "plain", "geo", "unknown")
CATALOG = "(values ('brightness', 'filter', '1.0.0'), ('identity', 'compression', '1.0.0'), ('plain', 'renderer', '1.0.0'), ('geo', 'format', '1.0.0')) t(id, kind, version)"
CALLS = f"(select event_id, {list(PLUGINS)}[event_id % 5 + 1] as id from events)"


def calls(spark, sf_dir):
    """Events as calls of plugins, one of which does not exist."""
    return V.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, PLUGINS)), (F.col("event_id") % 5 + 1).cast("int")).alias("id"))


@query("flt25_filter_plugins", f"select event_id, id from {CALLS} where id in (select id from {CATALOG} where kind = 'filter')")
def filter_plugins(spark, sf_dir):
    """The calls that name a filter."""
    filters = plugins.REGISTRY.catalog(spark).where("kind = 'filter'")
    return calls(spark, sf_dir).join(F.broadcast(filters), "id", "left_semi").select("event_id", "id")  # a row a registered plugin


@query("top2_load_queue", f"select request_id, row_number() over (order by priority desc, deadline nulls last, request_id) as place from {REQUESTS}")
def load_queue(spark, sf_dir):
    return M.ranked_queue(requests(spark, sf_dir)).select("request_id", "place")


@query("flt26_not_cached", "select distinct user_id, event_id % 40 as tile from events where event_id % 40 >= 23 and event_id % 40 <> 30")
def not_cached(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    asked = e.select("user_id", (F.col("event_id") % 40).alias("tile")).distinct()
    held = spark.range(23).select(F.col("id").alias("tile"))
    loading = spark.createDataFrame([(30,)], "tile long")
    return M.wanted(asked, held, loading, ["tile"])


@query("jn11_wanted_tiles", """select client, x, y, place from (select client, x, y, row_number() over (partition by client order by radius, y, x)::int as place from (
  select client, cx + dx as x, dy as y, greatest(abs(dx), abs(dy)) as radius from (select client, arg_max(floor(x / 64)::bigint, (us, event_id)) as cx from v_viewports group by client), range(-2, 3) a(dx), range(-2, 3) b(dy))
  where x >= 0 and y >= 0 and not ((x + client) % 3 = 0 and y = 0) and (x + y + client) % 5 <> 0) where place <= 4""")
def wanted_tiles(spark, sf_dir):
    """The next four tiles to load for each client: around where it looks, not cached, not being loaded, nearest first."""
    from ..operators.encoder import prefetched
    from ..operators.tiles import rings

    last = V.viewports(spark, sf_dir).groupBy("client").agg(F.max_by("x", F.struct("us", "event_id")).alias("ahead"))
    near = rings(last.select("client", F.floor(F.col("ahead") / 64).alias("cx"), F.lit(0).cast("long").alias("cy")), 2).select("client", "x", "y")
    return prefetched(last, near.where("(x + client) % 3 = 0 and y = 0"), near.where("(x + y + client) % 5 = 0"), 64, 4)


@query("jn9_merged_confidence", "select a.idx, a.kind, greatest(a.confidence, coalesce(b.confidence, a.confidence)) as confidence from (select event_id as idx, event_type as kind, floor(value)::bigint as confidence from events) a left join (select event_id - 7 as idx, floor(value)::bigint as confidence from events where event_id % 2 = 1) b on a.idx = b.idx")
def merged_confidence(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    a = e.select(F.col("event_id").alias("idx"), F.col("event_type").alias("kind"), F.floor("value").alias("confidence"))
    b = e.where("event_id % 2 = 1").select((F.col("event_id") - 7).alias("idx"), F.floor("value").alias("confidence"))
    return M.merged(a, b)


@query("set2_region_union", "select event_id, 'edge' as source from events where event_id % 3 = 0 union all select event_id, 'model' from events where event_id % 2 = 0")
def region_union(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    part = lambda n, s: e.where(F.col("event_id") % n == 0).select("event_id", F.lit(s).alias("source"))
    return part(3, "edge").unionByName(part(2, "model"))


@query("flt24_extension_keys", "select p_partkey, case p_partkey % 3 when 0 then [] when 1 then ['geo'] else ['audio', 'geo'] end::varchar as ids from part")
def extension_keys(spark, sf_dir):
    k = F.col("p_partkey")
    custom = F.when(k % 3 == 0, F.create_map(F.lit("note"), F.lit("x"))).when(k % 3 == 1, F.create_map(F.lit("extension.geo"), F.lit("1"), F.lit("note"), F.lit("x"))).otherwise(F.create_map(F.lit("extension.geo"), F.lit("1"), F.lit("extension.audio"), F.lit("2")))
    ids = scalars.extension_ids(custom)
    return V.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("ids"))


@query("flt13_encode_arguments", "select p_partkey, case when t < 64 or t > 2048 or (t & (t - 1)) <> 0 then 'tile_size' when z > 20 then 'max_zoom' when e > 1.0 then 'edge_threshold' when q > 100 then 'quality' end as code from (select p_partkey, (32 << (p_partkey % 8)::int) + case when p_partkey % 19 = 0 then 1 else 0 end as t, p_partkey % 24 as z, p_partkey % 14 / 10.0 as e, p_partkey % 130 as q from part)")
def encode_arguments(spark, sf_dir):
    k = F.col("p_partkey")
    tile = F.call_function("shiftleft", F.lit(32).cast("long"), (k % 8).cast("int")) + F.when(k % 19 == 0, 1).otherwise(0)
    return V.table(spark, sf_dir, "part").select("p_partkey", scalars.encode_errors(tile, k % 24, k % 14 / 10.0, k % 130).alias("code"))


@query("udf7_plugin_catalog", f"select t.id, kind, version, count(event_id) as calls from {CATALOG} left join {CALLS} c on c.id = t.id group by all")
def plugin_catalog(spark, sf_dir):
    """The registered plugins and how often they are called."""
    called = calls(spark, sf_dir).groupBy("id").agg(F.count("*").alias("calls"))
    return plugins.REGISTRY.catalog(spark).join(called, "id", "left").select("id", "kind", "version", F.coalesce("calls", F.lit(0).cast("long")).alias("calls"))


SETTINGS = f"""(select event_id, {list(PLUGINS)}[event_id % 5 + 1] as id, event_id % 3 <> 0 as enabled, (event_id % 11)::int as priority, event_id % 250 - 120 as b, event_id % 7 as odd from events)"""


def configurations(spark, sf_dir):
    """Events as plugin configurations: some values out of range, some no numbers, some of parameters that do not exist."""
    k = F.col("event_id")
    made = calls(spark, sf_dir).withColumns({"enabled": k % 3 != 0, "priority": (k % 11).cast("int")})
    value = F.when(k % 7 == 3, F.lit('{"brightness": "much"}')).when(k % 7 == 5, F.lit('{"hue": 3}')).when(k % 7 == 6, F.lit(None)).otherwise(F.to_json(F.struct((k % 250 - 120).alias("brightness"))))
    return made.withColumn("settings", F.parse_json(value))


@query("udf14_plugin_settings", f"""select event_id, case when id = 'unknown' then 'unknown_plugin' when odd = 6 then null when odd = 5 then 'unknown_parameter:hue' when id <> 'brightness' then 'unknown_parameter:brightness' when odd = 3 then 'not_a_number:brightness' when b not between -100 and 100 then 'out_of_range:brightness' end as code from {SETTINGS}""")
def plugin_settings(spark, sf_dir):
    """The first rule that each configuration breaks."""
    return plugins.config_violations(configurations(spark, sf_dir), plugins.REGISTRY).select("event_id", "code")


@query("src15_chosen_settings", f"""select user_id, arg_max(case when s.odd = 6 then 0 else s.b end, (priority, -s.event_id))::double as brightness from {SETTINGS} s join events e using (event_id)
  where s.id = 'brightness' and enabled and s.odd not in (3, 5) and (s.odd = 6 or s.b between -100 and 100) group by user_id""")
def chosen_settings(spark, sf_dir):
    """Each client's setting of the filter: written as JSON, read back, the sound and enabled one of the highest priority."""
    users = V.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("owner"))
    folder = f"{with_checkpoints(spark).sparkContext.getCheckpointDir()}/plugins-{uuid.uuid4().hex}"
    plugins.write_configs(configurations(spark, sf_dir).join(users, "event_id"), folder)
    held = plugins.config_violations(plugins.read_configs(spark, folder, "owner long, event_id long"), plugins.REGISTRY).where("code is null")
    chosen = plugins.chosen_configs(held, plugins.REGISTRY.get("brightness", "filter"), ["owner"], "event_id")
    return chosen.select(F.col("owner").alias("user_id"), "brightness")


@query("udf10_brightness_filter", "select vec_id, x, y, least(r + 25, 255)::int as r from v_rgba")
def brightness_filter(spark, sf_dir):
    return plugins.REGISTRY.apply_filter("brightness", V.rgba(spark, sf_dir), {"brightness": 25}).select("vec_id", "x", "y", "r")


@query("udf12_brightness", "select event_id, v, least(100 + v, 255)::int as r from (select event_id, case when event_id % 4 = 0 then 0 else event_id % 100 end::int as v from events)")
def brightness_settings(spark, sf_dir):
    """A pixel of 100 under the filter, with settings from JSON, those not given by default."""
    k = F.col("event_id")
    settings = F.when(k % 4 == 0, F.lit("{}")).otherwise(F.to_json(F.struct((k % 100).alias("brightness"))))
    v = scalars.number_setting(settings, "$.brightness", 0.0).cast("int")
    return V.table(spark, sf_dir, "events").select("event_id", v.alias("v"), F.least(F.lit(100) + v, F.lit(255)).cast("int").alias("r"))


@query("udf5_format_extension", "select p_partkey, p_partkey * 0.5::double as lon, p_partkey % 90 * 1.0::double as lat from part")
def format_extension(spark, sf_dir):
    """Places written as an extension of the metadata and parsed again."""
    geo, k = plugins.REGISTRY.get("geo", "format"), F.col("p_partkey")
    custom = F.create_map(F.lit("extension.geo"), geo.serialize(F.struct((k * F.lit(0.5)).alias("lon"), (k % 90 * F.lit(1.0)).alias("lat"))))
    return V.table(spark, sf_dir, "part").select("p_partkey", geo.parse(F.element_at(custom, "extension.geo")).alias("g")).select("p_partkey", "g.lon", "g.lat")


@query("udf15_extensions", "select p_partkey, 'geo' as id, (p_partkey % 9)::bigint as size from part where p_partkey % 2 = 0")
def extensions(spark, sf_dir):
    k = F.col("p_partkey")
    custom = F.map_from_arrays(F.array(F.lit("note")), F.array(F.lit("x")))
    with_one = F.when(k % 2 == 0, plugins.add_extension(custom, "geo", "1", k % 9)).otherwise(custom)
    return V.table(spark, sf_dir, "part").select("p_partkey", F.explode(scalars.extension_ids(with_one)).alias("id"), plugins.extension_size(with_one, "geo").alias("size"))


@query("udf_json_settings", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), -1.0) as k from events")
def json_settings(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", scalars.number_setting(F.col("props"), "$.k", -1.0).alias("k"))
