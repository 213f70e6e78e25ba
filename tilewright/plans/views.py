"""Views that give the operators rows of the shared tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = 64
LEVELS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64-element embedding as an 8 x 8 grey image: vec_id, x, y, g."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return cells.select("vec_id", (F.col("i") % 8).alias("x"), F.expr("cast(i div 8 as int)").alias("y"), F.floor((F.col("v").cast("double") + 1) * 127.5).cast("int").alias("g"))


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of the grey images: vec_id, x, y, r, g, b, a."""
    p = pixels(spark, sf_dir)
    return p.select("vec_id", "x", "y", F.col("g").alias("r"), ((F.col("g") * 3 + 40) % 256).alias("g"), (255 - F.col("g")).alias("b"), F.when(F.col("g") % 5 == 0, 0).otherwise((F.col("g") * 2) % 256).cast("int").alias("a"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a contour: contour_id, seq, x, y."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("contour_id"), (F.row_number().over(order) - 1).alias("seq"), F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y")
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of line items by part and supplier: level, x, y, size."""
    from ..operators.tiles import pixel_to_tile

    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.floor("l_quantity").cast("long").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    items = items.withColumns({"x": pixel_to_tile(F.col("l_partkey"), F.col("level"), TILE), "y": pixel_to_tile(F.col("l_suppkey"), F.col("level"), TILE)})
    return items.groupBy("level", "x", "y").agg(F.sum("q").alias("size"))


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    side = (F.col("p_size") + 10).cast("double")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 997 * 10).cast("double").alias("x"), (F.col("p_partkey") % 499 * 20).cast("double").alias("y"), side.alias("w"), side.alias("h"))


def supplier_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 101 * 97).cast("double").alias("x"), (F.col("s_suppkey") % 89 * 110).cast("double").alias("y"), F.lit(60.0).alias("w"), F.lit(40.0).alias("h"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.floor(F.col("value") * 10000).cast("long").alias("duration_ns"))


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client, event_id, us (event time in microseconds), x, zoom."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("client"), "event_id", micros().alias("us"), F.floor("value").cast("double").alias("x"), (F.col("event_id") % 7).cast("double").alias("zoom"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client, event_id, us, bytes, duration_us."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("client"), "event_id", micros().alias("us"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), (F.col("event_id") % 50 + 1).cast("long").alias("duration_us"))


#: The same views for the SQL side; one query uses those that it names.
SQL = {
    "v_pixels": "select vec_id, (i % 8)::int as x, (i // 8)::int as y, floor((v::double + 1) * 127.5)::int as g from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings)",
    "v_rgba": "select vec_id, x, y, g as r, (g * 3 + 40) % 256 as g, 255 - g as b, case when g % 5 = 0 then 0 else (g * 2) % 256 end as a from v_pixels",
    "v_points": "select l_orderkey as contour_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as seq, l_partkey::double as x, l_suppkey::double as y from lineitem",
    "v_tiles": f"select level::int as level, (l_partkey // (1 << level)) // {TILE} as x, (l_suppkey // (1 << level)) // {TILE} as y, sum(floor(l_quantity)::bigint)::bigint as size from lineitem, range({LEVELS}) t(level) group by all",
    "v_part_boxes": "select p_partkey as id, (p_partkey % 997 * 10)::double as x, (p_partkey % 499 * 20)::double as y, (p_size + 10)::double as w, (p_size + 10)::double as h from part",
    "v_supplier_boxes": "select s_suppkey as id, (s_suppkey % 101 * 97)::double as x, (s_suppkey % 89 * 110)::double as y, 60.0::double as w, 40.0::double as h from supplier",
    "v_measurements": "select event_type as operation, floor(value * 10000)::bigint as duration_ns from events",
    "v_viewports": "select user_id as client, event_id, epoch_us(ts) as us, floor(value)::double as x, (event_id % 7)::double as zoom from events",
    "v_transfers": "select user_id as client, event_id, epoch_us(ts) as us, floor(value * 100)::bigint as bytes, (event_id % 50 + 1)::bigint as duration_us from events",
}


def sql(query: str) -> str:
    """``query`` behind the views that it names, those that they name first."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if name in text and name not in needed:
                need(SQL[name])
                needed.append(name)

    need(query)
    if not needed:
        return query
    head = ", ".join(f"{name} as ({SQL[name]})" for name in needed)
    for start in ("with recursive ", "with "):
        if query.startswith(start):
            return f"{start}{head}, {query.removeprefix(start)}"
    return f"with {head} {query}"
