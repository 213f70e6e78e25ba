"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

1. Every source's documents are shuffled by the MD5 of their id and laid end to end as a stream of words;
   the stream is cut into blocks of equally many words (the last one takes what is left over).
2. A source's target in words becomes a number of slots. All slots share the grid ``0 .. 2**m - 1``, each
   source owning a run of cells in proportion to its slots (the cumulative weights). Reversing the ``m``
   bits of a cell gives the time at which the van der Corput sequence visits it, so at all times every
   source has had its share, within a slot or two.
3. Slots are ranked by time within their source and joined to the source's blocks, round and round. The mix
   is the blocks in the order of their slots' times; a document stands where its first word does.

Prefix sums run in two levels (buckets, then rows), so no source has to fit into a task. Windows over all sources
see one row per source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, quoted, written

MAX_REPEATS = 3
BLOCK_WORDS = 4096
#: A source has at least so many blocks (or one for each word), which keeps rounding below a thousandth of it.
MIN_BLOCKS = 1024
BUCKET_ROWS = 2000
CHUNK_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, buckets_for: int) -> DataFrame:
    """doc_id, source, size, order (MD5 of the id) and bucket (its first hex digits)."""
    digits = max(1, min(6, math.ceil(math.log(max(buckets_for / BUCKET_ROWS, 1), 16))))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("order")).withColumn(
        "bucket", F.substring("order", 1, digits)
    )


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target, block, blocks, slots: one row per source.

    The water level: sources whose weight would exceed ``MAX_REPEATS`` times their size stop there, and what
    they leave over goes to the rest by weight. Sorted by size over weight the stopped ones come first, so a
    running sum finds the level without a loop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", (n % 3 + 1).cast("long"))
    cap = F.lit(MAX_REPEATS) * F.col("source_size")
    ratio = Window.orderBy((cap / F.col("weight")).asc(), F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("level", level.cast("double"))
    stopped = F.col("weight") * F.col("level") > cap
    # The first source that does not stop sets the level of all after it.
    final = F.first(F.when(~stopped, F.col("level")), ignorenulls=True).over(everything)
    per = per.withColumn("target", F.least(F.col("weight") * F.coalesce(final, F.lit(0.0)), cap.cast("double")))
    per = per.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.expr(f"source_size div {MIN_BLOCKS}"))).cast("long"))
    per = per.withColumn("blocks", F.expr("source_size div block"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - rounds * F.col("source_size")
    slots = rounds * F.col("blocks") + F.least(F.col("blocks"), F.round(rest / F.col("block")).cast("long"))
    return per.withColumn("slots", F.least(slots, MAX_REPEATS * F.col("blocks"))).drop("level")


def positions(sizes: DataFrame) -> DataFrame:
    """``sizes`` with start: the words of the source's stream before each document."""
    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = local["source"].eqNullSafe(sums["source"]) & (local["bucket"] == sums["bucket"])
    return local.join(sums, on).select(local["doc_id"], local["source"], local["size"], (F.col("base") + F.col("local")).alias("start"))


def schedule(per: DataFrame) -> DataFrame:
    """time, source, rank, block: which block each slot takes, in order of time."""
    total = per.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(total, 2))))
    cum = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    grid = F.lit(2.0**bits / max(total, 1))
    per = per.where("slots > 0").withColumn("upto", F.sum("slots").over(cum))
    per = per.withColumn("lo", F.floor((F.col("upto") - F.col("slots")) * grid).cast("long"))
    # Rounding may cost the run of a source its last cell; the slot count is the floor.
    per = per.withColumn("hi", F.greatest(F.floor(F.col("upto") * grid).cast("long"), F.col("lo") + F.col("slots")) - 1)
    chunk = 1 << CHUNK_BITS
    cells = per.select("source", "slots", "blocks", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {chunk}"), F.expr(f"hi div {chunk}"))).alias("c"))
    cells = cells.repartition(F.col("c")).select(
        "source", "slots", "blocks", F.explode(F.sequence(F.greatest(F.col("lo"), F.col("c") * chunk), F.least(F.col("hi"), F.col("c") * chunk + chunk - 1))).alias("cell")
    )
    time = F.conv(F.reverse(F.lpad(F.bin("cell"), bits, "0")), 2, 10).cast("long")
    slots = cells.select("source", "slots", "blocks", time.alias("time"), F.expr("0L").alias("c0")).withColumn("c0", F.expr(f"time div {chunk}"))
    counts = slots.groupBy("source", "c0").agg(F.count("*").alias("n"))
    counts = counts.select(
        F.col("source").alias("s1"), F.col("c0").alias("c1"),
        F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("c0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    inside = Window.partitionBy("source", "c0").orderBy("time")
    ranked = slots.withColumn("local", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts, ranked["source"].eqNullSafe(F.col("s1")) & (F.col("c0") == F.col("c1"))).withColumn("rank", F.col("base") + F.col("local"))
    return ranked.where("rank < slots").select("time", "source", "rank", F.expr("rank % blocks").alias("block"))


def mix_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, source, size, source_size, target, taken, first_slot, first_block, blocks; the schedule).

    ``first_slot`` is the time of the slot that takes the document's first word for the first time, null where none
    does. A null text has size 0, a null source is a source of its own (the last one), a null id is shuffled as the
    empty string, repeated rows each count, an empty table gives no rows. Other columns are ignored.
    """
    sizes = written(sized(docs, docs.count()), "mix-sizes")
    per = written(targets(sizes), "mix-targets")
    plan = written(schedule(per), "mix-schedule")
    repeats = plan.groupBy("source", "block").agg(F.count("*").alias("repeats")).select(F.col("source").alias("rs"), F.col("block").alias("rb"), "repeats")

    info = per.select(F.col("source").alias("ps"), "source_size", "target", F.col("block").alias("width"), "blocks")
    placed = positions(sizes.where("size > 0"))
    placed = placed.join(info, placed["source"].eqNullSafe(F.col("ps"))).drop("ps")
    last = F.col("blocks") - 1
    placed = placed.withColumn("first_block", F.least(F.expr("start div width"), last))
    end_block = F.least(F.expr("(start + size - 1) div width"), last)
    cut = placed.withColumn("b", F.explode(F.sequence("first_block", end_block)))
    block_end = F.when(F.col("b") == last, F.col("source_size")).otherwise((F.col("b") + 1) * F.col("width"))
    cut = cut.withColumn("part", F.least(F.col("start") + F.col("size"), block_end) - F.greatest(F.col("start"), F.col("b") * F.col("width")))
    joined = cut.join(repeats, cut["source"].eqNullSafe(F.col("rs")) & (F.col("b") == F.col("rb")), "left")
    keys = ["doc_id", "source", "start", "size", "source_size", "target", "first_block", "blocks"]
    taken = joined.groupBy(*keys).agg(F.sum(F.col("part") * F.coalesce(F.col("repeats"), F.lit(0))).cast("long").alias("taken")).drop("start")
    firsts = plan.where(F.col("rank") == F.col("block")).select(F.col("source").alias("fs"), F.col("rank").alias("fr"), F.col("time").alias("first_slot"))
    taken = taken.join(firsts, taken["source"].eqNullSafe(F.col("fs")) & (F.col("first_block") == F.col("fr")), "left").drop("fs", "fr")
    empty = sizes.where("size = 0")
    none = F.lit(None).cast("long")
    empty = empty.join(info, empty["source"].eqNullSafe(F.col("ps"))).select("doc_id", "source", "size", "source_size", "target", none.alias("first_block"), "blocks", F.lit(0).cast("long").alias("taken"), none.alias("first_slot"))
    return taken.unionByName(empty).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "first_block", "blocks"), plan


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them and in its order, same columns; the last time perhaps only their first words.

    A copy of a row stands at the time of the slot that takes its first word. The extra round of a source is the
    head of its stream, so a document in it is taken whole or from its start. Rows without words stay once, at
    the end. Ids are taken as unique: repeated ones share the largest number. Other columns, whatever their
    names, are carried along.
    """
    made, plan = mix_sources(docs)
    taken = made.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max_by(F.struct("taken", "size", "source", "first_block", "blocks"), F.struct("taken", "size", "source", "first_block")).alias("mix"))
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"))
    rows = rows.join(taken, F.col("row.doc_id").cast("string").eqNullSafe(F.col("id")), "left").select("row", "mix.*")
    rows = rows.withColumns({"whole": F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(1), "part": F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)})
    copies = (F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    rows = rows.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    times = plan.select(F.col("source").alias("ts"), F.col("rank").alias("tr"), "time")
    place = (F.col("copy") - 1) * F.col("blocks") + F.col("first_block")
    rows = rows.join(times, F.col("source").eqNullSafe(F.col("ts")) & (place == F.col("tr")), "left")
    head = F.expr(r"regexp_extract(row.text, concat('^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){0,', part, '}+'), 0)")
    cut = F.col("copy") > F.col("whole")
    rows = rows.withColumn("made", F.when(cut, head).otherwise(F.col("row.text"))).orderBy(F.col("time").asc_nulls_last(), "row.doc_id", "copy")
    new = {"text": F.col("made")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("made").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


OP6_SQL = rf"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as ord from documents),
per as (
  select source, sum(size)::bigint as source_size from sizes group by source),
weighed as (
  select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from per),
levels as (
  select *, (sum(source_size) over () - coalesce(sum({MAX_REPEATS} * source_size) over w, 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as lvl
  from weighed window w as (order by {MAX_REPEATS} * source_size / weight::double, weight, source nulls last rows between unbounded preceding and 1 preceding)),
water as (
  select *, (select coalesce(min_by(l.lvl, ({MAX_REPEATS} * l.source_size / l.weight::double, l.weight)), 0) from levels l where l.weight * l.lvl <= {MAX_REPEATS} * l.source_size) as final from levels),
aimed as (
  select source, source_size, least(weight * final, {MAX_REPEATS} * source_size)::double as target,
    greatest(1, least({BLOCK_WORDS}, source_size // {MIN_BLOCKS})) as block from water),
blocked as (
  select *, source_size // block as blocks, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as rounds from aimed),
slotted as (
  select *, least({MAX_REPEATS} * blocks, rounds * blocks + least(blocks, round((target - rounds * source_size) / block)::bigint)) as slots from blocked),
totals as (
  select greatest(sum(slots), 1)::double as n, greatest(1, ceil(log2(greatest(sum(slots), 2)::double)))::bigint as bits from slotted),
runs as (
  select source, slots, blocks, bits, floor((sum(slots) over w - slots) * (2.0::double ** bits / n))::bigint as lo, floor((sum(slots) over w) * (2.0::double ** bits / n))::bigint as upto
  from slotted, totals where slots > 0 window w as (order by source nulls last rows between unbounded preceding and current row)),
cells as (
  select source, slots, blocks, bits, unnest(range(lo, greatest(upto, lo + slots::bigint))) as cell from runs),
timed as (
  select source, slots, blocks, list_sum(list_transform(range(bits), lambda i: ((cell >> i) & 1) << (bits - 1 - i)))::bigint as time from cells),
ranked as (
  select source, slots, blocks, time, row_number() over (partition by source order by time) - 1 as rank from timed),
firsts as (
  select source, rank, time from ranked where rank < slots and rank < blocks),
placed as (
  select *, coalesce(sum(size) over (partition by source order by ord, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start from sizes)
select p.doc_id, p.size, s.source_size, s.target,
  case when p.size = 0 then 0 else ((slots // blocks) * p.size + greatest(0, least(p.size, (slots % blocks) * block - p.start)))::bigint end as taken,
  case when p.size > 0 then f.time end as first_slot
from placed p join slotted s on p.source is not distinct from s.source
left join firsts f on p.source is not distinct from f.source and f.rank = least(p.start // greatest(s.block, 1), s.blocks - 1)
"""
