"""A Merkle manifest of a table, built and checked by supersteps of messages between RDDs of vertices.

Rows are leaves, ordered by id within their source; up to ``FAN`` consecutive nodes are a run, whose parent hashes
them. Upward, every node sends its digest to its parent; a parent that has heard all its children hashes them and
sends on, until each tree is down to one node. The roots of the sources are the leaves of one more tree. In reverse,
parents send every child the siblings that it needs to prove itself, down to the leaves, which fold their own digest
up again and compare it with the root.

A parent hears at most ``FAN`` children, so no source, however large, gathers in a task. Each superstep is written to
the shared folder: lost executors cost a step. Order within sources comes from one range partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "tree long, run long, n long, digests array<string>, ids array<long>, others array<string>"
STEPS = "array<struct<slot: int, siblings: array<string>>>"
#: Vertices that a partition has at least, where steps get short.
STEP_ROWS = 20_000


def hashed(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a row, with ``text`` for its text."""
    return F.sha2(F.concat(*(encoded(text if f == "text" else F.col(f)) for f in fields)).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, LOWER)


def is_tampered(doc_id: Column) -> Column:
    """5 divides the checksum of the decimal id. A null id has none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in its group, by ``order``), ``n`` (rows of the group) and ``tree`` (the group's own rank).

    Nulls come first. One range partitioning by group and order; offsets are sums over partitions, so a group that
    holds most rows is spread. ``rows`` has a column ``tie`` that tells equal rows apart.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "tie")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = written(ordered.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "merkle-ordered")
    pieces = ordered.groupBy("part", group).agg(F.min("place").alias("first"), F.count("*").alias("held"))
    pieces = written(pieces, "merkle-pieces")  # a row for each group and partition that has some of it
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({"skipped": F.coalesce(F.sum("held").over(before), F.lit(0)), "n": F.sum("held").over(Window.partitionBy(group))})
    # The first piece of each group, in order of partitions and places, numbers the groups.
    firsts = pieces.where("skipped = 0").select("part", "first")
    counts = firsts.groupBy("part").agg(F.count("*").alias("groups"))
    earlier = counts.withColumn("passed", F.coalesce(F.sum("groups").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = firsts.join(earlier.select("part", "passed"), "part").withColumn("tree", F.col("passed") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1)
    tree = pieces.where("skipped = 0").join(numbered.select("part", "first", "tree"), ["part", "first"]).select(F.col(group).alias("of"), "tree")
    pieces = pieces.join(tree, pieces[group].eqNullSafe(tree["of"])).select("part", F.col(group).alias("of"), "first", "skipped", "n", "tree")
    held = ordered.alias("o").join(pieces.alias("p"), (F.col("o.part") == F.col("p.part")) & F.col(f"o.{group}").eqNullSafe(F.col("p.of")))
    return held.select("o.*", (F.col("o.place") - F.col("p.first") + F.col("p.skipped")).alias("rank"), "p.n", "p.tree").drop("part", "place")


def parts_for(rdd: RDD, rows: int) -> int:
    return max(1, min(rdd.getNumPartitions(), -(-rows // STEP_ROWS)))


def climb(nodes: RDD, total: int, name: str) -> list[DataFrame]:
    """Supersteps upward: the runs of each level. ``nodes`` are (tree, rank, n, digest, id, other) with n nodes in the tree.

    A level is a table of runs (tree, run, n: nodes of the tree at this level, their digests, ids and others in order). Trees
    of one node have no runs.
    """
    spark = nodes.ctx  # the context; tables are made by its session
    levels: list[DataFrame] = []

    def complete(messages: Iterator) -> Iterator[tuple]:
        for (tree, run), heard in messages:
            heard = sorted(heard, key=lambda m: m[0])
            n = heard[0][1]
            assert len(heard) == min(FAN, n - FAN * run)  # all children have spoken
            yield tree, run, n, [m[2] for m in heard], [m[3] for m in heard], [m[4] for m in heard]

    while True:
        sent = nodes.filter(lambda v: v[2] > 1).map(lambda v: ((v[0], v[1] // FAN), (v[1] % FAN, *v[2:])))
        runs = sent.groupByKey(parts_for(nodes, total)).mapPartitions(complete)
        level = written(_session(spark).createDataFrame(runs, RUNS, verifySchema=False), name)
        if level.isEmpty():
            return levels
        levels.append(level)
        total = -(-total // FAN)
        nodes = level.rdd.map(lambda r: (r.tree, r.run, -(-r.n // FAN), hashed(r.digests), None, None))


def _session(context):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession(context)


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, height, digest of the last node of each tree. ``nodes``: tree, n, digest of the leaves."""
    digest = F.sha2(F.array_join("digests", "").cast("binary"), 256).alias("digest")
    found = nodes.where("n = 1").select("tree", F.lit(0).alias("height"), "digest")
    for k, level in enumerate(levels):
        found = found.unionByName(level.where(F.col("n") <= FAN).select("tree", F.lit(k + 1).alias("height"), digest))
    return found


def descend(levels: list[DataFrame], starts: DataFrame, name: str) -> DataFrame:
    """Reverse supersteps: tree, rank, top, steps of every parent of leaves (rank: its run), and of the leaf of each tree that is one.

    ``starts`` has tree, height, top (anything that the leaves of the tree are told) and steps (those above its last node). A step is a place among
    siblings, and the siblings' digests in order; steps go upward.
    """
    spark = starts.sparkSession
    above = None
    for k in reversed(range(len(levels))):
        begun = starts.where(F.col("height") == k + 1).select("tree", F.lit(0).cast("long").alias("rank"), "top", "steps")
        above = begun if above is None else above.unionByName(begun)
        if k == 0:
            break
        told = above.rdd.map(lambda r: ((r.tree, r.rank), (r.top, r.steps)))
        runs = levels[k].rdd.map(lambda r: ((r.tree, r.run), r.digests))

        def pass_on(kv: tuple) -> Iterator[tuple]:
            (tree, run), (digests, (top, steps)) = kv
            for slot in range(len(digests)):
                yield tree, run * FAN + slot, top, [(slot, digests[:slot] + digests[slot + 1 :]), *steps]

        sent = runs.join(told, max(1, runs.getNumPartitions())).flatMap(pass_on)
        above = written(spark.createDataFrame(sent, f"tree long, rank long, top string, steps {STEPS}", verifySchema=False), name)
    return above if above is not None else starts.limit(0).select("tree", F.lit(0).cast("long").alias("rank"), "top", "steps")


def folded(digest: str, steps: Iterable) -> str:
    """The root that ``digest`` and its siblings give."""
    for slot, siblings in steps:
        digest = hashed([*siblings[:slot], digest, *siblings[slot:]])
    return digest


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``folded_root`` is what the siblings make of the row as it is found after tampering, which lower-cases the texts of some ids
    (:func:`is_tampered`). A null source is one of its own and comes first, null ids come first in their source; ids that are
    repeated stand in the order of their digests. A tree of one leaf is its leaf. No rows give none. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text")
    bent = F.when(is_tampered(F.col("doc_id")) & text.isNotNull(), leaf_of(lowered(text)))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_of(text).alias("leaf"), bent.alias("bent"))
    leaves = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = written(placed(leaves, "source", ["doc_id", "leaf"]).select("tree", "rank", "n", F.col("leaf").alias("digest"), "doc_id", "bent"), "merkle-nodes")
    levels = climb(leaves.rdd.map(tuple), leaves.count(), "merkle-runs")
    roots = written(tops(leaves, levels), "merkle-subroots")
    trees = roots.count()
    if not trees:
        return spark.createDataFrame([], MANIFEST)
    upper = climb(roots.rdd.map(lambda r: (0, r.tree, trees, r.digest, None, None)), trees, "merkle-upper")
    root = tops(roots.select(F.lit(0).alias("tree"), F.lit(trees).alias("n"), "digest"), upper).first()
    top = spark.createDataFrame([(0, root["height"], root["digest"], [])], f"tree long, height int, top string, steps {STEPS}")
    steps = parted(upper, descend(upper, top, "merkle-proofs"), FAN) if upper else roots.select("tree", F.expr(f"cast(array() as {STEPS})").alias("steps"))
    starts = roots.join(steps, "tree").select("tree", "height", F.col("digest").alias("top"), "steps")
    starts = written(starts, "merkle-starts")
    whole = root["digest"]

    def proved(doc_id: int | None, leaf: str, other: str | None, subroot: str, steps: list) -> tuple:
        found = folded(other or leaf, steps)
        return doc_id, leaf, subroot, whole, hashed(x for _, siblings in steps for x in siblings), found, found == whole

    def prove(kv: tuple) -> Iterator[tuple]:
        _, ((digests, ids, others), (subroot, steps)) = kv
        for slot, (digest, doc_id, other) in enumerate(zip(digests, ids, others)):
            yield proved(doc_id, digest, other, subroot, [(slot, digests[:slot] + digests[slot + 1 :]), *steps])

    alone = leaves.where("n = 1").join(starts, "tree").rdd.map(lambda r: proved(r.doc_id, r.digest, r.bent, r.top, r.steps))
    if not levels:
        return spark.createDataFrame(alone, MANIFEST, verifySchema=False)
    told = descend(levels, starts, "merkle-paths").rdd.map(lambda r: ((r.tree, r.rank), (r.top, r.steps)))
    runs = levels[0].rdd.map(lambda r: ((r.tree, r.run), (r.digests, r.ids, r.others)))
    return spark.createDataFrame(runs.join(told, runs.getNumPartitions()).flatMap(prove).union(alone), MANIFEST, verifySchema=False)


def parted(upper: list[DataFrame], told: DataFrame, fan: int) -> DataFrame:
    """tree, steps of the leaves of the upper tree, whose rank is the number of a source's tree."""
    spark = told.sparkSession
    heard = told.rdd.map(lambda r: (r.rank, r.steps))

    def pass_on(kv: tuple) -> Iterator[tuple]:
        run, (digests, steps) = kv
        for slot in range(len(digests)):
            yield run * fan + slot, [(slot, digests[:slot] + digests[slot + 1 :]), *steps]

    runs = upper[0].rdd.map(lambda r: (r.run, r.digests))
    return spark.createDataFrame(runs.join(heard, runs.getNumPartitions()).flatMap(pass_on), f"tree long, steps {STEPS}", verifySchema=False)


OP12_SQL = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text,
    (CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END)
    || (CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END)
    || (CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END)
    || (CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    translate(text, '{UPPER}', '{LOWER}') AS low,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for d in regexp_extract_all(doc_id::VARCHAR, '.')])),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS crc
  FROM documents),
leaves AS MATERIALIZED (
  SELECT doc_id, source, leaf, bent, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM (
    SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
      CASE WHEN crc % 5 = 0 AND text IS NOT NULL THEN sha256(head || strlen(low) || ':' || low) END AS bent FROM fields)),
climb AS (
  SELECT source, 0 AS level, rank AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, level + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)), (n + {FAN - 1}) // {FAN} FROM climb WHERE n > 1 GROUP BY source, level, n, i // {FAN}),
nodes AS MATERIALIZED (SELECT * FROM climb),
subroots AS MATERIALIZED (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, tree AS i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)), (n + {FAN - 1}) // {FAN} FROM upper WHERE n > 1 GROUP BY level, n, i // {FAN}),
above AS MATERIALIZED (SELECT * FROM upper),
proofs AS (
  SELECT doc_id, leaf, source, coalesce(bent, leaf) AS h, rank AS i, 0 AS level, '' AS proof FROM leaves
  UNION ALL
  SELECT p.doc_id, p.leaf, p.source,
    sha256(string_agg(CASE WHEN c.i = p.i THEN p.h ELSE c.h END, '' ORDER BY c.i)), p.i // {FAN}, p.level + 1,
    p.proof || coalesce(string_agg(c.h, '' ORDER BY c.i) FILTER (WHERE c.i <> p.i), '')
  FROM proofs p JOIN nodes c ON c.source IS NOT DISTINCT FROM p.source AND c.level = p.level AND c.n > 1 AND c.i // {FAN} = p.i // {FAN}
  GROUP BY p.doc_id, p.leaf, p.source, p.h, p.i, p.level, p.proof),
reached AS MATERIALIZED (
  SELECT p.doc_id, p.leaf, s.subroot, s.tree, p.h, p.proof FROM proofs p
  JOIN nodes c ON c.source IS NOT DISTINCT FROM p.source AND c.level = p.level AND c.n = 1 JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source),
whole AS (
  SELECT doc_id, leaf, subroot, h, tree AS i, 0 AS level, proof FROM reached
  UNION ALL
  SELECT p.doc_id, p.leaf, p.subroot,
    sha256(string_agg(CASE WHEN c.i = p.i THEN p.h ELSE c.h END, '' ORDER BY c.i)), p.i // {FAN}, p.level + 1,
    p.proof || coalesce(string_agg(c.h, '' ORDER BY c.i) FILTER (WHERE c.i <> p.i), '')
  FROM whole p JOIN above c ON c.level = p.level AND c.n > 1 AND c.i // {FAN} = p.i // {FAN}
  GROUP BY p.doc_id, p.leaf, p.subroot, p.h, p.i, p.level, p.proof)
SELECT w.doc_id, w.leaf, w.subroot, a.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = a.h AS verified
FROM whole w JOIN above a ON a.level = w.level AND a.n = 1
"""
