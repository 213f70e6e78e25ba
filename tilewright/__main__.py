"""Commands on container files: encode, info, inspect, validate, extract."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import tiles as T
from .sources import container as S


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tilewright", description=__doc__)
    out.add_argument("command", choices=["encode", "info", "inspect", "validate", "extract"])
    out.add_argument("path", help="a file, a folder or a pattern, in any store that Spark reads; encode: of images")
    out.add_argument("--tile", help="extract: one tile, as level/x_y")
    out.add_argument("--level", type=int, help="extract: one level")
    out.add_argument("--out", help="extract: the folder for level_L/tile_X_Y.png, in folders of the files where there are several; encode: the folder for the files")
    out.add_argument("--tile-size", type=int, default=512, help="encode: a power of two from 64 to 2048")
    out.add_argument("--max-zoom", type=int, default=5, help="encode: the number of levels above the whole size, up to 20")
    out.add_argument("--edge-threshold", type=float, default=0.1, help="encode: how steep an edge has to be for a path, from 0 to 1")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: the files break rules or nothing was found; 2: wrong arguments."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tilewright").getOrCreate()
    if args.command == "encode":
        return encode(args, spark)
    files = S.read_files(spark, args.path)
    if args.command == "validate":
        broken = S.headers(files).withColumn("code", S.header_violation()).where("code is not null").select("file_id", "code")
        parts = S.sections(files)
        meta = S.parse_metadata(parts)
        damaged = meta.where("error is not null").select("file_id", F.lit("metadata").alias("code"))
        rules = meta.where("error is null").withColumn("code", T.metadata_violation()).where("code is not null").select("file_id", "code")
        outside = T.index_violations(S.parse_index(parts), meta.where("error is null")).select("file_id", F.concat(F.lit("index_"), "code").alias("code"))
        unsound = S.payloads(parts).where("not sound").select("file_id", F.lit("checksum").alias("code"))
        vectors = S.parse_vectors(parts).where("error is not null").select("file_id", F.lit("vectors").alias("code"))
        drawn = S.vector_violations(S.parse_paths(parts)).select("file_id", F.concat(F.lit("vector_"), "code").alias("code"))
        found = broken.unionByName(damaged).unionByName(vectors).unionByName(drawn).unionByName(rules).unionByName(outside).unionByName(unsound).groupBy("file_id", "code").count().orderBy("file_id", "code")
        rows = found.join(files.select("file_id", "path"), "file_id").collect()
        for r in rows:
            print(f"{r.path}\t{r.code}\t{r['count']}")
        return int(bool(rows))
    parts = S.sections(files)
    if args.command in ("info", "inspect"):
        meta = S.parse_metadata(parts)
        counted = S.parse_index(parts).groupBy("file_id").agg(F.count("*").alias("tiles"))
        body = F.struct(F.struct("width", "height").alias("dimensions"), "tile_size", "max_zoom_level", "tiles") if args.command == "info" else F.struct(*(c for c in meta.columns if c != "file_id"), "tiles")
        lines = meta.join(counted, "file_id", "left").select(F.to_json(body)).toLocalIterator()
        n = 0
        for n, line in enumerate(lines, 1):
            print(line[0])
        return int(n == 0)
    if not args.out:
        print("extract needs --out", file=sys.stderr)
        return 2
    entries = S.payloads(parts).where("sound")
    if args.tile:
        wanted = spark.createDataFrame([(args.tile,)], "spec string").select(*T.parse_spec(F.col("spec"))).first()
        if wanted.level is None:
            print(f"not a tile: {args.tile}", file=sys.stderr)
            return 2
        entries = entries.where((F.col("level") == wanted.level) & (F.col("x") == wanted.x) & (F.col("y") == wanted.y))
    elif args.level is not None:
        entries = entries.where(F.col("level") == args.level)
    several = files.limit(2).count() > 1
    rows = S.write_tiles(entries, args.out, several).orderBy("level").collect()
    for r in rows:
        print(f"level {r.level}: {r.tiles} tiles")
    return int(not rows)


def encode(args: argparse.Namespace, spark: SparkSession) -> int:
    """A file of the image's name and the ending .vera for each image under the path."""
    from .operators import encoder
    from .sources import images as I

    wrong = spark.range(1).select(scalars.encode_errors(F.lit(args.tile_size), F.lit(args.max_zoom), F.lit(args.edge_threshold), F.lit(0)).alias("code")).first()["code"]
    if wrong or not args.out:
        print(f"wrong {wrong}" if wrong else "encode needs --out", file=sys.stderr)
        return 2
    found = I.read_images(spark, args.path)
    odd = found.where(I.input_violation(F.col("width"), F.col("height"), F.col("width"), F.col("height")).isNotNull()).select("path").collect()
    for r in odd:
        print(f"not encoded: {r['path']}", file=sys.stderr)
    sound = found.where(I.input_violation(F.col("width"), F.col("height"), F.col("width"), F.col("height")).isNull())
    steep = 255 * 4 * args.edge_threshold  # the largest gradient of a step from black to white
    made = encoder.encode(sound, args.tile_size, args.max_zoom, steep / 2, steep)
    name = F.concat(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), F.lit(".vera"))
    rows = S.write_whole(made.join(sound.select(F.col("id").alias("file_id"), name.alias("name")), "file_id"), args.out).collect()
    for r in sorted(rows):
        print(r["name"])
    return int(not rows or bool(odd))


if __name__ == "__main__":
    sys.exit(main())
