"""Image files as rows of RGBA pixels, and the checks of what is to be encoded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import container

RGBA = "id long, width int, height int, rgba binary"
PIXELS = "id long, path string, width int, height int, rgba binary"
#: Sides of images that a container takes.
MAX_DIMENSION = 65536
#: Files of a folder that is read at once, on average.
FILES_AT_ONCE = 1 << 14


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """id (hash of the path), path, width, height, rgba of the images under a path, in the formats that Spark's image source reads.

    What cannot be read as an image has no pixels (nulls).
    """
    found = spark.read.format("image").load(path).select("image.*")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for height, width, channels, data in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                if channels not in (1, 3, 4) or width < 1 or height < 1:
                    out.append((None, None, None))
                    continue
                cube = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
                rgba = np.full((height, width, 4), 255, dtype=np.uint8)
                rgba[:, :, :3] = cube[:, :, 2::-1] if channels > 1 else cube  # stored as blue, green, red
                if channels == 4:
                    rgba[:, :, 3] = cube[:, :, 3]
                out.append((width, height, rgba.tobytes()))
            columns = zip(*out) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary())))], ["id", "path", "width", "height", "rgba"])

    rows = found.select(F.xxhash64("origin").alias("id"), "origin", "height", "width", "nChannels", "data")
    return rows.mapInArrow(turn, PIXELS)


def through_files(files: DataFrame, folder: str) -> DataFrame:
    """The rows of :func:`read_images` for images as bytes (name, content), which are written to a folder and read from there; both stay in it.

    Spark's image source lists its files in the driver. So they are dealt to folders of about ``FILES_AT_ONCE``, which are read one after the other into a table.
    """
    spark = files.sparkSession
    many = max(1, -(-files.count() // FILES_AT_ONCE))
    dealt = F.concat(F.pmod(F.xxhash64("name"), F.lit(many)).cast("string"), F.lit("/"), "name")
    names = container.write_whole(files.select(dealt.alias("name"), "content"), f"{folder}/files")
    held = sorted(r.held for r in names.select(F.split("name", "/")[0].cast("int").alias("held")).distinct().collect())  # a number for each folder
    for k in held:
        read_images(spark, f"{folder}/files/{k}").coalesce(spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/pixels/part={k}")
    return spark.read.parquet(f"{folder}/pixels").drop("part") if held else spark.createDataFrame([], PIXELS)


def input_violation(width: Column, height: Column, wanted_width: Column, wanted_height: Column) -> Column:
    """The first rule that an image breaks, or null: it has the size that the encoder is set to, and no side is too long."""
    return (
        F.when(width.isNull() | height.isNull(), "unreadable")
        .when((width != wanted_width) | (height != wanted_height), "size_differs")
        .when((width > MAX_DIMENSION) | (height > MAX_DIMENSION), "dimension_too_large")
    )
