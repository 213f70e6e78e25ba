"""Small scalar functions and fixed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of errors.
RECOVERABLE = ("tile_not_found", "network", "timeout")
SECURITY = ("checksum", "invalid_header")
EXTENSION_PREFIX = "extension."


def extension_ids(custom: Column) -> Column:
    """Ids of the extensions in a metadata map, in order."""
    keys = F.filter(F.map_keys(custom), lambda k: k.startswith(EXTENSION_PREFIX))
    return F.array_sort(F.transform(keys, lambda k: F.substr(k, F.lit(len(EXTENSION_PREFIX) + 1))))


def number_setting(settings: Column, path: str, default: float) -> Column:
    """A float or whole number in a JSON text, else ``default``."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(settings), path, "double"), F.lit(default))


def little_endian(content: Column, at: int, size: int) -> Column:
    """The unsigned number of ``size`` bytes at byte ``at`` (from 0) of a binary column; null beyond 63 bits."""
    part = F.substring(content, at + 1, size)
    big = F.concat(*(F.substring(part, k, 1) for k in range(size, 0, -1)))
    return F.conv(F.hex(big), 16, 10).try_cast("long")


def encode_errors(tile: Column, zoom: Column, threshold: Column, quality: Column) -> Column:
    """The first rule that encoder settings break, or null."""
    return (
        F.when(~tile.between(64, 2048) | (tile.bitwiseAND(tile - 1) != 0), "tile_size")
        .when(zoom > 20, "max_zoom")
        .when(~threshold.between(0.0, 1.0), "edge_threshold")
        .when(quality > 100, "quality")
    )


def chunk_size(n: Column, threads: int, strategy: str) -> Column:
    """Rows that a worker takes at once."""
    fixed = {"fixed": F.lit(64), "dynamic": F.floor(n / (4 * threads)), "adaptive": F.least(F.floor(n / threads), F.lit(4096)), "stealing": F.floor(n / (16 * threads))}
    return F.greatest(fixed[strategy], F.lit(1)).cast("long")
