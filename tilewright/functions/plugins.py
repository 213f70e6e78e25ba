"""Plugins as Python classes behind one registry: column filters, binary codecs, renderers, formats of extensions."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterable
from dataclasses import dataclass, field
from importlib import import_module
from importlib.metadata import entry_points

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Plugin(ABC):
    id: str
    kind: str
    version = "1.0.0"
    description = ""
    #: Parameter name: (default, smallest, largest).
    parameters: dict[str, tuple[float, float, float]] = {}

    def values(self, given: dict) -> dict:
        """All parameters, those not given by default; unknown ones and values out of range are errors."""
        if unknown := set(given) - set(self.parameters):
            raise ValueError(f"{self.id}: unknown parameters {sorted(unknown)}")
        out = {name: given.get(name, default) for name, (default, _, _) in self.parameters.items()}
        for name, (_, low, high) in self.parameters.items():
            if not low <= out[name] <= high:
                raise ValueError(f"{self.id}: {name} must be from {low} to {high}")
        return out


class Filter(Plugin):
    kind = "filter"

    @abstractmethod
    def apply(self, pixels: DataFrame, values: dict) -> DataFrame:
        """``pixels`` with changed channels."""


class Compression(Plugin):
    kind = "compression"

    @abstractmethod
    def compress(self, data: Column) -> Column: ...

    @abstractmethod
    def decompress(self, data: Column) -> Column: ...


class Renderer(Plugin):
    kind = "renderer"

    @abstractmethod
    def render(self, files: DataFrame, regions: DataFrame, values: dict) -> DataFrame:
        """file_id, x, y, r, g, b, a of regions of files."""


class Format(Plugin):
    """An extension of the metadata: JSON under the key ``extension.<id>``."""

    kind = "format"

    @abstractmethod
    def parse(self, text: Column) -> Column:
        """The extension's value from its JSON."""

    @abstractmethod
    def serialize(self, value: Column) -> Column: ...


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)

    def register(self, plugin: Plugin) -> Plugin:
        """Adds a plugin; a later one with the same id takes its place."""
        self.plugins[plugin.id] = plugin
        return plugin

    def get(self, name: str, kind: str) -> Plugin:
        plugin = self.plugins.get(name)
        if plugin is None or plugin.kind != kind:
            raise KeyError(f"no {kind} plugin {name}")
        return plugin

    def apply_filter(self, name: str, pixels: DataFrame, given: dict) -> DataFrame:
        plugin = self.get(name, "filter")
        return plugin.apply(pixels, plugin.values(given))

    def discover(self, group: str = "tilewright.plugins", modules: Iterable[str] = ()) -> list[str]:
        """Registers the plugins of installed packages (entry points of ``group``) and of modules; returns the ids.

        An entry point names a plugin class, a module holds them under ``PLUGINS``. Only Python code is loaded. What
        cannot be loaded is an error that names it.
        """
        found = [(e.name, e.load) for e in entry_points(group=group)]
        found += [(name, lambda name=name: list(import_module(name).PLUGINS)) for name in modules]
        ids = []
        for name, load in found:
            try:
                made = load()
                classes = made if isinstance(made, list) else [made]
                ids += [self.register(c()).id for c in classes]
            except Exception as e:
                raise ImportError(f"plugin {name}: {e}") from e
        return ids

    def catalog(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.id, p.kind, p.version) for p in self.plugins.values()], "id string, kind string, version string")


REGISTRY = Registry()


class Brightness(Filter):
    id, description = "brightness", "Adds to red, green and blue."
    parameters = {"brightness": (0, -100, 100)}

    def apply(self, pixels: DataFrame, values: dict) -> DataFrame:
        from ..operators.pixels import brightness

        return brightness(pixels, int(values["brightness"]))


class Identity(Compression):
    id, description = "identity", "Leaves bytes as they are."

    def compress(self, data: Column) -> Column:
        return data

    decompress = compress


class Deflate(Compression):
    id, description = "deflate", "Raw deflate streams."

    def __init__(self, level: int = 6):
        self.level = level

    def compress(self, data: Column) -> Column:
        level = self.level

        @F.pandas_udf("binary")
        def pack(values: pd.Series) -> pd.Series:
            def one(v):
                c = zlib.compressobj(level, zlib.DEFLATED, -15)
                return c.compress(v) + c.flush()

            return values.map(one, na_action="ignore")

        return pack(data)

    def decompress(self, data: Column) -> Column:
        @F.pandas_udf("binary")
        def unpack(values: pd.Series) -> pd.Series:
            return values.map(lambda v: zlib.decompress(v, -15), na_action="ignore")

        return unpack(data)


class Plain(Renderer):
    id, description = "plain", "Tiles with the vector layers drawn over them."

    def render(self, files: DataFrame, regions: DataFrame, values: dict) -> DataFrame:
        from ..operators.encoder import render

        return render(files, regions)


class Geo(Format):
    id, description = "geo", "A place: longitude and latitude."

    def parse(self, text: Column) -> Column:
        return F.from_json(text, "lon double, lat double")

    def serialize(self, value: Column) -> Column:
        return F.to_json(value)


for _plugin in (Brightness(), Identity(), Plain(), Geo()):
    REGISTRY.register(_plugin)


def add_extension(custom: Column, name: str, version: str, size: Column) -> Column:
    """A metadata map with one more extension, described as JSON; an older one of the name is replaced."""
    rest = F.map_filter(custom, lambda k, _: k != f"extension.{name}")
    return F.map_concat(rest, F.create_map(F.lit(f"extension.{name}"), F.to_json(F.struct(F.lit(name).alias("id"), F.lit(version).alias("version"), size.alias("size")))))


def extension_size(custom: Column, name: str) -> Column:
    return F.get_json_object(F.try_element_at(custom, F.lit(f"extension.{name}")), "$.size").cast("long")


CONFIG = "id string, enabled boolean, priority int, settings string"


def read_configs(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """Plugin configurations from JSON files, one object a line, with ``more`` columns; settings are any JSON, as a variant."""
    return spark.read.schema(f"{CONFIG}, {more}" if more else CONFIG).json(path).withColumn("settings", F.try_parse_json("settings"))


def config_of(configs: DataFrame, plugin: Plugin, path: str = "$") -> dict:
    """The values of a plugin's parameters from its enabled configuration with the highest priority, those not given by default."""
    wanted = [F.try_variant_get("settings", f"{path}.{name}", "double").alias(name) for name in plugin.parameters]
    row = configs.where((F.col("id") == plugin.id) & F.col("enabled")).orderBy(F.desc("priority")).select(*wanted, F.lit(1).alias("found")).first()
    given = {} if row is None else {name: row[name] for name in plugin.parameters if row[name] is not None}
    return plugin.values(given)


def write_configs(configs: DataFrame, path: str) -> None:
    configs.withColumn("settings", F.to_json("settings")).write.mode("overwrite").json(path)


def config_violations(configs: DataFrame, registry: Registry) -> DataFrame:
    """Adds code: the first rule that a configuration breaks, or null. Settings must be an object of the plugin's parameters, each a number in its range; none at all are fine."""
    rules = F.lit("unknown_plugin")
    for plugin in registry.plugins.values():
        own = F.lit(None).cast("string")
        for name, (_, low, high) in reversed(plugin.parameters.items()):
            given, number = (F.try_variant_get("settings", f"$.{name}", kind) for kind in ("variant", "double"))
            own = F.when(given.isNotNull() & number.isNull(), f"not_a_number:{name}").when(~number.between(low, high), f"out_of_range:{name}").otherwise(own)
        keys = F.map_keys(F.try_variant_get("settings", "$", "map<string, variant>"))
        unknown = F.filter(keys, lambda k: ~k.isin(*plugin.parameters) if plugin.parameters else F.lit(True))  # noqa: B023
        own = F.when(F.col("settings").isNotNull() & keys.isNull(), "not_an_object").when(F.size(F.coalesce(unknown, F.array().cast("array<string>"))) > 0, F.concat(F.lit("unknown_parameter:"), F.array_min(unknown))).otherwise(own)
        rules = F.when(F.col("id") == plugin.id, own).otherwise(rules)
    return configs.withColumn("code", rules)


def chosen_configs(configs: DataFrame, plugin: Plugin, by: list[str], tie: str) -> DataFrame:
    """by and the plugin's parameters: for each group the values of its enabled configuration with the highest priority (then the smallest ``tie``); those not given by default."""
    values = [F.coalesce(F.try_variant_get("settings", f"$.{name}", "double"), F.lit(float(default))).alias(name) for name, (default, _, _) in plugin.parameters.items()]
    own = configs.where((F.col("id") == plugin.id) & F.col("enabled")).select(*by, F.struct("priority", (-F.col(tie)).alias("last")).alias("rank"), F.struct(*values).alias("values"))
    return own.groupBy(*by).agg(F.max_by("values", "rank").alias("values")).select(*by, "values.*")
