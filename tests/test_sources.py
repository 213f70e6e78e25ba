import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.functions import plugins
from tilewright.plans import source_queries as Q
from tilewright.sources import codecs
from tilewright.sources import container as S

from .conftest import SF

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text() | st.binary(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=20)


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_cbor_round_trip(value):
    assert codecs.from_cbor(codecs.to_cbor(value)) == value


def test_cbor_damage():
    for data in (b"", b"\x62a", b"\x01\x01", b"\xc0\x00", b"\x9f"):
        with pytest.raises(ValueError):
            codecs.from_cbor(data)


def test_png_round_trip_and_filters():
    image = np.random.default_rng(1).integers(0, 256, (7, 5, 4)).astype(np.uint8)
    assert (codecs.from_png(codecs.to_png(image)) == image).all()
    above, row = image[0].ravel(), image[1].ravel().astype(int)
    up = above.astype(int)
    left = np.concatenate((np.zeros(4, int), row[:-4]))
    corner = np.concatenate((np.zeros(4, int), up[:-4]))
    p = left + up - corner
    d = np.abs(np.stack((p - left, p - up, p - corner)))
    guess = np.choose(d.argmin(axis=0), (left, up, corner))
    for kind, predicted in ((0, 0 * row), (1, left), (2, up), (3, (left + up) // 2), (4, guess)):
        stored = ((row - predicted) & 255).astype(np.uint8)
        assert (codecs.unfilter(kind, stored, above, 4) == row).all()


def test_files_from_disk(spark, tmp_path):
    """Written files read again by the binary reader give the pixels back."""
    for r in Q.files(spark, SF).limit(3).collect():
        (tmp_path / f"{r.file_id}.bin").write_bytes(r.content)
    files = S.read_files(spark, str(tmp_path))
    tiles = S.decode_tiles(S.payloads(S.sections(files)))
    assert tiles.count() == 12 and tiles.where("error is not null").count() == 0
    assert {(r.width, len(r.rgba)) for r in tiles.collect()} == {(4, 64)}
    assert S.parse_metadata(S.sections(files)).where("error is null and width = 8").count() == 3


def test_damage_gives_rows(spark):
    files = spark.createDataFrame([(1, b""), (2, b"\x00" * 64), (3, bytes.fromhex(S.MAGIC_HEX) + b"\xff" * 60), (4, None)], "file_id long, content binary")
    codes = {r.file_id: r.code for r in S.headers(files).select("file_id", S.header_violation().alias("code")).collect()}
    assert codes[1] == "short" and codes[2] == "magic" and codes[3] is not None
    parts = spark.createDataFrame([(1, b"\x01\x00\x00\x00abc"), (2, b"\x00\x00\x00\x00"), (3, b"")], "file_id long, index binary")
    assert S.parse_index(parts).count() == 0
    bad = spark.createDataFrame([(1, b"\xff"), (2, codecs.to_cbor({"width": 1}))], "file_id long, metadata binary")
    assert S.parse_metadata(bad).where("error is null").count() == 0
    tiles = spark.createDataFrame([(1, 0, 0, 0, b"no image")], "file_id long, level long, x long, y long, payload binary")
    assert S.decode_tiles(tiles).first().error


def test_tiles_written_side_by_side(spark, tmp_path):
    tiles = S.encode_tiles(Q.grey_tiles(spark, SF).where("file_id = 1"))
    assert [tuple(r) for r in S.write_tiles(tiles, f"file://{tmp_path}").collect()] == [(0, 4)]
    assert sorted(p.name for p in (tmp_path / "level_0").glob("*.png")) == ["tile_0_0.png", "tile_0_1.png", "tile_1_0.png", "tile_1_1.png"]


def test_plugins(spark):
    with pytest.raises(ValueError):
        plugins.REGISTRY.apply_filter("brightness", spark.range(1), {"brightness": 101})
    with pytest.raises(KeyError):
        plugins.REGISTRY.get("brightness", "compression")
    df = spark.createDataFrame([(b"abc" * 100,), (b"",), (None,)], "v binary")
    back = plugins.Deflate().decompress(plugins.Deflate().compress(F.col("v")))
    assert df.where(~back.eqNullSafe(F.col("v"))).count() == 0


def test_plugin_configs_round_trip(spark, tmp_path):
    made = spark.createDataFrame([("a", True, 3, '{"k": [1, {"x": 2.5}]}'), ("b", False, 0, None)], plugins.CONFIG).withColumn("settings", F.parse_json("settings"))
    plugins.write_configs(made, f"file://{tmp_path}/configs")
    got = plugins.read_configs(spark, f"file://{tmp_path}/configs").select("id", "enabled", "priority", F.try_variant_get("settings", "$.k[1].x", "double").alias("x"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", True, 3, 2.5), ("b", False, 0, None)]


def test_plugins_are_discovered_and_configured(spark, tmp_path, monkeypatch):
    (tmp_path / "own_plugins.py").write_text("from tilewright.functions.plugins import Identity\nclass Mine(Identity):\n    id = 'mine'\nPLUGINS = [Mine]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    registry = plugins.Registry()
    assert registry.discover(modules=["own_plugins"]) == ["mine"] and registry.get("mine", "compression")
    with pytest.raises(ImportError, match="not_there"):
        registry.discover(modules=["not_there"])
    rows = [("brightness", True, 1, '{"brightness": 10}'), ("brightness", True, 5, '{"brightness": 30}'), ("brightness", False, 9, '{"brightness": 50}'), ("other", True, 9, "{}")]
    configs = spark.createDataFrame(rows, plugins.CONFIG).withColumn("settings", F.parse_json("settings"))
    assert plugins.config_of(configs, plugins.Brightness()) == {"brightness": 30.0}
    assert plugins.config_of(configs.where("id = 'x'"), plugins.Brightness()) == {"brightness": 0}
    with pytest.raises(ValueError):
        plugins.config_of(configs.withColumn("settings", F.parse_json(F.lit('{"brightness": 500}'))), plugins.Brightness())
