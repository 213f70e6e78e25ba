"""Queries read whole tables, and components have no limit of size."""

import pytest

from tilewright.operators import pixels
from tilewright.plans import registry

from .conftest import SF


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_query_has_a_filter_on_ids(name):
    text = registry.oracle_sql().get(name, "")
    assert not any(cut in text for cut in ("vec_id <", "event_id <", "file_id % 50", "request_id <", "event_id % 10 = 0"))


def spiral(side):
    """Cells of a square spiral one wide with gaps of one: one component, as long as a third of the square."""
    cells, x, y, dx, dy = {(0, 0)}, 0, 0, 1, 0
    inside = lambda a, b: 0 <= a < side and 0 <= b < side
    while True:
        ahead = (x + 2 * dx, y + 2 * dy)
        if not inside(x + dx, y + dy) or (inside(*ahead) and ahead in cells):
            dx, dy = -dy, dx
            if not inside(x + dx, y + dy) or (x + dx, y + dy) in cells or (x + 2 * dx, y + 2 * dy) in cells:
                return cells
        x, y = x + dx, y + dy
        cells.add((x, y))


def test_components_of_long_paths(spark):
    cells = spiral(300)
    assert len(cells) > 20_000
    rows = [(1, x, y, 200) for x, y in cells] + [(2, x, 5, 200) for x in range(80)] + [(3, 9, 9, 200), (3, 20, 20, 10), (4, 0, 3, 200), (4, 65535, 2, 200)]
    got = pixels.labels8(spark.createDataFrame(rows, "vec_id long, x int, y int, g int"), ["vec_id"]).collect()
    assert len(got) == len(rows) - 1
    labels = {}
    for r in got:
        labels.setdefault(r.vec_id, set()).add(r.label)
    assert labels == {1: {0}, 2: {5 * 65536}, 3: {9 * 65537}, 4: {3 * 65536, 2 * 65536 + 65535}}


def test_existing_tiles_of_a_wide_level(spark, tmp_path):
    rows = [(0, 0, 1.0), (8191, 5, 2.0), (8192, 5, 3.0), (19_999, 9_000, 4.0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["jn3_existing_tiles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0), (1, 63, 0), (1, 64, 0), (1, 156, 70)]
    spark.createDataFrame([], "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/none/lineitem.parquet")
    assert registry.queries()["jn3_existing_tiles"](spark, f"{tmp_path}/none").count() == 0


def test_whole_regions_are_of_both_kinds(spark, duck):
    want = {kind: duck.sql(f"select count(*) from {table}").fetchall()[0][0] for kind, table in (("vector", "part"), ("raster", "supplier"))}
    query, text = registry.queries()["prj13_whole_regions"], registry.oracle_sql()["prj13_whole_regions"]
    assert {r.region_type: r["count"] for r in query(spark, SF).groupBy("region_type").count().collect()} == want
    assert dict(duck.sql(f"select region_type, count(*) from ({text}) group by 1").fetchall()) == want
