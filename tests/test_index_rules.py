"""Index entries meet the metadata of their files part by part."""

import pytest

from tilewright.operators import tiles as T
from tilewright.plans import registry

from .compare import same
from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["flt12_validate", "flt8_index_rules"])
def test_no_index_is_sent_to_every_task(spark, duck, monkeypatch, name):
    """A file of a few bytes has thousands of entries, which no planner knows: an index is never what is broadcast."""
    monkeypatch.setattr(T, "FILES_AT_ONCE", 30, raising=False)
    df = registry.queries()[name](spark, SF)
    assert "Broadcast" not in plan(df) and "ShuffledHashJoin" in plan(df)
    same(df, duck.sql(registry.oracle_sql()[name]))


def test_parts_grow_with_the_files(spark, monkeypatch):
    meta = spark.range(1000).withColumnRenamed("id", "file_id")
    monkeypatch.setattr(T, "FILES_AT_ONCE", 30)
    assert T.by_file(meta).rdd.getNumPartitions() == 34
    assert T.by_file(meta.where("file_id < 0")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
