"""Every query of the registry that SQL can express, against its SQL; test_vision holds the others."""

import pytest

from tilewright.plans import registry

from .compare import same
from .conftest import SF

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.sql(SQL[name]))
