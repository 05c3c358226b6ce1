"""Every corpus query against its SQL on the smallest tables; the others must run."""

import pytest
from compare import differences

from foldspan.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tiny, name):
    assert differences(spark, tiny, name, catalog.QUERIES[name], catalog.ORACLE.get(name)) is None
