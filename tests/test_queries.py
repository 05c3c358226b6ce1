"""Every core query against its SQL on the smallest tables; the others must run."""

import pytest
from compare import differences

from foldspan.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tiny, name):
    assert differences(spark, tiny, name, catalog.QUERIES[name], catalog.ORACLE.get(name)) is None


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())


def test_core_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['foldspan.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests", 1)[0]).returncode == 0
