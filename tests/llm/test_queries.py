"""The registered queries against their SQL."""

import pytest
from compare import differences

from terraloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    ours, theirs, only_ours, only_theirs = differences(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert ours == theirs
    assert not only_ours and not only_theirs, (only_ours, only_theirs)
