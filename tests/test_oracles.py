"""Every query of the library's own operators against the SQL that states its result."""

import pytest
from compare import differences

from terraloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    ours, theirs, only_ours, only_theirs = differences(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert ours == theirs
    assert not only_ours and not only_theirs, (only_ours, only_theirs)


def test_every_query_has_sql_or_a_brute_force_test():
    import test_without_sql

    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == set(test_without_sql.NAMES)
