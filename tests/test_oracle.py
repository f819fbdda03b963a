import pytest
from compare import SMALL, same

from stepweave.plans import registry

# Not stated in SQL: random draws, iterative algorithms, JSON with bare NaN.
ROWS_ONLY = {"random_alive", "agglomerative", "keyframes", "keyframe_totals", "contact_classes", "p2_found", "p2_nodes", "p2_bridge"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE[name])


def test_only_the_known_queries_lack_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
