import pytest

from landloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_has_one_query(n):
    assert len([q for q in registry.QUERIES if q.startswith(f"op{n}_")]) == 1
