import pytest

from landloom import queries


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracles()[name])
