import pytest

from checks.compare import database, difference
from palisade.llm.oracles import statements
from palisade.llm.queries import queries


@pytest.mark.parametrize("name", sorted(statements()))
def test_query_equals_its_sql(spark, small, name):
    assert difference(queries()[name](spark, small), database(small), statements()[name]) is None


def test_one_query_for_each_operator():
    names = list(queries())
    assert [int(n[2:].split("_")[0]) for n in names if n.startswith("op")] == list(range(1, 14)) and "pipeline" in names
