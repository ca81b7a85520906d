import pytest

from snapquarry.llm.queries import ORACLE_SQL, QUERIES

from ..compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_agrees_with_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(ORACLE_SQL[name], SF)


def test_all_ten_and_the_pipeline_are_there():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in QUERIES
