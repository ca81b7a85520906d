import pytest

from snapquarry.plans.queries import ORACLE_SQL, QUERIES

from .compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    got = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLE_SQL:
        assert got == duck_rows(ORACLE_SQL[name], SF)
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_exact_packing_matches_a_loop(spark):
    rows = QUERIES["pack_assign_exact"](spark, SF).orderBy("source", "doc_id", "seq").collect()
    last, no, held = None, 0, 8
    for r in rows:
        if r["source"] != last:
            last, no, held = r["source"], 0, 8
        assert r["pack_no"] == no
        held += r["length"]
        if held >= 65536:
            no, held = no + 1, 8
