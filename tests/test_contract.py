import __spark_entry__ as entry_module
from checks.oracles import ORACLES
from checks.queries import QUERIES


def test_entry_and_registration(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["path", "count", "avg_latency", "error_rate"]
    assert df.count() > 0
    names = entry_module.queries()
    assert set(QUERIES) <= set(names)
    assert set(entry_module.oracle_sql()) <= set(names)
    assert set(QUERIES) == set(ORACLES)
