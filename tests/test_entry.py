"""Driver contract: entry() runs, every query has an oracle, names line up."""

import __spark_entry__ as contract


def test_contract(spark):
    qs, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 50
    df = contract.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"stat", "item", "count", "rank"}
