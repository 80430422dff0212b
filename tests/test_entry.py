"""Driver contract: entry, queries and oracle keys."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 12 and "missing_pct" in df.columns


def test_oracles_are_for_registered_queries():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 100


def test_entry_schema_is_stable(spark):
    a = entry.entry(spark).schema
    b = entry.entry(spark).schema
    assert a == b and [f.name for f in a.fields][:5] == ["column", "position", "n_rows", "missing_count", "missing_pct"]
