"""Driver contract: entry(), queries(), oracle_sql()."""

import __spark_entry__ as entry


def test_entry_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["CustomerId", "Age", "Geography_Label", "Balance", "clv_estimated",
                          "churn_probability", "retention_value", "risk_level"]
    rows = df.collect()
    assert len(rows) == 10
    values = [r["retention_value"] for r in rows]
    assert values == sorted(values, reverse=True)


def test_oracle_keys_are_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 58
    assert all(isinstance(s, str) and s.lstrip().upper().startswith("WITH") for s in o.values())
