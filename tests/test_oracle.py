"""Every query with a SQL twin equals DuckDB on sf0.001 (rows, names, values)."""

import math
import os

import duckdb
import pytest

from retainspark.plans.registry import load_all

QUERIES, ORACLE = load_all()
TABLES = ["customer", "orders"]


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return repr(v)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_small, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql_twin(spark, sf_small, con, name):
    df = QUERIES[name](spark, sf_small)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(scols) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _canon(srows, scols) == _canon(orows, ocols)


def test_every_query_has_sql_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"model_scores", "leaderboard"}
