"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
from pathlib import Path

import pytest

from sparkveil.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not Path(SF).exists():
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x if isinstance(x, bool | int | str) else str(x)
    return sorted((tuple(map(clean, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert plain(df.select(*cols).collect()) == plain([[r[i] for i in at] for r in cur.fetchall()])


def test_entry_points_hold_without_the_subpackage():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_public_calls():
    import sparkveil

    assert all(callable(getattr(sparkveil, name)) for name in sparkveil.__all__) and "scan" in sparkveil.__all__
    with pytest.raises(AttributeError):
        sparkveil.nothing  # noqa: B018
