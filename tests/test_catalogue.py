"""Every query of the engine's catalogue against its SQL, run by DuckDB over the same files."""

from collections import Counter

import duckdb
import pytest

from faultline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(row):
    return repr(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in row))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [*catalogue.queries()])
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    rows = df.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    expected = Counter(rounded(r[i] for i in order) for r in found.fetchall())
    assert Counter(map(rounded, rows)) == expected


def test_entry_point_without_llm(spark, sf):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
