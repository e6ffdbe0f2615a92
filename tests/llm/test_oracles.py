"""Every text query with SQL against that SQL, run by DuckDB over the same files."""

from collections import Counter

import duckdb
import pytest

from faultline.llm import queries as Q


@pytest.mark.parametrize("name", [*Q.oracle_sql()])
def test_query(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = Q.queries()[name](spark, sf)
    found = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    common = sorted(set(names) & set(df.columns))
    assert len(common) == len(names) == len(df.columns)

    def shown(row, at):
        return repr([round(row[at[c]], 9) if isinstance(row[at[c]], float) else row[at[c]] for c in common])

    expected = Counter(shown(r, {c: names.index(c) for c in common}) for r in found.fetchall())
    assert Counter(shown(r, {c: df.columns.index(c) for c in common}) for r in df.collect()) == expected
