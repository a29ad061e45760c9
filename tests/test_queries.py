"""Each matching query against its SQL in DuckDB."""

import duckdb
import pytest

from linkwright import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(rows):
    return sorted(tuple(repr(round(x, 9) if isinstance(x, float) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    assert rows
    if name in queries.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.sql(queries.SQL[name]).to_arrow_table()
        assert columns == sorted(want.column_names)
        assert values(rows) == values(zip(*(want.column(c).to_pylist() for c in columns), strict=True))
