import duckdb
import pytest

import __spark_entry__ as entry
from seqloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    expected = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted((repr(tuple(r[k] for k in order)) for r in expected.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
