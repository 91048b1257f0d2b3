"""Every registered query of the document engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from docloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    tidy = lambda v: (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v
    return [columns[k] for k in order], sorted((tuple(tidy(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    assert found[1]
    if name in catalog.ORACLE_SQL:
        rel = duck.sql(catalog.ORACLE_SQL[name])
        assert found == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["lang", "kind", "n", "chars"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
