"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

from lodestone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got.columns) and len(got)
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)
