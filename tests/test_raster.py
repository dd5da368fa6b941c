import os

import duckdb
import pytest

from pixelloom.plans import adjustments, colors, commands, compositing, documents, effects, filters, gathers, more, paths, queries, rendering, scalars, selections, spatial, streams, texts, tiling, trees

PARTS = (queries, more, colors, adjustments, scalars, filters, rendering, gathers, selections, trees, streams, tiling, compositing, paths, effects, documents, texts, spatial, commands)
QUERIES, ORACLE_SQL = ({k: v for part in PARTS for k, v in getattr(part, name).items()} for name in ("QUERIES", "ORACLE_SQL"))
SF = "/root/testdata/sf0.001"


def ordered(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True).astype(str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("events", "orders", "nation", "customer", "documents"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = ordered(c.sql(ORACLE_SQL[name]).df()), ordered(QUERIES[name](spark, SF).toPandas())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry_imports():
    import __spark_entry__

    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
