"""Every registered query has its SQL's rows over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from panelforge.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        some = df[c].dropna()
        if str(df[c].dtype).startswith("datetime") or (len(some) and hasattr(some.iloc[0], "isoformat")):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]").astype(str)
    one = lambda v: "" if pd.isna(v) else repr(float(v) + 0.0) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(one(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES
