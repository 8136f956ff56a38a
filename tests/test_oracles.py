"""Every query with DuckDB SQL gives the same rows as that SQL."""

import duckdb
import pandas as pd
import pytest

from dossier.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    show = lambda x: "None" if pd.isna(x) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted("|".join(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
