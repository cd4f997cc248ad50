"""The contract of __spark_entry__: it imports, and the queries match their SQL twins on the smallest folder."""

import math
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from strideline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).limit(5).count() == 5


def _rows(df):
    def cell(x):
        if pd.isna(x):
            return "null"
        if isinstance(x, float):
            return repr(round(x, 6)) if math.floor(x) != x else str(int(x))
        return str(x)[:10] if hasattr(x, "year") else str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_the_package_is_importable_from_its_zip(tmp_path):
    """What executors of a cluster get: the package without this folder."""
    path = entry.package_zip(str(tmp_path))
    code = f"import sys; sys.path.insert(0, {path!r}); import strideline.operators.boosting as b; assert {path!r} in b.__file__"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
