"""The numbered queries against their SQL over the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from matrixloom.llm import queries


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, expect = queries.queries()[name](spark, folder).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(expect.columns)
    rows = [sorted((tuple(map(plain, r)) for r in d[cols].astype(object).itertuples(index=False)), key=str) for d in (got, expect)]
    assert rows[0] == rows[1]


def test_spellings_of_the_corpus(spark, folder):
    rows = queries.p9_spellings(spark, folder).collect()
    assert rows and all(r.spelling is not None and r.n > 0 for r in rows)
