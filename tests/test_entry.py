"""The driver's contract, and the queries against their SQL over the smallest tables."""

from __future__ import annotations

import glob
import math
import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from matrixloom.plans import catalogue


def test_contract(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_core_does_not_import_llm():
    root = os.path.join(os.path.dirname(entry_points.__file__), "matrixloom")
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert not re.search(r"matrixloom\.llm|from \.llm", open(path).read()), path


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, expect = entry_points.queries()[name](spark, folder).toPandas(), con.sql(entry_points.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(expect.columns)
    rows = [sorted((tuple(map(plain, r)) for r in d[cols].astype(object).itertuples(index=False)), key=str) for d in (got, expect)]
    assert rows[0] == rows[1]
