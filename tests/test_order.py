"""Ranks and quantiles by ranges against pandas."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from matrixloom.operators import order


@pytest.fixture
def rows():
    rng = random.Random(5)
    groups = ["hot"] * 900 + ["a"] * 40 + [None] * 30 + ["one"]
    return [(i, g, round(rng.gauss(0, 3), 1), "x") for i, g in enumerate(groups)]


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks(spark, rows, parts):
    df = spark.createDataFrame(rows, "id INT, g STRING, v DOUBLE, n STRING")
    got = {r.id: r.r for r in order.ranks(df, ["g"], "v", "r", parts).collect()}
    p = pd.DataFrame(rows, columns=["id", "g", "v", "n"]).fillna({"g": "-"})
    assert got == dict(zip(p.id, p.groupby("g").v.rank()))


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles(spark, rows, parts):
    more = [*rows, (5000, "a", None, "x"), (5001, "a", float("nan"), "x"), (5002, "none", None, "x")]
    df = spark.createDataFrame(more, "id INT, g STRING, v DOUBLE, n STRING")
    got = {r.g: (r.n, r.q0, r.q1, r.q2) for r in order.quantiles(df, ["g"], "v", [0.25, 0.5, 1.0], parts).collect()}
    p = pd.DataFrame(rows, columns=["id", "g", "v", "n"]).fillna({"g": "-"})
    for g, v in p.groupby("g").v:
        assert got.pop(None if g == "-" else g) == pytest.approx((len(v), *v.quantile([0.25, 0.5, 1.0])))
    assert not got
    assert order.quantiles(df, [], "v", [0.5], parts).count() == 1 and order.quantiles(df.where("false"), ["g"], "v", [0.5], parts).count() == 0
