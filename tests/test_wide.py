"""Wide tables: exact round trips and edge cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from matrixloom.operators import wide


def cells_of(spark, rows, schema="entity INT, attribute STRING, value DOUBLE"):
    return spark.createDataFrame(rows, schema)


def test_round_trip(spark):
    rng = random.Random(1)
    rows = {(e, f"A{a:03d}"): rng.random() for e in range(300) for a in range(40) if rng.random() < 0.2}
    cells = cells_of(spark, [(e, a, v) for (e, a), v in rows.items()])
    out = wide.eav_to_wide(cells)
    back = {(r["entity"], c): r[c] for r in out.collect() for c in out.columns[1:] if r[c] is not None}
    assert back == rows
    assert {(r.entity, r.attribute): r.value for r in wide.wide_filled_cells(cells).collect()} == rows


def test_typed_columns(spark):
    rows = [(1, "age", None, 30, None), (1, "name", None, None, "x"), (1, "w", 1.5, None, None), (2, "age", None, 31, None), (3, "name", None, None, "")]
    cells = cells_of(spark, rows, "entity INT, attribute STRING, d DOUBLE, n BIGINT, s STRING")
    out = wide.eav_to_wide(cells, ["age", "name", "w"], {"age": "bigint", "name": "string", "w": "double"}, values={"double": "d", "bigint": "n", "string": "s"})
    assert out.dtypes[1:] == [("age", "bigint"), ("name", "string"), ("w", "double")]
    assert sorted(map(tuple, out.collect())) == [(1, 30, "x", 1.5), (2, 31, None, None), (3, None, "", None)]


def test_hot_entity_and_unknown_attributes(spark):
    rows = [(7, f"A{i}", float(i)) for i in range(3000)] + [(i, "A1", 1.0) for i in range(100, 150)] + [(999, "OTHER", 1.0)]
    out = wide.eav_to_wide(cells_of(spark, rows), ["A1", "A2999", "NONE"])
    got = {r["entity"]: (r["A1"], r["A2999"], r["NONE"]) for r in out.collect()}
    assert got[7] == (1.0, 2999.0, None) and got[120] == (1.0, None, None) and got[999] == (None, None, None)
    assert len(got) == 52


def test_cells_null_nan_and_repeats(spark):
    rows = [(1, " g1 ", 2.0, 10), (1, "G1", 4.0, 11), (1, "G1", 4.0, 11), (1, "nan", 5.0, 12), (2, "g2", float("nan"), 13), (2, None, 1.0, 14), (None, "g", 1.0, 15), (3, "G3", 1.0, None), (3, "G3", 3.0, None)]
    df = spark.createDataFrame(rows, "e INT, a STRING, v DOUBLE, rec INT")
    out = {(r.entity, r.attribute): r.value for r in wide.eav_cells(df, "e", wide.clean_symbol(F.col("a")), F.col("v"), "rec").collect()}
    assert out == {(1, "G1"): 3.0, (3, "G3"): 2.0}


def test_empty_clash_and_bound(spark):
    empty = cells_of(spark, [])
    assert wide.eav_to_wide(empty).columns == ["entity"] and wide.eav_to_wide(empty).count() == 0
    clash = wide.eav_to_wide(cells_of(spark, [(1, "entity", 2.0)]))
    assert clash.columns == ["entity", "entity__attribute"] and clash.first()[1] == 2.0
    with pytest.raises(ValueError):
        wide.attribute_dictionary(cells_of(spark, [(1, "a", 1.0), (1, "b", 1.0)]), 1)
    assert not math.isnan(clash.first()[1])
