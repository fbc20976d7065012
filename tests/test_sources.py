"""Readers and writers by round trips."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matrixloom.sources import readers, writers


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k INT, v STRING")
    for kind in ("parquet", "csv", "tsv", "json"):
        path = f"{tmp_path}/t.{kind}"
        writers.write_table(df, path, kind, compressed=kind != "parquet")
        got = readers.read_table(spark, path).select(F.col("k").cast("int"), "v")
        assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        writers.write_table(df, f"{tmp_path}/x", "npz")


def test_zip_positions_json_and_profile(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.tsv", "Gene\tValue\nA\t1.5\nB\tx\nC\n")
    schema = T.StructType([T.StructField("gene", T.StringType()), T.StructField("value", T.DoubleType())])
    assert [tuple(r) for r in readers.read_zipped_tsv(spark, str(tmp_path / "d.zip"), schema).collect()] == [("A", 1.5), ("B", None), ("C", None)]
    (tmp_path / "p.csv").write_text("b1,1,0,0,1.0,2.0\nb2,,0,1,1.0,2.0\n")
    assert [r.in_tissue for r in readers.read_positions(spark, str(tmp_path / "p.csv"), False).collect()] == [1, 0]
    (tmp_path / "s.json").write_text(json.dumps({"a": 1, "b": 2.5}))
    assert dict(map(tuple, readers.read_scale_factors(spark, str(tmp_path / "s.json")).collect())) == {"a": 1.0, "b": 2.5}
    p = {r.column: r for r in readers.profile(spark.createDataFrame([(1, None), (3, "x")], "a INT, b STRING")).collect()}
    assert (p["a"].lo, p["a"].hi, p["b"].n_null) == ("1", "3", 1)


def test_manifest_and_lookup(spark, tmp_path):
    m = spark.createDataFrame([("a", "Yes"), ("b", "no")], "name STRING, use_now STRING")
    assert [r.name for r in readers.kept_rows(m).collect()] == ["a"]
    with pytest.raises(ValueError):
        readers.kept_rows(m.where("name = 'b'"))
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "a.csv").write_text("")
    assert readers.find_first(str(tmp_path), ["*.tsv", "*.csv"]).endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        readers.find_first(str(tmp_path), ["*.xyz"])
    assert readers.symbol_column(["x", "My Gene Symbol"]) == "My Gene Symbol"
