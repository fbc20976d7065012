"""Sinks: matrices, tables and run metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.operators.matrix import log_transformed, zscores_by_moments


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", compressed: bool = False) -> None:
    """Parquet, CSV, TSV or JSON; text kinds gzip-compressed on request."""
    w = df.write.mode(mode)
    if kind == "parquet":
        w.parquet(path)
        return
    if compressed:
        w = w.option("compression", "gzip")
    if kind in ("csv", "tsv"):
        w.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    elif kind == "json":
        w.json(path)
    else:
        raise ValueError(f"no writer for {kind!r}")


def write_matrix_outputs(cells: DataFrame, folder: str, annotation: DataFrame | None = None) -> None:
    """Raw, log2 and z-score cells, the genes of the annotation that are matched and missing, and a one-row summary."""
    write_table(cells, f"{folder}/raw")
    logged = log_transformed(cells)
    write_table(logged, f"{folder}/log2")
    write_table(zscores_by_moments(logged), f"{folder}/zscore")
    summary = cells.agg(F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("gene").alias("n_genes"))
    if annotation is not None:
        have = cells.select("gene").distinct()
        write_table(annotation.join(have, "gene", "left_semi"), f"{folder}/matched", "csv")
        write_table(annotation.join(have, "gene", "left_anti"), f"{folder}/missing", "csv")
    write_table(summary, f"{folder}/summary", "csv")


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """Parameters of a run as one JSON object."""
    import json

    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value STRING").coalesce(1).write.mode("overwrite").text(path)
