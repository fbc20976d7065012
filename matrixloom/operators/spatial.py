"""Program scores of spots and their correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.operators.matrix import log_cpm
from matrixloom.operators.scoring import sparse_scores


def spot_scores(counts: DataFrame, bridge: DataFrame, positions: DataFrame) -> DataFrame:
    """(barcode, program, score, position columns) of the spots in tissue.

    Counts are normalised by each spot's total over all genes, only genes of a program are transformed, and
    a spot without any of a program's genes scores 0. ``in_tissue`` null is 0. Spots missing on either side drop.
    """
    totals = counts.groupBy(F.col("barcode").alias("sample_id")).agg(F.sum("value").alias("total"))
    used = counts.join(bridge.select("gene").distinct(), "gene", "left_semi").withColumnRenamed("barcode", "sample_id")
    normal = log_cpm(used, totals).select("sample_id", "gene", F.col("log_cpm").alias("value"))
    scores = sparse_scores(normal, bridge, totals.select("sample_id")).withColumnRenamed("sample_id", "barcode")
    return scores.join(positions.where(F.coalesce(F.col("in_tissue").cast("int"), F.lit(0)) == 1), "barcode")
