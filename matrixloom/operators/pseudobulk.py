"""Counts of cells added up to groups of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse_sum(counts: DataFrame, cell: str = "cell_id", gene: str = "gene", value: str = "value") -> DataFrame:
    """Counts of duplicate symbols of a cell added up; zero counts drop."""
    return counts.groupBy(cell, gene).agg(F.sum(value).alias(value)).where(F.col(value) != 0)


def pseudobulk_groups(cells: DataFrame, keys: list[str], min_cells: int = 20) -> DataFrame:
    """(keys, n_cells, pseudobulk_id) of the groups with at least ``min_cells`` cells; the id joins the keys by "|"."""
    g = cells.groupBy(*keys).agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
    return g.withColumn("pseudobulk_id", F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in keys]))


def pseudobulk(counts: DataFrame, cells: DataFrame, keys: list[str], min_cells: int = 20, cell: str = "cell_id", gene: str = "gene", value: str = "value") -> DataFrame:
    """(pseudobulk_id, gene, value): counts summed over the cells of each large enough group.

    Groups are matched null-safe; the sums are combined before they are shuffled, so one huge group is harmless.
    """
    groups = pseudobulk_groups(cells, keys, min_cells)
    named = cells.select(cell, F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in keys]).alias("pseudobulk_id"))
    kept = named.join(groups.select("pseudobulk_id"), "pseudobulk_id", "left_semi")
    return counts.join(kept, cell).groupBy("pseudobulk_id", gene).agg(F.sum(value).alias(value))
