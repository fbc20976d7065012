"""Access to the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EXPRESSION = "gtex_v11_matrisome_expression_log2"
METADATA = "gtex_v11_sample_metadata"
SCORES = "gtex_v11_program_scores"
SUMMARY = "gtex_v11_tissue_program_summary"
PROTEOMICS = "matrisomedb_cleaned_long_table"
MODULES = "combined_nmf_module_annotations_curated_programs"
PROGRAMS = "program_df"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
