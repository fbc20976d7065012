"""matrixloom: gene-set analytics over sample x feature tables, built on Spark DataFrames."""
