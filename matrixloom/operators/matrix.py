"""Sample x gene matrices in tidy form: one row (sample_id, gene, value) per cell.

A matrix is dense by meaning: a cell without a row is 0. Only operators whose result depends on those
zeros (variance, ranks, quantiles) fill them in; sums and means handle them by counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrixloom.functions.numbers import average_rank, log2p, minmax, number, safe_div, zscore
from matrixloom.functions.text import normalize_name


def unpivot_wide(df: DataFrame, key: str, columns: list[str] | None = None, fill: float | None = 0.0) -> DataFrame:
    """A wide table as cells. Gene names are upper-cased; null and NaN become ``fill`` (None: rows are dropped).

    Repeated rows of a key count once, with the greatest value of each column. Rows with a null key are dropped.
    """
    columns = [c for c in df.columns if c != key] if columns is None else columns
    # one hash aggregate of plain doubles; the cells are made of its rows afterwards
    once = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("sample_id")).agg(*[F.max(number(F.col(f"`{c}`"))).alias(f"__{i}") for i, c in enumerate(columns)])
    cells = F.explode(F.array(*[F.struct(F.lit(c.upper()).alias("gene"), F.col(f"__{i}").alias("value")) for i, c in enumerate(columns)]))
    out = once.select("sample_id", cells.alias("c")).select("sample_id", "c.gene", "c.value")
    return out.where("value IS NOT NULL") if fill is None else out.withColumn("value", F.coalesce("value", F.lit(float(fill))))


def row_matrix(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(sample_id, values ARRAY<DOUBLE>) of a wide table, repeated rows of a key counted once, with the greatest value of each column.

    null and NaN are 0. Rows with a null key are dropped.
    """
    once = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("sample_id")).agg(*[F.max(number(F.col(f"`{c}`"))).alias(f"__{i}") for i, c in enumerate(columns)])
    return once.select("sample_id", F.array(*[F.coalesce(f"__{i}", F.lit(0.0)) for i in range(len(columns))]).alias("values"))


def array_moments(rows: DataFrame, genes: list[str]) -> DataFrame:
    """(gene, n, mean, sd) of a row matrix; sums are combined within each task before they are exchanged."""
    names = F.array(*[F.lit(g) for g in genes])
    m = rows.select(F.posexplode("values").alias("i", "v")).groupBy("i").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return m.select(F.get(names, F.col("i")).alias("gene"), "n", "mean", "sd")


def pivot_mean(df: DataFrame, sample: Column, gene: Column, value: Column) -> DataFrame:
    """Cells of a long table: mean of the repeats of a sample and gene. Null keys and values don't count."""
    rows = df.select(sample.alias("sample_id"), gene.alias("gene"), number(value).alias("value"))
    return rows.where("sample_id IS NOT NULL AND gene IS NOT NULL AND value IS NOT NULL").groupBy("sample_id", "gene").agg(F.avg("value").alias("value"))


def densify(cells: DataFrame, samples: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """All samples x all genes, absent cells 0.

    Every sample gets the list of genes and its own values as a map, so the product is made row by row
    inside the tasks. The list of genes is one aggregate; a matrix with more than some ten thousand genes
    should stay sparse.
    """
    gene_list = (genes if genes is not None else cells).select("gene").distinct().agg(F.array_sort(F.collect_list("gene")).alias("genes"))
    own = cells.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("gene", "value"))).alias("own"))
    if samples is not None:
        own = samples.select("sample_id").distinct().join(own, "sample_id", "left")
    rows = own.crossJoin(gene_list).select("sample_id", "own", F.explode("genes").alias("gene"))  # beside one row
    return rows.select("sample_id", "gene", F.coalesce(F.try_element_at("own", F.col("gene")), F.lit(0.0)).alias("value"))


def wide(cells: DataFrame, genes: list[str]) -> DataFrame:
    """One row per sample and one column per named gene, absent cells 0."""
    return cells.groupBy("sample_id").pivot("gene", genes).agg(F.first("value")).na.fill(0.0, genes)


def log_transformed(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", log2p(F.col("value")))


def gene_zscores(cells: DataFrame) -> DataFrame:
    """Cells of a dense matrix with the z-score of each gene over the samples."""
    return cells.withColumn("z", zscore(F.col("value"), ["gene"]))


def gene_moments(cells: DataFrame) -> DataFrame:
    """(gene, n, mean, sd): few rows, combined before the shuffle; joined back instead of a window over all samples."""
    return cells.groupBy("gene").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def zscores_by_moments(cells: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """z-scores with means and deviations of ``moments`` (default: of the cells), such as those of training samples.

    One gene's cells are never gathered in one task, however many samples there are.
    """
    m = (gene_moments(cells) if moments is None else moments).select("gene", "mean", "sd")
    return cells.join(m, "gene", "left").select(
        *cells.columns, F.coalesce(safe_div(F.col("value") - F.col("mean"), F.nullif(F.round("sd", 12), F.lit(0.0))), F.lit(0.0)).alias("z")
    )


def row_zscores(cells: DataFrame, by: str = "sample_id") -> DataFrame:
    return cells.withColumn("z", zscore(F.col("value"), [by]))


def row_minmax(cells: DataFrame, by: str = "sample_id") -> DataFrame:
    return cells.withColumn("scaled", minmax(F.col("value"), [by]))


def rank_percentiles(cells: DataFrame) -> DataFrame:
    """Within each sample (rank - 1) / (n - 1), ties at their mean rank; 0 where the sample has one gene."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("sample_id"))
    return cells.withColumn("pct", F.when(n > 1, (average_rank(F.col("value"), ["sample_id"]) - 1) / (n - 1)).otherwise(F.lit(0.0)))


def row_quantiles(cells: DataFrame, probabilities: list[float]) -> DataFrame:
    """(sample_id, q0, q1, ...): linearly interpolated quantiles over the genes of each sample."""
    qs = F.percentile("value", F.array(*[F.lit(p) for p in probabilities]))
    return cells.groupBy("sample_id").agg(qs.alias("q")).select("sample_id", *[F.col("q")[i].alias(f"q{i}") for i in range(len(probabilities))])


def variable_genes(cells: DataFrame, n_samples: int | None = None) -> DataFrame:
    """Genes whose values differ between samples; with ``n_samples`` absent cells count as 0."""
    g = cells.groupBy("gene").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    if n_samples is not None:
        g = g.select("gene", F.when(F.col("n") < n_samples, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), F.when(F.col("n") < n_samples, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"))
    return g.where("hi > lo").select("gene")


def log_cpm(counts: DataFrame, totals: DataFrame | None = None, sample: str = "sample_id") -> DataFrame:
    """ln(1 + counts per million). The total is that of the given rows, or of ``totals`` (sample, total); 0 totals give 0."""
    t = counts.groupBy(sample).agg(F.sum("value").alias("total")) if totals is None else totals
    return counts.join(t, sample).withColumn("log_cpm", F.coalesce(F.log1p(safe_div(F.col("value") * 1e6, F.nullif("total", F.lit(0.0)))), F.lit(0.0))).drop("total")


def universe(cells: DataFrame, annotation: DataFrame, gene: str = "gene") -> tuple[DataFrame, DataFrame]:
    """(cells of annotated genes, annotated genes that the cells lack)."""
    genes = annotation.select(normalize_name(F.col(gene)).alias("gene")).where("gene IS NOT NULL").distinct()
    return cells.join(genes, "gene", "left_semi"), genes.join(cells.select("gene").distinct(), "gene", "left_anti")
