"""Scores of gene programs per sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.functions.numbers import safe_div
from matrixloom.operators.matrix import rank_percentiles, row_quantiles, zscores_by_moments

METHODS = ("mean", "zscore_mean", "rank_percentile", "top10_fraction", "top20_fraction")
#: Genes of all programs that go to every task at most.
MAX_MEMBERS = 2_000_000


def _checked(methods: tuple[str, ...]) -> None:
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}; there are {METHODS}")


def _mean_ranks(x: np.ndarray) -> np.ndarray:
    """Rank of each value in its row from 0, ties at their mean rank."""
    n, p = x.shape
    order = np.argsort(x, 1, kind="stable")
    v = np.take_along_axis(x, order, 1)
    new = np.ones((n, p), bool)
    new[:, 1:] = v[:, 1:] != v[:, :-1]
    at = np.arange(p)
    first = np.maximum.accumulate(np.where(new, at, 0), 1)
    ends = np.ones((n, p), bool)
    ends[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(ends, at, p - 1)[:, ::-1], 1)[:, ::-1]
    ranks = np.empty((n, p))
    np.put_along_axis(ranks, order, (first + last) / 2, 1)
    return ranks


def row_scorer(genes: list[str], bridge: DataFrame, moments: DataFrame | None, methods: tuple[str, ...] = METHODS) -> tuple[Callable, str]:
    """(function for ``mapInArrow``, schema) that scores rows (sample_id, values ARRAY<DOUBLE>), one value per gene.

    A sample is complete in its row, so nothing is exchanged: the programs' genes and the genes' moments (gene,
    mean, sd) go to the tasks, of which there may be MAX_MEMBERS at most. Programs without any of the genes have
    no row. Works on streams as on tables.
    """
    _checked(methods)
    at = {g: i for i, g in enumerate(genes)}
    rows = bridge.select("program", "gene").distinct().limit(MAX_MEMBERS + 1).toPandas()
    if len(rows) > MAX_MEMBERS:
        raise ValueError(f"the programs have more than {MAX_MEMBERS} genes")
    members = {p: np.array(sorted(at[g] for g in d.gene if g in at), np.int64) for p, d in rows.groupby("program")}
    members = {p: i for p, i in sorted(members.items()) if len(i)}
    mean, scale = np.zeros(len(genes)), np.zeros(len(genes))
    if "zscore_mean" in methods and moments is not None:
        for r in moments.select("gene", "mean", "sd").where(F.col("gene").isin(genes)).toLocalIterator():
            sd = round(r.sd or 0.0, 12)
            mean[at[r.gene]], scale[at[r.gene]] = r.mean or 0.0, 1 / sd if sd else 0.0
    weights = np.zeros((len(genes), len(members)))
    for j, i in enumerate(members.values()):
        weights[i, j] = 1 / len(i)
    names, sizes = pa.array(list(members), pa.string()), np.array([len(i) for i in members.values()], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {
            "mean": lambda x, s: x @ weights, "zscore_mean": lambda x, s: ((x - mean) * scale) @ weights,
            "rank_percentile": lambda x, s: (_mean_ranks(x) / max(len(genes) - 1, 1)) @ weights,
            "top10_fraction": lambda x, s: (x >= _quantile(s, 0.9)) @ weights, "top20_fraction": lambda x, s: (x >= _quantile(s, 0.8)) @ weights,
        }
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(genes))
                ordered = np.sort(x, 1) if {"top10_fraction", "top20_fraction"} & set(methods) else None
                n, p = len(x), len(names)
                if not p:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(n), p))), names.take(pa.array(np.tile(np.arange(p), n))), pa.array(np.tile(sizes, n))]
                    + [pa.array(np.ascontiguousarray(of[m](x, ordered)).ravel()) for m in methods],
                    names=["sample_id", "program", "n_genes", *methods],
                )

    return run, "sample_id STRING, program STRING, n_genes INT, " + ", ".join(f"{m} DOUBLE" for m in methods)


def _quantile(ordered: np.ndarray, q: float) -> np.ndarray:
    """Linearly interpolated quantile of sorted rows, as a column."""
    h = (ordered.shape[1] - 1) * q
    low, high = ordered[:, [int(h)]], ordered[:, [min(int(h) + 1, ordered.shape[1] - 1)]]
    return low + (high - low) * (h - int(h))


def score_rows(rows: DataFrame, genes: list[str], bridge: DataFrame, moments: DataFrame | None = None, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(sample_id, program, n_genes, one column per method) of a matrix with one row per sample, as from :func:`matrix.row_matrix`.

    The scores of :func:`score_programs` without an exchange of cells; ``moments`` (default: of the rows) as from
    :func:`matrix.array_moments`.
    """
    from matrixloom.operators.matrix import array_moments

    if moments is None and "zscore_mean" in methods:
        moments = array_moments(rows, genes)
    run, schema = row_scorer(genes, bridge, moments, methods)
    return rows.select(F.col("sample_id").cast("string").alias("sample_id"), "values").mapInArrow(run, schema)


def score_programs(cells: DataFrame, bridge: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(sample_id, program, n_genes, one column per method) of a dense matrix, in one pass.

    z-scores come from the genes' moments, ranks and quantiles from one shuffle by sample; every cell is
    then joined to the programs of its gene once. Genes that the matrix lacks don't count; a program without
    any gene in the matrix has no row. The fraction methods give the share of the program's genes that reach
    the sample's upper quantile over all genes.
    """
    _checked(methods)
    c = zscores_by_moments(cells)
    if "rank_percentile" in methods:
        c = rank_percentiles(c)
    if {"top10_fraction", "top20_fraction"} & set(methods):
        c = c.join(row_quantiles(cells, [0.9, 0.8]), "sample_id")
    of = {
        "mean": lambda: F.avg("value"), "zscore_mean": lambda: F.avg("z"), "rank_percentile": lambda: F.avg("pct"),
        "top10_fraction": lambda: F.avg((F.col("value") >= F.col("q0")).cast("double")), "top20_fraction": lambda: F.avg((F.col("value") >= F.col("q1")).cast("double")),
    }
    return c.join(bridge, "gene").groupBy("sample_id", "program").agg(F.count("*").alias("n_genes"), *[of[m]().alias(m) for m in methods])


def tidy_scores(scores: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(sample_id, program, method, score)."""
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])).alias("m")
    return scores.select("sample_id", "program", kinds).select("sample_id", "program", "m.method", "m.score")


def sparse_scores(counts: DataFrame, bridge: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(sample_id, program, score): mean over the program's genes in the matrix, absent cells 0, without filling them in.

    With ``samples`` every sample has a row for every program that has genes, 0 where none of them is counted.
    """
    genes = counts.select("gene").distinct()
    b = bridge.join(genes, "gene", "left_semi")
    n = b.groupBy("program").agg(F.count("*").alias("n_available"))
    s = counts.join(b, "gene").groupBy("sample_id", "program").agg(F.sum("value").alias("total")).join(n, "program")
    out = s.select("sample_id", "program", (F.col("total") / F.col("n_available")).alias("score"))
    if samples is None:
        return out
    every = samples.select("sample_id").distinct().crossJoin(n.select("program"))  # every sample x every program is the result
    return every.join(out, ["sample_id", "program"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def sparse_zscore_means(counts: DataFrame, bridge: DataFrame, n_samples: int) -> DataFrame:
    """Mean z-score per sample and program from the non-zero cells only.

    A gene's mean and deviation over all samples follow from its sums; a zero cell's z is -mean/sd, so a
    sample's sum over a program is a constant of the program plus value/sd of its non-zero cells. Samples
    without any non-zero cell of a program have no row: their score is that constant.
    """
    m = counts.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    m = m.select("gene", (F.col("s") / n_samples).alias("mean"), F.sqrt(F.greatest(F.col("ss") / n_samples - (F.col("s") / n_samples) ** 2, F.lit(0.0))).alias("sd"))
    m = m.withColumn("sd", F.nullif(F.round("sd", 12), F.lit(0.0)))
    b = bridge.join(m, "gene")
    base = b.groupBy("program").agg(F.count("*").alias("n"), F.sum(F.coalesce(safe_div(-F.col("mean"), F.col("sd")), F.lit(0.0))).alias("base"))
    own = counts.join(b, "gene").groupBy("sample_id", "program").agg(F.sum(F.coalesce(safe_div(F.col("value"), F.col("sd")), F.lit(0.0))).alias("own"))
    return own.join(base, "program").select("sample_id", "program", ((F.col("own") + F.col("base")) / F.col("n")).alias("score"))


def foldwise_scores(cells: DataFrame, bridge: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, sample_id, program, is_test, score): z-means with the moments of each fold's training samples only.

    ``folds``: (sample_id, fold). Sums per gene and fold are taken once; those of the training side are the
    total minus the fold's own, so the cells are not repeated per fold for fitting.
    """
    f = cells.join(folds, "sample_id")
    part = f.groupBy("gene", "fold").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"))
    total = part.groupBy("gene").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("ss").alias("tss"))
    m = part.join(total, "gene").select("gene", F.col("fold").alias("test_fold"), (F.col("tn") - F.col("n")).alias("n"), (F.col("ts") - F.col("s")).alias("s"), (F.col("tss") - F.col("ss")).alias("ss"))
    m = m.where("n > 0").select("gene", "test_fold", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))).alias("sd"))
    z = F.coalesce(safe_div(F.col("value") - F.col("mean"), F.nullif(F.round("sd", 9), F.lit(0.0))), F.lit(0.0))
    s = f.join(bridge, "gene").join(m, "gene").withColumn("z", z)
    return s.groupBy(F.col("test_fold").alias("fold"), "sample_id", "program", (F.col("fold") == F.col("test_fold")).alias("is_test")).agg(F.avg("z").alias("score"))
