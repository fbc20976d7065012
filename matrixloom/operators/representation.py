"""Representations of samples compared by how well a classifier does on them: curated sets, principal axes, random sets."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.operators import classify, controls, scoring
from matrixloom.operators.decompose import feature_rows

_METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


@dataclasses.dataclass(frozen=True)
class Job:
    """A representation: its name, family and kind (``gene_set_scores`` or ``axes``), and its gene sets (program, gene)."""

    name: str
    family: str
    kind: str
    sets: DataFrame | None = None
    components: int = 9


def jobs_for(curated: DataFrame, universe: DataFrame, outside: DataFrame, repeats: int, seed: int = 42) -> list[Job]:
    """The curated sets, nine principal axes, and ``repeats`` times sets of the curated sizes from the universe and from outside it."""
    sizes = curated.groupBy(F.col("program").alias("name")).agg(F.count("*").alias("size"))
    out = [Job("curated_programs", "curated", "gene_set_scores", curated), Job("universe_axes", "axes", "axes")]
    for family, genes in (("random_universe", universe), ("random_outside", outside)):
        drawn = controls.random_sets(genes, sizes, repeats, seed)
        for r in range(repeats):
            out.append(Job(f"{family}_r{r + 1}", family, "gene_set_scores", drawn.where(F.col("repeat") == r).select(F.col("name").alias("program"), "gene")))
    return out


def features(job: Job, cells: DataFrame, samples: DataFrame, genes: list[str]) -> tuple[DataFrame, list[str]]:
    """(rows with fold and is_test or fold alone, feature columns) of a job.

    ``samples``: (sample_id, fold, label). Set scores are means of z-scores fitted on each fold's training samples.
    A set without a gene in the matrix has no column: as 0 in every sample it would tell nothing.
    """
    if job.kind == "axes":
        rows = feature_rows(cells, genes).join(samples, "sample_id")
        return rows.select("sample_id", "fold", "label", *[F.col("features")[i].alias(f"g{i}") for i in range(len(genes))]), [f"g{i}" for i in range(len(genes))]
    here = job.sets.join(cells.select("gene").distinct(), "gene", "left_semi")
    names = sorted(r[0] for r in here.select("program").distinct().limit(controls.MAX_DRAWN).collect())
    if not names:
        raise ValueError(f"{job.name} has no gene in the matrix")
    long = scoring.foldwise_scores(cells, here, samples.select("sample_id", "fold"))
    wide = long.groupBy("fold", "sample_id", "is_test").pivot("program", names).agg(F.first("score")).toDF("fold", "sample_id", "is_test", *[f"s{i}" for i in range(len(names))])
    return wide.join(samples.select("sample_id", "label"), "sample_id"), [f"s{i}" for i in range(len(names))]


def compare(jobs: list[Job], cells: DataFrame, samples: DataFrame, genes: list[str], models: list[str]) -> DataFrame:
    """One row per representation, model and fold, with the columns of :func:`classify.cross_validate`; a job that fails has one failed row per model."""
    spark = cells.sparkSession
    out = None
    for job in jobs:
        try:
            rows, columns = features(job, cells, samples, genes)
            done = classify.cross_validate(rows, columns, "label", models, components=job.components if job.kind == "axes" else None)
        except ValueError as e:
            done = spark.createDataFrame([(m, -1, "failed", str(e)[:200], 0, None, None, None, None) for m in models], classify._ROW)
        done = done.select(F.lit(job.name).alias("representation"), F.lit(job.family).alias("family"), "*")
        out = done if out is None else out.unionByName(done)
    return out


def family_summary(summary: DataFrame) -> DataFrame:
    """Per family and model: representations, their names, and mean, sd, least and greatest of their mean metrics."""
    return summary.groupBy("family", "model").agg(
        F.count_distinct("representation").alias("n_representations"), F.array_join(F.array_sort(F.collect_set("representation")), "; ").alias("representations"),
        *[f(f"mean_{m}").alias(f"{m}_{n}") for m in _METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
    )


def failed_runs(rows: DataFrame) -> DataFrame:
    """How many runs failed by model, family and error."""
    return rows.where("status = 'failed'").groupBy("model", "family", "error").agg(F.count("*").alias("n"))
