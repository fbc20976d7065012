"""Modules consolidated into clusters, and clusters assigned to programs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.functions.numbers import safe_div
from matrixloom.operators.decompose import cophenetic_correlation, cut_tree, linkage, optimal_assignment
from matrixloom.operators.factorgrid import matched_similarity


def combined_similarity(pairs: DataFrame, activity: DataFrame, weight: float = 0.7) -> DataFrame:
    """(a, b, similarity): weight x jaccard + (1 - weight) x positive part of the activities' rank correlation.

    ``pairs``: (a, b, jaccard); ``activity``: (a, b, spearman). A pair that one side lacks counts 0 there.
    """
    j = pairs.select("a", "b", "jaccard").join(activity.select("a", "b", "spearman"), ["a", "b"], "full")
    positive = F.greatest(F.coalesce("spearman", F.lit(0.0)), F.lit(0.0))
    return j.select("a", "b", (F.coalesce("jaccard", F.lit(0.0)) * weight + positive * (1 - weight)).alias("similarity"))


def clustered_modules(modules: DataFrame, group: str, clusters: int = 9, max_modules: int = 2000) -> DataFrame:
    """(group, module_id, cluster, cophenetic): average linkage of the modules of each group by 1 - jaccard of their genes.

    ``modules``: group, module_id, items. One group is one task; a group with more than ``max_modules``
    modules raises ValueError there.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_modules:
            raise ValueError(f"{len(pdf)} modules in a group; average linkage takes at most {max_modules}")
        pdf = pdf.sort_values("module_id")
        names = {g: i for i, g in enumerate(sorted({g for x in pdf["items"] for g in x}))}
        m = np.zeros((len(pdf), max(1, len(names))))
        for r, x in enumerate(pdf["items"]):
            m[r, [names[g] for g in x]] = 1
        both, size = m @ m.T, m.sum(1)
        union = size[:, None] + size[None, :] - both
        d = 1 - np.where(union > 0, both / np.maximum(union, 1), 0)
        np.fill_diagonal(d, 0)
        merges = linkage(d)
        return pd.DataFrame({group: pdf[group].to_numpy(), "module_id": pdf["module_id"].to_numpy(), "cluster": cut_tree(merges, len(pdf), clusters), "cophenetic": cophenetic_correlation(d, merges)})

    one = modules.where(F.size("items") > 0).select(group, "module_id", "items")
    return one.groupBy(group).applyInPandas(run, f"{group} {modules.schema[group].dataType.simpleString()}, module_id BIGINT, cluster INT, cophenetic DOUBLE")


def cluster_program_scores(clusters: DataFrame, modules: DataFrame, bridge: DataFrame, group: str) -> DataFrame:
    """(group, cluster, program, overlap, jaccard, mean_overlap, score): how well each cluster's genes fit each program.

    ``score`` weighs the cluster's overlap 0.60, its jaccard 0.25 and the mean overlap of its modules 0.15.
    """
    own = clusters.join(modules.select(group, "module_id", F.explode("items").alias("gene")).distinct(), [group, "module_id"])
    size = bridge.groupBy("program").agg(F.count("*").alias("np"))

    def against(keys: list[str]) -> DataFrame:
        genes = own.select(*keys, "gene").distinct()
        n = genes.groupBy(*keys).agg(F.count("*").alias("n"))
        common = genes.join(bridge, "gene").groupBy(*keys, "program").agg(F.count("*").alias("c"))
        return common.join(n, keys).join(size, "program").select(
            *keys, "program", safe_div(F.col("c"), F.least("n", "np")).alias("overlap"), (F.col("c") / (F.col("n") + F.col("np") - F.col("c"))).alias("jaccard")
        )

    per = against([group, "cluster", "module_id"])
    members = clusters.groupBy(group, "cluster").agg(F.count("*").alias("members"))
    mean = per.groupBy(group, "cluster", "program").agg(F.sum("overlap").alias("s")).join(members, [group, "cluster"])
    mean = mean.select(group, "cluster", "program", (F.col("s") / F.col("members")).alias("mean_overlap"))
    out = against([group, "cluster"]).join(mean, [group, "cluster", "program"])
    return out.withColumn("score", 0.60 * F.col("overlap") + 0.25 * F.col("jaccard") + 0.15 * F.col("mean_overlap"))


def assigned_programs(scores: DataFrame, group: str) -> DataFrame:
    """(group, cluster, program, score): the one-to-one assignment of clusters to programs with the greatest total score."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.pivot_table(index="cluster", columns="program", values="score", aggfunc="max", fill_value=0.0).sort_index()
        pairs = [(t.index[i], t.columns[j], t.iloc[i, j]) for i, j in optimal_assignment(t.to_numpy(float))]
        return pd.DataFrame({group: pdf[group].iloc[0], "cluster": [p[0] for p in pairs], "program": [p[1] for p in pairs], "score": [p[2] for p in pairs]})

    of = scores.schema[group].dataType.simpleString()
    return scores.groupBy(group).applyInPandas(run, f"{group} {of}, cluster INT, program STRING, score DOUBLE")


def matched_stability(top_genes: DataFrame, left: str, right: str, most: int = 200_000) -> float:
    """Mean jaccard of the best one-to-one matching of two models' components; more than ``most`` rows raise ValueError.

    ``top_genes``: (model, component, gene).
    """
    rows = top_genes.where(F.col("model").isin(left, right)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} component genes")
    sets: dict[str, dict[str, set]] = {left: {}, right: {}}
    for r in rows:
        sets[r["model"]].setdefault(r["component"], set()).add(r["gene"])
    return matched_similarity(*([v for _, v in sorted(sets[m].items())] for m in (left, right)))
