"""Non-negative factorisations over a grid of ranks and seeds, and how stable they are.

The matrices are aggregates (tissues x genes of a feature set), so one fits in a task; the runs of the grid are
spread over the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.operators.decompose import cophenetic_correlation, linkage, optimal_assignment
from matrixloom.operators.genesets import overlaps

#: Samples and genes of a matrix, and samples of all feature sets, at most.
MAX_SIDE, MAX_NAMES = 5000, 200_000


def fit(v: np.ndarray, k: int, seed: int, max_iter: int = 3000, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, int]:
    """(W, H, iterations) with W H near ``v`` by coordinate descent from a seeded start, until a round changes ``tol`` of what the first one did."""
    rng = np.random.default_rng(seed)
    scale = np.sqrt(max(float(v.mean()), 1e-12) / k)
    w, ht = scale * rng.random((len(v), k)), scale * rng.random((v.shape[1], k))

    def swept(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> float:
        bb, mb, moved = b.T @ b, m @ b, 0.0
        for j in range(k):
            new = np.maximum(a[:, j] + (mb[:, j] - a @ bb[:, j]) / max(bb[j, j], 1e-12), 0)
            moved += float(np.abs(new - a[:, j]).sum())
            a[:, j] = new
        return moved

    first = 0.0
    for i in range(1, max_iter + 1):
        moved = swept(w, ht, v) + swept(ht, w, v.T)
        first = first or moved
        if moved <= tol * first:
            break
    return w, ht.T, i


def grid(values: DataFrame, ks: list[int], seeds: int, top: int = 30, top_samples: int = 5, max_iter: int = 3000, tol: float = 1e-4) -> DataFrame:
    """One row per feature set, rank and seed: relative error, iterations, sparsity, and per component the top genes, top samples, and each sample's component.

    ``values``: (feature_set, sample_id, gene, value), complete. Each gene is scaled to 0..1. Ranks that a matrix
    is too small for are left out.
    """
    rows = values.select("feature_set", "sample_id").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} samples; those of a factor grid are aggregates")
    names: dict[str, list[str]] = {}
    for r in sorted(rows):
        names.setdefault(r.feature_set, []).append(r.sample_id)
    ordered = F.sort_array(F.collect_list(F.struct("sample_id", "value")))
    vectors = values.groupBy("feature_set", "gene").agg(F.transform(ordered, lambda x: x["value"]).alias("v"))
    runs = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    spread = vectors.select("feature_set", "gene", "v", runs).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, k, seed = key
        pdf = pdf.sort_values("gene")
        samples, v = names[name], np.stack(pdf["v"].to_numpy()).T
        if max(v.shape) > MAX_SIDE:
            raise ValueError(f"{name} has a matrix of {v.shape}; a factorisation in one task takes at most {MAX_SIDE} a side")
        columns = ["feature_set", "k", "seed", "n_samples", "n_genes", "error", "iterations", "sparsity", "genes", "samples", "component_of"]
        if k >= min(v.shape):
            return pd.DataFrame([], columns=columns)
        low, high = v.min(0), v.max(0)
        v = np.where(high > low, (v - low) / np.where(high > low, high - low, 1), 0.0)
        w, h, n = fit(v, int(k), int(seed), max_iter, tol)
        root, l1, l2 = np.sqrt(v.shape[1]), np.abs(h).sum(1), np.sqrt((h**2).sum(1))
        sparse = [(root - a / b) / (root - 1) for a, b in zip(l1, l2) if b > 0]
        genes = pdf["gene"].to_numpy()
        row = (
            name, k, seed, len(v), v.shape[1], float(np.linalg.norm(v - w @ h) / max(np.linalg.norm(v), 1e-300)), n, float(np.mean(sparse)) if sparse else None,
            [genes[np.argsort(-c, kind="stable")[:top]].tolist() for c in h], [[samples[i] for i in np.argsort(-c, kind="stable")[:top_samples]] for c in w.T], w.argmax(1).tolist(),
        )
        return pd.DataFrame([row], columns=columns)

    schema = "feature_set STRING, k INT, seed INT, n_samples INT, n_genes INT, error DOUBLE, iterations INT, sparsity DOUBLE, genes ARRAY<ARRAY<STRING>>, samples ARRAY<ARRAY<STRING>>, component_of ARRAY<INT>"
    return _spread(spread, ["feature_set", "k", "seed"]).groupBy("feature_set", "k", "seed").applyInPandas(run, schema)


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Few bytes but much work: over a fixed number of tasks, which Spark doesn't merge by their size."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def matched_similarity(a: list[set], b: list[set]) -> float:
    """Mean jaccard of the best one-to-one matching of two models' components; NaN without components."""
    if not a or not b:
        return float("nan")
    s = np.array([[len(x & y) / len(x | y) if x | y else 0.0 for y in b] for x in a])
    return float(np.mean([s[i, j] for i, j in optimal_assignment(s)]))


def consensus_cophenetic(assignments: list[np.ndarray]) -> float:
    """Cophenetic correlation of the average linkage of how often two samples share a component; NaN below two runs or for constant distances."""
    if len(assignments) < 2:
        return float("nan")
    together = np.mean([x[:, None] == x[None, :] for x in assignments], axis=0)
    d = 1 - together
    np.fill_diagonal(d, 0)
    return cophenetic_correlation(d, linkage(d))


def stability(runs: DataFrame) -> DataFrame:
    """(feature_set, k, n_seeds, mean and sd of error, mean sparsity, mean and sd of the matched jaccard over all pairs of seeds, cophenetic)."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seed")
        sets = [[set(c) for c in x] for x in pdf["genes"]]
        alike = [matched_similarity(a, b) for i, a in enumerate(sets) for b in sets[:i]]
        coph = consensus_cophenetic([np.array(x) for x in pdf["component_of"]])
        row = (*key, len(pdf), pdf.error.mean(), pdf.error.std(ddof=0), pdf.sparsity.mean(), np.mean(alike) if alike else None, np.std(alike) if alike else None, None if np.isnan(coph) else coph)
        return pd.DataFrame([row], columns=["feature_set", "k", "n_seeds", "mean_error", "std_error", "mean_sparsity", "mean_stability", "std_stability", "cophenetic"])

    schema = "feature_set STRING, k INT, n_seeds INT, mean_error DOUBLE, std_error DOUBLE, mean_sparsity DOUBLE, mean_stability DOUBLE, std_stability DOUBLE, cophenetic DOUBLE"
    own = runs.select("feature_set", "k", "seed", "error", "sparsity", "genes", "component_of")
    return _spread(own, ["feature_set", "k"]).groupBy("feature_set", "k").applyInPandas(one, schema)


def recovery(runs: DataFrame, bridge: DataFrame, min_common: int = 4, min_overlap: float = 0.13) -> DataFrame:
    """(feature_set, k, seed, program, component, n, overlap, jaccard, recovered): the component that fits each program best in each run.

    By overlap, then jaccard, then the first component; a program without a common gene in a run has a row with nulls.
    """
    comps = runs.select("feature_set", "k", "seed", F.posexplode("genes").alias("at", "gs")).withColumn("name", F.concat_ws("|", "feature_set", "k", "seed", "at"))
    o = overlaps(comps.select("name", F.explode("gs").alias("gene")), bridge.select(F.col("program").alias("name"), "gene"))
    j = o.withColumnsRenamed({"a": "name", "b": "program"}).join(comps.drop("gs"), "name")
    keys = ["feature_set", "k", "seed", "program"]
    best = j.groupBy(*keys).agg(F.max(F.struct("overlap", "jaccard", (-F.col("at")).alias("last"), "n")).alias("b"))
    every = runs.select("feature_set", "k", "seed").crossJoin(bridge.select("program").distinct())  # every run x every program is the result
    good = (F.col("b.n") >= min_common) & (F.col("b.overlap") >= min_overlap)
    return every.join(best, keys, "left").select(
        *keys, (-F.col("b.last") + 1).alias("component"), "b.n", "b.overlap", "b.jaccard", F.coalesce(good, F.lit(False)).alias("recovered")
    )


def grid_metrics(runs: DataFrame, bridge: DataFrame) -> DataFrame:
    """:func:`stability` with the mean share of programs recovered per seed."""
    r = recovery(runs, bridge).groupBy("feature_set", "k").agg(F.avg(F.col("recovered").cast("double")).alias("mean_recovery"), (F.sum(F.col("recovered").cast("int")) / F.count_distinct("seed")).alias("programs_per_seed"))
    return stability(runs).join(r, ["feature_set", "k"], "left")
