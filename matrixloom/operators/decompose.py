"""Factor models of sample x gene matrices, and clusterings of a few hundred items.

Samples are rows of a DataFrame and never leave the executors; what is exchanged are matrices of the size
components x genes, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers that a model exchanged between the driver and the tasks may have.
MAX_MODEL = 4_000_000


def feature_rows(cells: DataFrame, genes: list[str], value: str = "value") -> DataFrame:
    """(sample_id, features): the values of the named genes in their order, absent cells 0."""
    at = {g: i for i, g in enumerate(genes)}
    index = F.create_map(*[x for g, i in at.items() for x in (F.lit(g), F.lit(i))])
    own = cells.where(F.col("gene").isin(genes)).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.try_element_at(index, F.col("gene")).alias("i"), F.col(value).alias("v")))).alias("m"))
    return own.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(len(genes) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("features"))


def pca(rows: DataFrame, k: int, features: str = "features"):
    """(model, rows with ``coords``). Features should be centred, such as z-scores; signs are made comparable by :func:`fixed_signs`."""
    v = rows.withColumn("__v", array_to_vector(features))
    model = PCA(k=k, inputCol="__v", outputCol="__c").fit(v)
    return model, model.transform(v).withColumn("coords", vector_to_array("__c")).drop("__v", "__c")


def pca_loadings(spark: SparkSession, model, genes: list[str]) -> DataFrame:
    """(component, gene, loading), each component's sign such that its largest loading is positive."""
    m = model.pc.toArray()
    m = m * np.where(m[np.abs(m).argmax(0), np.arange(m.shape[1])] < 0, -1, 1)
    return spark.createDataFrame([(int(c) + 1, g, float(m[i, c])) for i, g in enumerate(genes) for c in range(m.shape[1])], "component INT, gene STRING, loading DOUBLE")


def explained_variance(spark: SparkSession, model) -> DataFrame:
    """(component, share, cumulative)."""
    e = [float(x) for x in model.explainedVariance]
    return spark.createDataFrame([(i + 1, x, float(sum(e[: i + 1]))) for i, x in enumerate(e)], "component INT, share DOUBLE, cumulative DOUBLE")


def _fit_rows(v: np.ndarray, h: np.ndarray, steps: int = 40) -> np.ndarray:
    """Non-negative weights of each row for the components, by multiplicative steps from a fixed start."""
    hv, hh = v @ h.T, h @ h.T
    w = np.full(hv.shape, max(float(v.mean()), 1e-6) / max(1, h.shape[0]))
    for _ in range(steps):
        w *= hv / np.maximum(w @ hh, 1e-12)
    return w


def nmf(rows: DataFrame, models: list[tuple[str, int, int]], n_genes: int, rounds: int = 25) -> dict[str, tuple[np.ndarray, float]]:
    """{name: (components x genes, relative error)} for models (name, k, seed), all fitted in the same passes.

    Each round every task fits the weights of its samples to the present components and adds up the two small
    products that the components' update needs; only those reach the driver. Features must not be negative.
    """
    if sum(k for _, k, _ in models) * n_genes > MAX_MODEL:
        raise ValueError("the components are too many to exchange; fit fewer models at a time")
    hs = {name: np.random.default_rng(seed).uniform(0.1, 1.0, (k, n_genes)) for name, k, seed in models}
    error: dict[str, float] = {}
    data = rows.select("features").persist()
    try:
        for _ in range(rounds):

            def part(batches: Iterator[pa.RecordBatch], hs=dict(hs)) -> Iterator[pa.RecordBatch]:  # noqa: B008
                sums: dict[str, list] = {n: [0.0, 0.0, 0.0, 0.0] for n in hs}
                for b in batches:
                    if not b.num_rows:
                        continue
                    v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    for n, h in hs.items():
                        w = _fit_rows(v, h)
                        s = sums[n]
                        s[0], s[1] = s[0] + w.T @ v, s[1] + w.T @ w
                        s[2], s[3] = s[2] + ((v - w @ h) ** 2).sum(), s[3] + (v**2).sum()
                out = [(n, np.concatenate([np.ravel(s[0]), np.ravel(s[1]), [s[2], s[3]]]).tolist()) for n, s in sums.items() if np.ndim(s[0])]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([x for _, x in out], pa.list_(pa.float64()))], names=["name", "sums"])

            long = data.mapInArrow(part, "name STRING, sums ARRAY<DOUBLE>").select("name", F.posexplode("sums").alias("i", "x")).groupBy("name", "i").agg(F.sum("x").alias("x"))
            for name, pdf in long.toPandas().groupby("name"):
                x = pdf.sort_values("i").x.to_numpy()
                h = hs[name]
                k = len(h)
                wv, ww = x[: k * n_genes].reshape(k, n_genes), x[k * n_genes : -2].reshape(k, k)
                error[name] = float(np.sqrt(x[-2] / max(x[-1], 1e-300)))
                for _ in range(10):
                    h = h * wv / np.maximum(ww @ h, 1e-12)
                hs[name] = h
    finally:
        data.unpersist()
    return {n: (h[np.argsort(-h.sum(1), kind="stable")], error.get(n, float("nan"))) for n, h in hs.items()}


def component_table(spark: SparkSession, fitted: dict[str, tuple[np.ndarray, float]], genes: list[str]) -> DataFrame:
    """(model, component, gene, weight)."""
    rows = [(n, f"NMF{c + 1}", g, float(h[c, i])) for n, (h, _) in fitted.items() for c in range(len(h)) for i, g in enumerate(genes)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["model", "component", "gene", "weight"]))


def optimal_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of greatest total score (shortest augmenting paths); for matrices of a few hundred rows."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def linkage(distance: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of an agglomerative clustering by Lance-Williams updates; ties by the smaller index."""
    d = distance.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, name, merges = np.ones(n), list(range(n)), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        merges.append((name[i], name[j], float(h), int(size[i] + size[j])))
        k = alive.copy()
        k[[i, j]] = False
        if method == "ward":
            t = size[i] + size[j] + size[k]
            new = np.sqrt(np.maximum(((size[i] + size[k]) * d[i, k] ** 2 + (size[j] + size[k]) * d[j, k] ** 2 - size[k] * h**2) / t, 0))
        else:
            new = (size[i] * d[i, k] + size[j] * d[j, k]) / (size[i] + size[j])
        d[i, k] = d[k, i] = new
        d[j, :] = d[:, j] = np.inf
        alive[j] = False
        size[i] += size[j]
        name[i] = n + step
    return merges


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, clusters: int) -> np.ndarray:
    """Cluster numbers from 0, by first appearance, after all but the last ``clusters - 1`` merges."""
    parent = list(range(2 * n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for s, (a, b, _, _) in enumerate(merges[: max(0, n - clusters)]):
        parent[find(a)] = parent[find(b)] = n + s
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(find(i), len(seen)) for i in range(n)])


def cophenetic_correlation(distance: np.ndarray, merges: list[tuple[int, int, float, int]]) -> float:
    """Correlation of distances with the heights at which their items join; NaN for constant distances."""
    n = len(distance)
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    c = np.zeros((n, n))
    for s, (a, b, h, _) in enumerate(merges):
        c[np.ix_(members[a], members[b])] = h
        c[np.ix_(members[b], members[a])] = h
        members[n + s] = members.pop(a) + members.pop(b)
    i = np.triu_indices(n, 1)
    x, y = distance[i], c[i]
    return float(np.corrcoef(x, y)[0, 1]) if len(x) > 1 and x.std() > 0 and y.std() > 0 else float("nan")


def cluster_groups(vectors: DataFrame, group: str, item: str, vector: str, clusters: int, method: str = "ward", max_items: int = 2000) -> DataFrame:
    """(group, item, cluster): hierarchical clustering of the items within each group, one group per task.

    Items are aggregates, such as tissues or modules of a feature set; a group with more than ``max_items``
    raises ValueError in its task instead of growing without bound.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_items:
            raise ValueError(f"{len(pdf)} items in a group; hierarchical clustering takes at most {max_items}")
        pdf = pdf.sort_values(item)
        x = np.stack(pdf[vector].to_numpy())
        d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0))
        return pd.DataFrame({group: pdf[group].to_numpy(), item: pdf[item].to_numpy(), "cluster": cut_tree(linkage(d, method), len(x), clusters)})

    g, i = vectors.schema[group].dataType.simpleString(), vectors.schema[item].dataType.simpleString()
    return vectors.select(group, item, vector).groupBy(group).applyInPandas(run, f"{group} {g}, {item} {i}, cluster INT")
