"""How well gene sets tell labelled samples apart, against random gene sets of their size.

Samples are aggregates, such as tissues, so a data set has few of them and many genes. A set's figures come from
one small matrix; sets, repeats and data sets are spread over the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.functions.numbers import safe_div
from matrixloom.operators.decompose import cut_tree, linkage
from matrixloom.operators.stats import benjamini_hochberg, empirical_p, z_against

#: Labelled samples of a data set, and data sets times feature sets, at most; more raise ValueError.
MAX_SAMPLES, MAX_SETS = 1500, 20_000
METRICS = (
    "pca_pc1", "pca_pc1_pc2", "pca_pc1_to_pc5", "silhouette", "silhouette_pca10", "neighbours_same_3", "neighbours_same_5", "ari", "nmi",
)
#: The metrics of the short table.
KEY_METRICS = ("pca_pc1_pc2", "silhouette_pca10", "neighbours_same_3", "ari", "nmi")


def _silhouette(d: np.ndarray, code: np.ndarray) -> float:
    n, k = len(code), code.max() + 1
    if k < 2 or k >= n:
        return float("nan")
    one = np.eye(k)[code]
    size, sums = one.sum(0), d @ one
    own = size[code]
    a = sums[np.arange(n), code] / np.maximum(own - 1, 1)
    other = sums / size
    other[np.arange(n), code] = np.inf
    b = other.min(1)
    top = np.maximum(a, b)
    return float(np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).mean())


def _neighbours(x: np.ndarray, code: np.ndarray, k: int) -> float:
    if len(x) <= k:
        return float("nan")
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -np.inf)
    near = np.argsort(-s, 1, kind="stable")[:, :k]
    return float((code[near] == code[:, None]).mean())


def _agreement(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Adjusted Rand index and normalised mutual information."""
    t = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(t, (a, b), 1)
    n, ra, rb = t.sum(), t.sum(1), t.sum(0)
    two = lambda v: (v * (v - 1) / 2).sum()
    expected, top = two(ra) * two(rb) / max(n * (n - 1) / 2, 1), (two(ra) + two(rb)) / 2
    ari = 1.0 if top == expected else (two(t) - expected) / (top - expected)
    p = t[t > 0] / n
    mi = float((p * np.log(p / (np.outer(ra, rb)[t > 0] / n**2))).sum())
    ha, hb = (-(v[v > 0] / n * np.log(v[v > 0] / n)).sum() for v in (ra, rb))
    return float(ari), 1.0 if ha + hb == 0 else float(mi / ((ha + hb) / 2))


def set_metrics(x: np.ndarray, labels: list[str]) -> dict[str, float]:
    """The metrics of a samples x genes matrix: variance shares of the principal axes, silhouettes of the labels, share of
    neighbours with the same label, and agreement of a Ward clustering with the labels."""
    code = np.unique(labels, return_inverse=True)[1]
    c = x - x.mean(0)
    gram = c @ c.T
    w, u = np.linalg.eigh(gram)
    w, u = np.maximum(w[::-1], 0), u[:, ::-1]
    m = min(10, len(x) - 1, x.shape[1])
    share = np.cumsum(w[:m]) / max(w.sum(), 1e-300)
    far = lambda y: np.sqrt(np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * y @ y.T, 0))
    d = far(c)
    np.fill_diagonal(d, 0)
    axes = far(u[:, :m] * np.sqrt(w[:m]))
    np.fill_diagonal(axes, 0)
    ari, nmi = _agreement(code, cut_tree(linkage(d, "ward"), len(x), min(code.max() + 1, len(x))))
    values = (share[0], share[min(1, m - 1)], share[min(4, m - 1)], _silhouette(d, code), _silhouette(axes, code), _neighbours(x, code, 3), _neighbours(x, code, 5), ari, nmi)
    return dict(zip(METRICS, map(float, values)))


def labelled(labels: DataFrame, least: int = 2) -> DataFrame:
    """(dataset, sample_id, label) without null and ``unknown`` labels and labels of fewer than ``least`` samples in their data set."""
    one = labels.where("label IS NOT NULL AND label <> 'unknown'").groupBy("dataset", "sample_id").agg(F.min("label").alias("label"))
    n = F.count("*").over(Window.partitionBy("dataset", "label"))
    return one.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def gene_vectors(cells: DataFrame, order: DataFrame) -> DataFrame:
    """(dataset, gene, vec): each varying gene's z-scores, taken over all samples of the data set, of the samples in ``order``.

    ``cells``: (dataset, sample_id, gene, value), absent cells 0. ``order``: (dataset, samples), the labelled
    samples in their order.
    """
    n = cells.groupBy("dataset").agg(F.count_distinct("sample_id").alias("n"))
    v = F.col("value")
    g = cells.groupBy("dataset", "gene").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "value"))).alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    g = g.join(n, "dataset").join(order, "dataset").withColumn("mean", F.col("s") / F.col("n"))
    g = g.withColumn("sd", F.sqrt(F.greatest(F.col("ss") / F.col("n") - F.col("mean") ** 2, F.lit(0.0)))).where("sd > 1e-9")
    z = F.transform("samples", lambda s: (F.coalesce(F.try_element_at("m", s), F.lit(0.0)) - F.col("mean")) / F.col("sd"))
    return g.select("dataset", "gene", z.alias("vec"))


def benchmark(
    cells: DataFrame, labels: DataFrame, sets: DataFrame, repeats: int, seed: int = 42, min_genes: int = 10, least_samples: int = 6, outside: DataFrame | None = None
) -> DataFrame:
    """(dataset, feature_set, n_genes, repeat, metric, value): each set's metrics (repeat -1) and those of ``repeats`` random sets of its size.

    ``cells``: (dataset, sample_id, gene, value); ``labels``: (dataset, sample_id, label); ``sets``: (feature_set,
    gene). Random genes are those of the data set that are in none of ``outside`` (gene; default: of the sets), in
    the order of a seeded digest; a set with fewer of them than genes has no random sets. Data sets with fewer
    than ``least_samples`` labelled samples or two labels, and sets with fewer than ``min_genes`` genes there, are left out.
    """
    spark = cells.sparkSession
    told = labelled(labels).limit(MAX_SETS + 1).toPandas()
    if len(told) > MAX_SETS:
        raise ValueError(f"more than {MAX_SETS} labelled samples; the samples of a benchmark are aggregates")
    of = {}
    for name, pdf in told.sort_values(["dataset", "sample_id"]).groupby("dataset"):
        if len(pdf) > MAX_SAMPLES:
            raise ValueError(f"{name} has {len(pdf)} labelled samples; at most {MAX_SAMPLES} are compared")
        if len(pdf) >= least_samples and pdf.label.nunique() > 1:
            of[name] = (pdf.sample_id.tolist(), pdf.label.tolist())
    order = spark.createDataFrame([(k, v[0]) for k, v in of.items()], "dataset STRING, samples ARRAY<STRING>")
    vectors = gene_vectors(cells, order)
    here = vectors.select("dataset", "gene").join(sets.select("feature_set", "gene").distinct(), "gene")
    size = here.groupBy("dataset", "feature_set").agg(F.count("*").alias("n")).where(F.col("n") >= min_genes)
    free = vectors.select("dataset", "gene").join((sets if outside is None else outside).select("gene").distinct(), "gene", "left_anti")
    n_free = free.groupBy("dataset").agg(F.count("*").alias("free"))
    rows = size.join(n_free, "dataset", "left").limit(MAX_SETS + 1).collect()
    if len(rows) > MAX_SETS:
        raise ValueError(f"more than {MAX_SETS} feature sets")
    sizes: dict[str, list[tuple[str, int]]] = {}
    for r in rows:
        if r.free is not None and r.free >= r.n:
            sizes.setdefault(r.dataset, []).append((r.feature_set, r.n))
    most = spark.createDataFrame([(d, max(n for _, n in v)) for d, v in sizes.items()], "dataset STRING, most INT")
    own = here.join(size, ["dataset", "feature_set"]).select("dataset", F.concat(F.lit("set "), "feature_set").alias("run"), F.lit(0).alias("place"), "gene")
    draws = free.join(most, "dataset").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col("gene")))
    place = F.row_number().over(Window.partitionBy("dataset", "repeat").orderBy(digest, "gene"))
    drawn = draws.withColumn("place", place).where(F.col("place") <= F.col("most")).select("dataset", F.col("repeat").cast("string").alias("run"), "place", "gene")

    def figures(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dataset, run = key
        pdf = pdf.sort_values(["place", "gene"])
        x = np.stack(pdf["vec"].to_numpy())
        random = not run.startswith("set ")
        out = []
        for name, n in sizes.get(dataset, []) if random else [(run[4:], len(x))]:
            for metric, v in set_metrics(x[:n].T, of[dataset][1]).items():
                out.append((dataset, name, n, int(run) if random else -1, metric, None if np.isnan(v) else v))
        return pd.DataFrame(out, columns=["dataset", "feature_set", "n_genes", "repeat", "metric", "value"])

    members = own.unionByName(drawn).join(vectors, ["dataset", "gene"])
    # few bytes but much work: over a fixed number of tasks, which Spark doesn't merge by their size
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, "dataset", "run").groupBy("dataset", "run").applyInPandas(figures, "dataset STRING, feature_set STRING, n_genes INT, repeat INT, metric STRING, value DOUBLE")


def compared(results: DataFrame) -> DataFrame:
    """(dataset, feature_set, n_genes, metric, observed, random_mean, random_std, z, p, p_adjusted): every metric against the random sets; adjusted over all rows."""
    keys = ["dataset", "feature_set", "metric"]
    seen = results.where("repeat = -1").select(*keys, "n_genes", F.col("value").alias("observed"))
    j = results.where("repeat >= 0").select(*keys, F.round("value", 9).alias("v")).join(seen, keys)
    o = F.round("observed", 9)
    c = j.groupBy(*keys).agg(
        F.max("n_genes").alias("n_genes"), F.max("observed").alias("observed"), F.avg("v").alias("random_mean"), F.stddev_samp("v").alias("random_std"),
        z_against(o, F.col("v")).alias("z"), empirical_p(o, F.col("v")).alias("p"),
    )
    return benjamini_hochberg(c.withColumn("__key", F.concat_ws("|", *keys)), "p", "__key").drop("__key")


def core_genes(lists: DataFrame, share: float = 0.5) -> DataFrame:
    """(feature_set, gene): genes that at least ``share`` of the data sets with a list for the set have on it.

    ``lists``: (dataset, feature_set, gene).
    """
    n = lists.groupBy("feature_set").agg(F.count_distinct("dataset").alias("of"))
    g = lists.groupBy("feature_set", "gene").agg(F.count_distinct("dataset").alias("n"))
    return g.join(n, "feature_set").where(safe_div(F.col("n"), F.col("of")) >= share).select("feature_set", "gene")
