"""Correlation, agreement, neighbours and multiple testing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matrixloom.functions.numbers import safe_corr, safe_div
from matrixloom.operators import order


def pair_correlations(scores: DataFrame, item: str = "program", sample: str = "sample_id", value: str = "score") -> DataFrame:
    """(a, b, n, pearson, spearman) of all pairs of items over the samples that have both.

    Items are few (programs): each sample's items are gathered in one row and paired there, so the samples
    are shuffled once and not joined to themselves.
    """
    ranked = order.ranks(scores.where(F.col(value).isNotNull()), [item], value, "r")
    own = ranked.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(value).alias("v"), "r"))).alias("s"))
    pairs = own.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y")).where("x.i < y.i")
    return pairs.groupBy(F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(
        F.count("*").alias("n"), safe_corr(F.col("x.v"), F.col("y.v")).alias("pearson"), safe_corr(F.col("x.r"), F.col("y.r")).alias("spearman")
    )


def agreement(left: DataFrame, right: DataFrame, by: list[str], key: str = "sample_id", value: str = "score") -> DataFrame:
    """(by, n, pearson, spearman) of two scores of the same items; null below three common pairs."""
    j = left.select(*by, key, F.col(value).alias("x")).join(right.select(*by, key, F.col(value).alias("y")), [*by, key]).where("x IS NOT NULL AND y IS NOT NULL")
    r = order.ranks(order.ranks(j, by, "x", "rx"), by, "y", "ry")
    g = r.groupBy(*by).agg(F.count("*").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("p"), safe_corr(F.col("rx"), F.col("ry")).alias("s"))
    return g.select(*by, "n", F.when(F.col("n") >= 3, F.col("p")).alias("pearson"), F.when(F.col("n") >= 3, F.col("s")).alias("spearman"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or tiny)
            c = 1 + n / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def t_two_sided(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs; null where it is undefined."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    x = df / (df + r * r * df / (1 - r * r))
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return min(1.0, front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """p-values of correlations; a few rows per comparison, so Python is no bottleneck."""
    return pd.Series([t_two_sided(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, n)], dtype="float64")


def benjamini_hochberg(df: DataFrame, p: str, key: str, out: str = "p_adjusted", family: list[str] | None = None) -> DataFrame:
    """Adjusted p-values by the step-up procedure, capped at 1, over all rows (or per ``family``).

    Missing p-values sort last, count in the number of tests and become 1, like every p-value the cap reaches.
    """
    by = family or []
    n = F.count("*").over(Window.partitionBy(*by))
    known = F.when(~F.isnan(p), F.col(p))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(known.asc_nulls_last(), F.col(key)))
    r = df.withColumn("__r", rank).withColumn("__raw", F.least(F.coalesce(known * n / F.col("__r"), F.lit(1.0)), F.lit(1.0)))
    down = Window.partitionBy(*by).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn(out, F.min("__raw").over(down)).drop("__r", "__raw")


def empirical_p(observed: Column, random: Column) -> Column:
    """(number of random >= observed + 1) / (n + 1) as an aggregate; null without an observation or without random values."""
    seen = F.count_if(random.isNotNull())
    return F.when(F.max(observed).isNotNull() & (seen > 0), (F.count_if(random >= observed) + 1) / (seen + 1))


def z_against(observed: Column, random: Column) -> Column:
    """(observed - mean) / sample sd of the random values as an aggregate; null below two values or without variance."""
    sd = F.stddev_samp(random)
    return F.when(F.count(random) >= 2, safe_div(F.max(observed) - F.avg(random), F.nullif(F.round(sd, 12), F.lit(0.0))))


def _packed(df: DataFrame, key: str, vector: str, label: str | None, block: int) -> tuple[DataFrame, int]:
    """((blk, rows), number of blocks): about ``block`` vectors in each row."""
    named = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"))
    named = named.where("key IS NOT NULL AND v IS NOT NULL")
    m = max(1, -(-named.count() // block))
    part = named.withColumn("blk", F.pmod(F.xxhash64("key"), F.lit(m)).cast("int"))
    return part.groupBy("blk").agg(F.collect_list(F.struct("key", "v", "label")).alias("rows")), m


def _block_pairs(ask: DataFrame, df: DataFrame, key: str, vector: str, label: str | None, block: int) -> DataFrame:
    """(own, other): every block of the asking rows beside every block of all rows."""
    own, _ = _packed(ask, key, vector, label, block)
    other, m = _packed(df, key, vector, label, block)
    spread = own.select(F.col("rows").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("blk"))
    return spread.join(other.withColumnRenamed("rows", "other"), "blk").select("own", "other")


def _as_matrix(rows: list[dict]) -> tuple[list, np.ndarray, np.ndarray]:
    return [r["key"] for r in rows], np.array([r["v"] for r in rows], float), np.array([r["label"] for r in rows], object)


def cosine_neighbours(df: DataFrame, key: str, vector: str, k: int = 10, label: str | None = None, queries: str | None = None, block: int = 2000) -> DataFrame:
    """(key, neighbour, label, neighbour_label, similarity, rank): the ``k`` nearest others by cosine, ties by key.

    ``queries`` is a condition on the rows that ask; all rows can answer. Blocks of vectors meet block by
    block: each block pair keeps its best ``k``, and the best of those are chosen per row.
    """
    ask = df.where(queries) if queries else df
    of = df.schema[key].dataType.simpleString()
    m = _block_pairs(ask, df, key, vector, label, block)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ka, x, la = _as_matrix(own)
                kb, y, lb = _as_matrix(other)
                x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
                y = y / np.maximum(np.linalg.norm(y, axis=1), 1e-300)[:, None]
                s = np.round(x @ y.T, 12)
                s[np.array(ka, object)[:, None] == np.array(kb, object)[None, :]] = -9
                order = np.argsort(np.array(kb))
                best = order[np.argsort(-s[:, order], 1, kind="stable")[:, :k]]
                i = np.repeat(np.arange(len(ka)), best.shape[1])
                j = best.ravel()
                use = s[i, j] > -8
                i, j = i[use], j[use]
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"key": np.array(ka, object)[i], "neighbour": np.array(kb, object)[j], "label": la[i], "neighbour_label": lb[j], "similarity": s[i, j]}), preserve_index=False
                ).cast(pa.schema([("key", b.schema.field(0).type.value_type.field("key").type), ("neighbour", b.schema.field(0).type.value_type.field("key").type), ("label", pa.string()), ("neighbour_label", pa.string()), ("similarity", pa.float64())]))

    found = m.mapInArrow(nearest, f"key {of}, neighbour {of}, label STRING, neighbour_label STRING, similarity DOUBLE")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def same_label_share(neighbours: DataFrame, k: int) -> DataFrame:
    """(k, share): mean share of the ``k`` nearest neighbours that have the row's label."""
    near = neighbours.where((F.col("rank") <= k) & F.col("label").isNotNull())
    per = near.groupBy("key").agg(F.avg((F.col("label") == F.col("neighbour_label")).cast("double")).alias("s"))
    return per.agg(F.lit(k).alias("k"), F.avg("s").alias("share"))


def silhouette(df: DataFrame, key: str, vector: str, label: str, block: int = 2000) -> DataFrame:
    """(n, labels, silhouette): mean Euclidean silhouette; null below two labels or with as many labels as rows.

    Every row's distances are summed per label block by block; a label with one row scores 0.
    """
    of = df.schema[key].dataType.simpleString()
    known = df.where(F.col(label).isNotNull())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ka, x, la = _as_matrix(own)
                _, y, lb = _as_matrix(other)
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))
                names, at = np.unique(lb.astype(str), return_inverse=True)
                total = np.zeros((len(ka), len(names)))
                np.add.at(total.T, at, d.T)
                n = np.bincount(at, minlength=len(names))
                i, j = np.repeat(np.arange(len(ka)), len(names)), np.tile(np.arange(len(names)), len(ka))
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"key": np.array(ka, object)[i], "label": la[i], "to": names[j], "total": total[i, j], "n": n[j].astype("int64")}), preserve_index=False
                ).cast(pa.schema([("key", b.schema.field(0).type.value_type.field("key").type), ("label", pa.string()), ("to", pa.string()), ("total", pa.float64()), ("n", pa.int64())]))

    s = _block_pairs(known, known, key, vector, label, block).mapInArrow(sums, f"key {of}, label STRING, to STRING, total DOUBLE, n BIGINT")
    s = s.groupBy("key", "label", "to").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("to")
    per = s.groupBy("key", "label").agg(F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    score = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(safe_div(F.col("b") - F.col("a"), F.nullif(F.greatest("a", "b"), F.lit(0.0))), F.lit(0.0)))
    g = per.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.avg(score).alias("s"))
    return g.select("n", "labels", F.when((F.col("labels") >= 2) & (F.col("labels") < F.col("n")), F.col("s")).alias("silhouette"))


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari, nmi): adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings.

    Both follow from the contingency table; rows without one of the labels don't count.
    """
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    ra, rb = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    n = t.agg(F.sum("n").alias("total"))
    j = t.join(ra, "a").join(rb, "b").join(F.broadcast(n))
    cells = j.agg(F.max("total").alias("n"), F.sum(two(F.col("n"))).alias("ij"), F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda c: -F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))
    ea = ra.join(F.broadcast(n)).agg(F.sum(two(F.col("na"))).alias("sa"), entropy("na").alias("ha"))
    eb = rb.join(F.broadcast(n)).agg(F.sum(two(F.col("nb"))).alias("sb"), entropy("nb").alias("hb"))
    x = cells.join(F.broadcast(ea)).join(F.broadcast(eb))
    expected = F.col("sa") * F.col("sb") / F.nullif(two(F.col("n")), F.lit(0.0))
    ari = F.coalesce(safe_div(F.col("ij") - expected, F.nullif((F.col("sa") + F.col("sb")) / 2 - expected, F.lit(0.0))), F.lit(1.0))
    nmi = F.coalesce(safe_div(F.col("mi"), F.nullif((F.col("ha") + F.col("hb")) / 2, F.lit(0.0))), F.lit(1.0))
    return x.select(F.col("n").cast("bigint").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def hoyer_sparsity(weights: DataFrame, component: str = "component", weight: str = "weight") -> DataFrame:
    """(component, n, sparsity): (sqrt n - L1/L2) / (sqrt n - 1); null below two weights or for zero weights."""
    g = weights.groupBy(component).agg(F.count(weight).alias("n"), F.sum(F.abs(F.col(weight))).alias("l1"), F.sqrt(F.sum(F.col(weight) ** 2)).alias("l2"))
    root = F.sqrt(F.col("n").cast("double"))
    return g.select(component, "n", F.when(F.col("n") > 1, (root - safe_div(F.col("l1"), F.nullif("l2", F.lit(0.0)))) / (root - 1)).alias("sparsity"))


def rank_recommendation(metrics: DataFrame, group: str, k: str, error: str, stability: str, cophenetic: str, recovery: str) -> DataFrame:
    """The ``k`` with the best weighted score per group: scaled error 0.25, stability 0.30, cophenetic 0.20, recovery 0.25."""
    w = Window.partitionBy(group)
    scaled = 1 - (F.col(error) - F.min(error).over(w)) / (F.max(error).over(w) - F.min(error).over(w) + 1e-12)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = metrics.withColumn("score", 0.25 * scaled + 0.30 * zero(stability) + 0.20 * zero(cophenetic) + 0.25 * zero(recovery))
    return s.groupBy(group).agg(F.max_by(F.struct(F.col(k).alias("recommended_k"), "score"), F.struct("score", -F.col(k))).alias("b")).select(group, "b.recommended_k", "b.score")
