"""Clusters of alike profiles against all pairs compared one by one."""

from __future__ import annotations

import numpy as np
import pytest

from matrixloom.llm import cluster


def brute(keys, x, threshold):
    n = len(keys)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            k = np.isfinite(x[i]) & np.isfinite(x[j])
            a, b = x[i][k], x[j][k]
            if k.sum() >= 3 and a.std() > 0 and b.std() > 0 and np.corrcoef(a, b)[0, 1] >= threshold or keys[i] == keys[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    groups = {}
    for k, v in zip(keys, label):
        groups.setdefault(v, set()).add(k)
    return {(min(g), k) for g in groups.values() if len(g) > 1 for k in g}


def table_of(spark, keys, x):
    p = x.shape[1]
    rows = [(k, *[None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)], "extra") for k, r in zip(keys, x)]
    return spark.createDataFrame(rows, "sid STRING, " + ", ".join(f"g{i} DOUBLE" for i in range(p)) + ", id STRING"), [f"g{i}" for i in range(p)]


@pytest.mark.parametrize("noise", [0.15, 0.25])
def test_equals_brute_force(spark, scratch, noise):
    rng = np.random.default_rng(int(noise * 100))
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([centres[:40].repeat(2, 0), centres[40:50].repeat(12, 0), centres[50:]])
    x = x * rng.uniform(0.5, 3, (len(x), 1)) + rng.uniform(-5, 5, (len(x), 1))
    x += rng.standard_normal(x.shape) * noise * x.std(1)[:, None]
    x[rng.random(x.shape) < 0.02] = np.nan
    keys = [f"s{i:04d}" for i in rng.permutation(len(x))]
    keys, x = [*keys, keys[0], keys[1]], np.concatenate([x, x[:2]])
    df, genes = table_of(spark, keys, x)
    got = {tuple(r) for r in cluster.clusters(df, "sid", genes, 0.85, scratch).collect()}
    assert got == brute(keys, x, 0.85)


def test_recall_at_the_threshold(spark, scratch):
    """Pairs of their own with a correlation just above the threshold, the hardest to meet in a cell."""
    rng = np.random.default_rng(77)
    a, e = rng.standard_normal((300, 64)), rng.standard_normal((300, 64))
    x = np.concatenate([a, a + 0.55 * e])
    keys = [f"s{i:04d}" for i in range(600)]
    df, genes = table_of(spark, keys, x)
    got = {tuple(r) for r in cluster.clusters(df, "sid", genes, 0.85, scratch).collect()}
    expect = brute_fast(keys, x, 0.85)
    assert got <= expect and len(got) >= 0.9 * len(expect)


def test_recall_with_more_axes_and_full_cells(spark, scratch, monkeypatch):
    """Cells of three axes and full cells, as large tables have them, lose no more pairs than the few rows above."""
    rng = np.random.default_rng(77)
    a, e = rng.standard_normal((300, 64)), rng.standard_normal((300, 64))
    keys = [f"s{i:04d}" for i in range(600)]
    df, genes = table_of(spark, keys, np.concatenate([a, a + 0.55 * e]))
    points = scratch.save(cluster.quantised_profiles(df, "sid", genes))
    key = {r.id: int(r.key[1:]) for r in points.select("id", "key").collect()}

    def found(**how):
        pairs = {tuple(sorted((key[r.a], key[r.b]))) for r in cluster.alike_links(points, 0.85, scratch, **how).collect()}
        return {p for p in pairs if p[0] + 300 == p[1]}

    every = sum(np.corrcoef(x, y)[0, 1] >= 0.85 for x, y in zip(a, a + 0.55 * e))
    assert len(found(axes=3)) >= 0.9 * every
    plain = found(axes=1, grids=1)
    monkeypatch.setattr(cluster, "CELL_ROWS", 4)
    assert plain and found(axes=1, grids=1) == plain


def test_edge_rows(spark, scratch):
    x = np.array([[1, 2, 3, 4.0], [2, 4, 6, 8.0], [5, 5, 5, 5.0], [np.nan] * 4, [np.nan, np.nan, 1, 2], [1, 2, 3, np.inf], [4, 3, 2, 1.0]])
    df, genes = table_of(spark, ["a", "b", "c", "d", "e", "f", None], x)
    assert {tuple(r) for r in cluster.clusters(df, "sid", genes, 0.85, scratch).collect()} == {("a", "a"), ("a", "b"), ("a", "f")}
    assert cluster.clusters(df.where("false"), "sid", genes, 0.85, scratch).count() == 0


def test_hot_group_of_copies_and_full_cells(spark, scratch, monkeypatch):
    monkeypatch.setattr(cluster, "CELL_ROWS", 40)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(24)
    x = np.concatenate([centre + rng.standard_normal((200, 24)) * 0.2, np.tile(centre * 3 + 1, (150, 1)), rng.standard_normal((40, 24))])
    keys = [f"s{i:04d}" for i in range(len(x))]
    df, genes = table_of(spark, keys, x)
    got = {tuple(r) for r in cluster.clusters(df, "sid", genes, 0.85, scratch).collect()}
    assert got == {(a, b) for a, b in brute_fast(keys, x, 0.85)}


def brute_fast(keys, x, threshold):
    c = np.corrcoef(x) >= threshold
    label = np.arange(len(x))
    while True:
        new = np.array([label[c[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return {(keys[label[i]], keys[i]) for i in range(len(x)) if (label == label[i]).sum() > 1}


def test_labels_of_a_long_chain(spark, scratch):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a BIGINT, b BIGINT")
    got = {r.id: r.label for r in cluster.minimum_labels(links, scratch).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    stars = {r.id: r.label for r in cluster.star_labels(links, scratch).collect()}
    assert stars == got


def test_report(spark, scratch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(16) + rng.standard_normal((6, 16)) * 0.05
    df, genes = table_of(spark, list("abcdef"), x)
    members = cluster.clusters(df, "sid", genes, 0.85, scratch)
    row = cluster.cluster_report(df, "sid", genes, members, 2).first()
    assert (row.cluster_id, row.n_members) == ("a", 6) and len(row.typical) == 2
