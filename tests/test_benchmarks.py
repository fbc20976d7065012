"""Benchmarks of gene sets, factor grids and representations against plain versions."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.operators import atlas, benchmark, classify, controls, factorgrid, matrix, representation, scoring
from matrixloom.sources import readers


def test_metrics_of_a_set():
    rng = np.random.default_rng(3)
    labels = ["a"] * 5 + ["b"] * 4 + ["c"]
    x = rng.normal(size=(10, 6)) + np.array([[0], [0], [0], [0], [0], [2], [2], [2], [2], [5]])
    got = benchmark.set_metrics(x, labels)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert got["pca_pc1"] == pytest.approx(s[0] / s.sum()) and got["pca_pc1_to_pc5"] == pytest.approx(s[:5].sum() / s.sum())
    d = np.array([[np.linalg.norm(a - b) for b in x] for a in x])
    scores = []
    for i, li in enumerate(labels):
        same = [d[i, j] for j, lj in enumerate(labels) if lj == li and j != i]
        b = min(np.mean([d[i, j] for j, lj in enumerate(labels) if lj == o]) for o in set(labels) - {li})
        scores.append((b - np.mean(same)) / max(b, np.mean(same)) if same else 0.0)
    assert got["silhouette"] == pytest.approx(np.mean(scores))
    shares = []
    for i in range(10):
        cos = sorted(((-(x[i] @ x[j]) / np.linalg.norm(x[i]) / np.linalg.norm(x[j]), j) for j in range(10) if j != i))[:3]
        shares.append(np.mean([labels[j] == labels[i] for _, j in cos]))
    assert got["neighbours_same_3"] == pytest.approx(np.mean(shares))
    assert benchmark._agreement(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == (1.0, 1.0)
    assert np.isnan(benchmark.set_metrics(x[:3], ["a", "b", "c"])["silhouette"])


def test_benchmark_finds_a_set_that_tells(spark):
    rng = np.random.default_rng(5)
    samples, label = [f"s{i:02d}" for i in range(12)], [i % 3 for i in range(12)]
    rows = []
    for g in range(60):
        for i, s in enumerate(samples):
            v = float(rng.normal() + (3 * ((label[i] + g) % 3) if g < 12 else 0) + 10)
            if rng.random() > 0.02:
                rows.append(("d", s, f"G{g}", v))
    cells = spark.createDataFrame(rows, "dataset STRING, sample_id STRING, gene STRING, value DOUBLE")
    labels = spark.createDataFrame([("d", s, f"L{x}") for s, x in zip(samples, label)] + [("d", "s99", "unknown"), ("d", "s98", None)], "dataset STRING, sample_id STRING, label STRING")
    sets = spark.createDataFrame([("telling", f"G{g}") for g in range(12)] + [("small", "G1")], "feature_set STRING, gene STRING")
    got = benchmark.benchmark(cells, labels, sets, 20)
    assert got.where("repeat >= 0").select("repeat").distinct().count() == 20 and {r.feature_set for r in got.select("feature_set").distinct().collect()} == {"telling"}
    c = {r.metric: r for r in benchmark.compared(got).collect()}
    assert set(c) == set(benchmark.METRICS) and c["silhouette"].p == pytest.approx(1 / 21) and c["ari"].observed == 1.0 and c["silhouette"].z > 3
    assert benchmark.benchmark(cells.where("false"), labels, sets, 2).count() == 0


def test_core_genes(spark):
    lists = spark.createDataFrame([("a", "p", "X"), ("b", "p", "X"), ("c", "p", "Y"), ("a", "q", "Y")], "dataset STRING, feature_set STRING, gene STRING")
    assert sorted(map(tuple, benchmark.core_genes(lists).collect())) == [("p", "X"), ("q", "Y")]


def test_factor_grid(spark):
    rng = np.random.default_rng(1)
    w, h = rng.random((15, 3)) * (rng.random((15, 3)) > 0.5), rng.random((3, 14))
    v = w @ h + 0.01
    a, b, n = factorgrid.fit(v, 3, 1)
    assert np.linalg.norm(v - a @ b) / np.linalg.norm(v) < 0.05 and n < 3000 and (a >= 0).all() and (b >= 0).all()
    rows = [("all", f"s{i:02d}", f"G{j:02d}", float(v[i, j])) for i in range(15) for j in range(14)]
    values = spark.createDataFrame(rows, "feature_set STRING, sample_id STRING, gene STRING, value DOUBLE")
    runs = factorgrid.grid(values, [2, 3, 40], 3, top=5).cache()
    assert runs.count() == 6 and all(len(r.genes) == r.k and len(r.component_of) == 15 for r in runs.collect())
    bridge = spark.createDataFrame([("p", f"G{j:02d}") for j in range(5)] + [("none", "Z")], "program STRING, gene STRING")
    m = {r.k: r for r in factorgrid.grid_metrics(runs, bridge).collect()}
    assert m[3].mean_error < m[2].mean_error and 0 < m[3].mean_stability <= 1 and m[2].n_seeds == 3
    r = factorgrid.recovery(runs, bridge).where("program = 'none'").collect()
    assert len(r) == 6 and not any(x.recovered for x in r)
    assert factorgrid.matched_similarity([{1, 2}, {3}], [{3}, {1, 2}]) == 1.0
    assert np.isnan(factorgrid.consensus_cophenetic([np.array([0, 1])]))


def test_rows_score_like_cells(spark):
    rng = np.random.default_rng(2)
    genes = [f"g{i}" for i in range(9)]
    x = np.round(rng.normal(size=(20, 9)), 1)
    df = spark.createDataFrame([(f"s{i}", *map(float, r)) for i, r in enumerate(x)] + [("s0", *[-9.0] * 9), (None, *[1.0] * 9)], "sid STRING, " + ", ".join(f"{g} DOUBLE" for g in genes))
    bridge = spark.createDataFrame([("p", "G1"), ("p", "G4"), ("p", "NO"), ("q", "G8"), ("r", "NO")], "program STRING, gene STRING")
    rows = matrix.row_matrix(df, "sid", genes)
    got = {(r.sample_id, r.program): r for r in scoring.score_rows(rows, [g.upper() for g in genes], bridge).collect()}
    expect = {(r.sample_id, r.program): r for r in scoring.score_programs(matrix.unpivot_wide(df, "sid"), bridge).collect()}
    assert got.keys() == expect.keys() and len(got) == 40
    for k, e in expect.items():
        assert [got[k][m] for m in scoring.METHODS] == pytest.approx([e[m] for m in scoring.METHODS], abs=1e-9) and got[k].n_genes == e.n_genes
    with pytest.raises(ValueError):
        scoring.score_rows(rows, genes, bridge, methods=("best",))


def test_random_sets_by_prefix(spark):
    genes = spark.createDataFrame([(f"G{i}",) for i in range(30)], "gene STRING")
    sizes = spark.createDataFrame([("a", 3), ("b", 10)], "name STRING, size INT")
    got = controls.random_sets(genes, sizes, 4).toPandas()
    a, b = ({r: set(d.gene) for r, d in got[got.name == n].groupby("repeat")} for n in "ab")
    assert all(a[r] <= b[r] and len(a[r]) == 3 and len(b[r]) == 10 for r in range(4))


@pytest.mark.parametrize("values", [1_000_000, 40])
def test_abundance_null_equals_brute_force(spark, monkeypatch, values):
    def exchanged(*_):
        raise AssertionError("the draws of all repeats are made a table")

    monkeypatch.setattr(controls, "ranked_draws", exchanged)
    monkeypatch.setattr(controls, "TASK_REPEATS", 7, raising=False)
    monkeypatch.setattr(controls, "TASK_VALUES", values, raising=False)
    rng, repeats = np.random.default_rng(6), 30
    genes = [f"G{i}" for i in range(25)]
    sets = {"a": genes[:4], "b": genes[3:12], "all": genes, "unmeasured": ["G24"]}
    cells = {(f"t{t}", g): float(rng.normal()) for t in range(12) for g in genes[:24] if rng.random() < 0.6} | {(None, "G1"): 0.5, ("one", "G2"): 9.0}
    df = spark.createDataFrame([(t, g, v) for (t, g), v in cells.items()] + [("t0", "G24", None)], "tissue STRING, gene STRING, value DOUBLE")
    bridge = spark.createDataFrame([(p, g) for p, own in sets.items() for g in own], "program STRING, gene STRING")
    got = {(r.program, r.metric): r for r in controls.abundance_null(bridge, spark.createDataFrame([(g,) for g in genes], "gene STRING"), df, repeats).collect()}

    def metrics(own):
        of = {}
        for (t, g), v in cells.items():
            if g in own:
                of.setdefault(t, []).append(v)
        m = sorted((sum(v) / len(v) for v in of.values()), reverse=True)
        return dict(zip(("mean_value", "max_value", "top3_mean", "var_value"), (np.mean(m), m[0], np.mean(m[:3]), np.var(m)))) if m else {}

    orders = [sorted(genes, key=lambda g: md5(f"42|{r}|{g}".encode()).hexdigest()) for r in range(repeats)]
    assert got.keys() == {(p, m) for p in ("a", "b", "all") for m in metrics(genes)}
    for p in ("a", "b", "all"):
        drawn = [metrics(o[: len(sets[p])]) for o in orders]
        for m, v in metrics(sets[p]).items():
            x, r = np.array([d[m] for d in drawn]), got[p, m]
            assert (r.observed, r.random_mean, r.p) == pytest.approx((v, x.mean(), (np.sum(x >= v - 1e-12) + 1) / (repeats + 1)))
            assert (r.z is None and p == "all") or r.z == pytest.approx((v - x.mean()) / x.std(ddof=1))
    assert all(got["all", m].p == 1 for m in metrics(genes))


def test_representations(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i:03d}", f"G{j}", float(rng.normal() + 2 * (i % 2) * (j < 3))) for i in range(60) for j in range(8)]
    cells = spark.createDataFrame(rows, "sample_id STRING, gene STRING, value DOUBLE")
    samples = spark.createDataFrame([(f"s{i:03d}", i % 3, "odd" if i % 2 else "even") for i in range(60)], "sample_id STRING, fold INT, label STRING")
    sets = spark.createDataFrame([("p", "G0"), ("p", "G1"), ("q", "G2"), ("q", "G5")], "program STRING, gene STRING")
    genes = spark.createDataFrame([(f"G{i}",) for i in range(8)], "gene STRING")
    jobs = representation.jobs_for(sets, genes, genes.where("false"), 1)
    assert [j.name for j in jobs] == ["curated_programs", "universe_axes", "random_universe_r1", "random_outside_r1"]
    jobs[1] = representation.Job("universe_axes", "axes", "axes", components=3)
    got = representation.compare(jobs, cells, samples, [f"G{i}" for i in range(8)], ["logistic"]).cache()
    ok = got.where("status = 'ok'")
    assert ok.count() == 9 and ok.where("family = 'curated'").agg(F.avg("accuracy")).first()[0] > 0.85
    assert [tuple(r)[:3] for r in representation.failed_runs(got).select("model", "family", "n").collect()] == [("logistic", "random_outside", 1)]
    f = {r.family: r for r in representation.family_summary(classify.fold_summary(got, ["representation", "family", "model"])).collect()}
    assert f["curated"].n_representations == 1 and f["curated"].accuracy_min == f["curated"].accuracy_max


def test_atlas_rules(spark, tmp_path):
    assert atlas.choose_layer(["x", "raw_counts", "decontXcounts"]) == "decontXcounts" and atlas.choose_layer(["x"]) is None and atlas.choose_layer(["x"], "x") == "x"
    with pytest.raises(ValueError):
        atlas.choose_layer(["x"], "y")
    d = spark.createDataFrame([("B", "c", " a1 "), ("A", "c", "A1"), ("A", "d", None), ("A", "d", "nan")], "d STRING, c STRING, s STRING")
    assert [tuple(r) for r in atlas.annotation(d, "d", "c", "s").collect()] == [("A", "c", "A1")]
    with pytest.raises(ValueError):
        atlas.annotation(d, "d", "c", "none")
    with pytest.raises(ValueError):
        atlas.observed_cells(d, ["method"])
    wide = spark.createDataFrame([("g1", 1.0, None), ("G1", 3.0, 4.0), (None, 1.0, 1.0)], "Name STRING, s1 DOUBLE, s2 DOUBLE")
    assert sorted(map(tuple, readers.gene_rows(wide, "Name").collect())) == [("s1", "G1", 2.0), ("s2", "G1", 4.0)]
    assert [tuple(r) for r in readers.gene_rows(wide, "Name", ["s2"]).collect()] == [("s2", "G1", 4.0)]
    path = str(tmp_path / "m.parquet")
    wide.write.parquet(path)
    assert readers.load_dataset(spark, readers.DatasetConfig("x", path, "Name", genes_as_rows=True)).count() == 2
    w = spark.createDataFrame([("m", "NMF1", g, x) for g, x in (("a", 1.0), ("b", 3.0), ("c", 3.0))], "model STRING, component STRING, gene STRING, weight DOUBLE")
    assert readers.component_genes(w, 2).first().genes == ["b", "c"]
    told = {r.name: (r.found, r.n_rows) for r in readers.inspect(spark, {"a": path, "b": path + "x", "c": "no.suffix"}).collect()}
    assert told == {"a": (True, 3), "b": (False, None), "c": (False, None)}
    s = spark.createDataFrame([("a", 0.5, 0.01), ("b", None, 0.2)], "k STRING, z DOUBLE, p DOUBLE")
    assert [r[0] for r in s.orderBy("k").select(atlas.starred(F.col("z"), F.col("p"))).collect()][0] == "0.50*"
    assert atlas.supported(spark.createDataFrame([(2, 2, 100), (1, 2, 100)], "n_donors INT, n_pseudobulk INT, n_cells_total INT")).count() == 1
