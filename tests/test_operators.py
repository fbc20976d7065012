"""Matrix, scoring, summary, statistics and decomposition operators against small brute-force versions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matrixloom.functions import numbers, text
from matrixloom.operators import classify, controls, decompose, genesets, matrix, pseudobulk, scoring, spatial, stats, summarize

# the score matrix and the scores expected of it
A1 = [("s1", "A", 1.0), ("s1", "B", 3.0), ("s1", "C", 2.0), ("s1", "D", 0.0), ("s2", "A", 4.0), ("s2", "B", 2.0), ("s2", "C", 1.0), ("s2", "D", 8.0), ("s3", "A", 10.0), ("s3", "B", 0.0), ("s3", "C", 5.0), ("s3", "D", 1.0)]
BRIDGE = [("P", "A"), ("P", "B"), ("Q", "C"), ("Q", "D"), ("R", "X")]


@pytest.fixture
def cells(spark):
    return spark.createDataFrame(A1, "sample_id STRING, gene STRING, value DOUBLE")


@pytest.fixture
def bridge(spark):
    return spark.createDataFrame(BRIDGE, "program STRING, gene STRING")


def test_five_scores(cells, bridge):
    got = {(r.sample_id, r.program): r for r in scoring.score_programs(cells, bridge).collect()}
    assert len(got) == 6
    expect = {
        "mean": {"P": (2.0, 3.0, 5.0), "Q": (1.0, 4.5, 3.0)}, "zscore_mean": {"P": (0, 0, 0), "Q": (-0.617580, 0.212149, 0.405431)},
        "rank_percentile": {"P": (0.666667, 0.5, 0.5), "Q": (0.333333, 0.5, 0.5)}, "top10_fraction": {"P": (0.5, 0, 0.5), "Q": (0, 0.5, 0)}, "top20_fraction": {"P": (0.5, 0, 0.5), "Q": (0, 0.5, 0)},
    }
    for m, per in expect.items():
        for p, values in per.items():
            assert [got[(f"s{i + 1}", p)][m] for i in range(3)] == pytest.approx(values, abs=1e-5), (m, p)
    with pytest.raises(ValueError):
        scoring.score_programs(cells, bridge, ("median",))


def test_constant_gene_has_zero_z(spark):
    c = spark.createDataFrame([("a", "G", 5.0), ("b", "G", 5.0)], "sample_id STRING, gene STRING, value DOUBLE")
    assert {r.z for r in matrix.zscores_by_moments(c).collect()} == {0.0}
    assert {r.z for r in matrix.gene_zscores(c).collect()} == {0.0}


def test_availability(cells, bridge):
    got = {r.program: tuple(r)[1:] for r in genesets.availability(bridge, cells).collect()}
    assert got["P"] == (2, 2, 1.0, "A, B", "") and got["R"] == (1, 0, 0.0, "", "X")


def test_sparse_scores_equal_dense(cells, bridge):
    nonzero = cells.where("value <> 0")
    dense = {(r.sample_id, r.program): r for r in scoring.score_programs(cells, bridge).collect()}
    for r in scoring.sparse_scores(nonzero, bridge, cells).collect():
        assert r.score == pytest.approx(dense[(r.sample_id, r.program)]["mean"])
    for r in scoring.sparse_zscore_means(nonzero, bridge, 3).collect():
        assert r.score == pytest.approx(dense[(r.sample_id, r.program)]["zscore_mean"], abs=1e-9)


def test_densify_and_variable_genes(spark):
    c = spark.createDataFrame([("a", "X", 1.0), ("b", "Y", 2.0), ("a", "Y", 2.0), ("a", "Z", 3.0), ("b", "Z", 3.0)], "sample_id STRING, gene STRING, value DOUBLE")
    assert sorted(tuple(r) for r in matrix.densify(c).collect() if r.value == 0) == [("b", "X", 0.0)]
    assert sorted(r.gene for r in matrix.variable_genes(c, 2).collect()) == ["X"]


def test_unpivot_cleans(spark):
    df = spark.createDataFrame([("a", 1.0, float("nan")), ("a", 1.0, float("nan")), (None, 1.0, 1.0), ("b", None, 2.0)], "id STRING, g1 DOUBLE, `g 2` DOUBLE")
    assert sorted(map(tuple, matrix.unpivot_wide(df, "id").collect())) == [("a", "G 2", 0.0), ("a", "G1", 1.0), ("b", "G 2", 2.0), ("b", "G1", 0.0)]
    assert matrix.unpivot_wide(df, "id", fill=None).count() == 2


def test_text(spark):
    df = spark.createDataFrame([(" tp53\t", "a, B,,a", "GTEX-1-2-3", "1.5d"), ("nan", None, "X-1", "1e3")], "s STRING, l STRING, i STRING, n STRING")
    rows = df.select(text.normalize_symbol(F.col("s")), text.parse_items(F.col("l")), text.split_items(F.col("l")), text.subject_id(F.col("i")), text.to_number(F.col("n"))).collect()
    assert tuple(rows[0]) == ("TP53", ["A", "B"], ["A", "B", "A"], "GTEX-1", None)
    assert tuple(rows[1]) == (None, [], [], "", 1000.0)
    c = spark.createDataFrame([("Non-Tumor",), ("healthy donor",), (None,)], "t STRING").select(text.condition_group(F.col("t")))
    assert [r[0] for r in c.collect()] == ["disease_like", "normal_like", "uncertain"]
    b = spark.createDataFrame([(0.5,), (0.7,), (0.85,), (None,)], "f DOUBLE").select(text.support_level(F.col("f")), text.validation_strength(F.col("f")))
    assert [tuple(r) for r in b.collect()] == [("weak", "moderate"), ("moderate", "strong"), ("strong", "very strong"), (None, "uncertain")]


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, 0.20)], "k INT, p DOUBLE")
    got = [r.p_adjusted for r in stats.benjamini_hochberg(p, "p", "k").orderBy("k").collect()]
    assert got == pytest.approx([0.05, 0.066667, 0.066667, 1.0, 0.25], abs=1e-5)


def test_p_values():
    assert stats.t_two_sided(0.5, 10) == pytest.approx(0.1411, abs=1e-4)
    assert stats.t_two_sided(0.9, 5) == pytest.approx(0.0374, abs=1e-4)
    assert stats.t_two_sided(None, 5) is None and stats.t_two_sided(0.1, 2) is None and stats.t_two_sided(1.0, 5) == 0.0


def test_correlations(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame(rng.integers(0, 6, (40, 3)).astype(float), columns=list("abc"))
    long = [(f"s{i}", c, float(x[c][i])) for i in range(40) for c in "abc"]
    got = {(r.a, r.b): r for r in stats.pair_correlations(spark.createDataFrame(long, "sample_id STRING, program STRING, score DOUBLE")).collect()}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        assert got[(a, b)].pearson == pytest.approx(x[a].corr(x[b]))
        assert got[(a, b)].spearman == pytest.approx(x[a].rank().corr(x[b].rank()))


def test_neighbours_silhouette_and_agreement(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 8))
    lab = rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, v[i].tolist(), int(lab[i])) for i in range(60)], "id INT, v ARRAY<DOUBLE>, label INT")
    got = stats.cosine_neighbours(df, "id", "v", 4, "label", block=17).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for i in range(60):
        assert [r.neighbour for r in sorted((r for r in got if r.key == i), key=lambda r: r.rank)] == np.argsort(-s[i])[:4].tolist()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    a = np.array([d[i][(lab == lab[i]) & (np.arange(60) != i)].mean() for i in range(60)])
    b = np.array([min(d[i][lab == c].mean() for c in range(3) if c != lab[i]) for i in range(60)])
    row = stats.silhouette(df, "id", "v", "label", block=17).first()
    assert (row.n, row.labels) == (60, 3) and row.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    same = stats.label_agreement(df.withColumn("other", F.col("label") + 5), "label", "other").first()
    assert same.ari == pytest.approx(1) and same.nmi == pytest.approx(1)


def test_random_sets_and_empirical_p(spark):
    genes = spark.createDataFrame([(f"g{i}",) for i in range(20)], "gene STRING")
    sizes = spark.createDataFrame([("P", 3), ("Q", 5)], "name STRING, size INT")
    sets = controls.random_sets(genes, sizes, 7).toPandas().groupby(["name", "repeat"]).gene.nunique()
    assert set(sets["P"]) == {3} and set(sets["Q"]) == {5} and len(sets) == 14
    r = spark.createDataFrame([(2.0, 1.0), (2.0, 2.0), (2.0, 3.0)], "o DOUBLE, r DOUBLE").agg(stats.empirical_p(F.col("o"), F.col("r")), stats.z_against(F.col("o"), F.col("r"))).first()
    assert tuple(r) == (0.75, 0.0)


def test_overlaps_and_best_match(spark):
    left = spark.createDataFrame([("m", g) for g in "abcdef"] + [("n", g) for g in "xy"], "name STRING, gene STRING")
    right = spark.createDataFrame([("P", g) for g in "abcd"] + [("Q", g) for g in "abcdeg"], "name STRING, gene STRING")
    best = genesets.best_match(genesets.overlaps(left, right)).collect()
    assert [(r.a, r.b, r.is_match) for r in best] == [("m", "P", True)]
    assert [tuple(r)[:3] for r in genesets.overlaps(right).collect()] == [("P", "Q", 4)]


def test_summaries(spark):
    df = spark.createDataFrame([("a", "s1", "d1", "P", 1.0), ("a", "s2", "d1", "P", 3.0), (None, "s3", "d2", "P", 5.0), ("a", "s4", "d3", "P", None)], "tissue STRING, sample_id STRING, subject_id STRING, program STRING, score DOUBLE")
    got = {r.tissue: r for r in summarize.group_summary(df, ["tissue"]).collect()}
    assert (got["a"].n_samples, got["a"].n_subjects, got["a"].mean_score, got["a"].std_score, got["a"].q75_score) == (3, 2, 2.0, 1.0, 2.5)
    assert got[None].n_samples == 1
    total = {r.tissue: r.n for r in summarize.with_totals(df, "tissue", "all", [F.count("*").alias("n")]).collect()}
    assert total == {"a": 3, None: 1, "all": 4}
    assert [r.n for r in summarize.histogram(df, "score", 2).orderBy("bin").collect()] == [1, 2]
    assert tuple(summarize.robust_range(df.where("false"), "score").first()) == (-1.0, 1.0)
    assert summarize.stratified_sample(df, "program", "sample_id", 2).count() == 2


def test_folds_metrics_and_failures(spark):
    df = spark.createDataFrame([(f"d{i % 30}", float(i % 3), float(i % 7), "abc"[i % 3]) for i in range(300)], "subject STRING, x1 DOUBLE, x2 DOUBLE, y STRING")
    f = classify.grouped_folds(df, "subject", 3)
    assert f.select("subject", "fold").distinct().count() == 30
    got = classify.cross_validate(f, ["x1", "x2"], "y", ["logistic", "missing_model"], [0]).collect()
    assert [r.status for r in got] == ["ok", "failed"] and got[0].accuracy > 0.9 and "missing_model" in got[1].error
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "t STRING, predicted STRING")
    m = classify.metrics(p, "t").first()
    assert (m.accuracy, m.balanced_accuracy) == (0.5, 0.5) and m.macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3) and m.weighted_f1 == pytest.approx((2 / 3 + 0.5) / 2)
    with pytest.raises(ValueError):
        classify.grouped_folds(df, "subject", 1)


def test_pseudobulk_and_spots(spark):
    cells = spark.createDataFrame([(i, "t" if i < 25 else "u", None) for i in range(30)], "cell_id INT, kind STRING, donor STRING")
    counts = spark.createDataFrame([(i, "G", 2.0) for i in range(30)], "cell_id INT, gene STRING, value DOUBLE")
    assert [tuple(r) for r in pseudobulk.pseudobulk(counts, cells, ["kind", "donor"]).collect()] == [("t|nan", "G", 50.0)]
    spots = spark.createDataFrame([("b1", "A", 3.0), ("b1", "Z", 1.0), ("b2", "Z", 4.0), ("b3", "A", 1.0)], "barcode STRING, gene STRING, value DOUBLE")
    at = spark.createDataFrame([("b1", 1), ("b2", 1), ("b3", None), ("b9", 1)], "barcode STRING, in_tissue INT")
    bridge = spark.createDataFrame([("P", "A"), ("P", "Q")], "program STRING, gene STRING")
    got = {r.barcode: r.score for r in spatial.spot_scores(spots, bridge, at).collect()}
    assert got == {"b1": pytest.approx(math.log1p(750000)), "b2": 0.0}


def test_decomposition(spark):
    rng = np.random.default_rng(1)
    w, h = rng.random((120, 2)), np.array([[1, 1, 0, 0, 0.2], [0, 0, 1, 1, 0.2]])
    rows = spark.createDataFrame([(i, (w[i] @ h).tolist()) for i in range(120)], "sample_id INT, features ARRAY<DOUBLE>")
    (found, error), = decompose.nmf(rows, [("m", 2, 1)], 5, rounds=40).values()
    assert error < 0.05 and {int(np.argmax(x)) in (0, 1) for x in found} == {True, False}
    s = rng.random((5, 7))
    import itertools

    best = max(sum(s[i, p[i]] for i in range(5)) for p in itertools.permutations(range(7), 5))
    assert sum(s[a, b] for a, b in decompose.optimal_assignment(s)) == pytest.approx(best)
    assert sum(s.T[a, b] for a, b in decompose.optimal_assignment(s.T)) == pytest.approx(best)
    x = np.concatenate([rng.normal(0, 0.1, (6, 3)), rng.normal(5, 0.1, (5, 3))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for method in ("ward", "average"):
        merges = decompose.linkage(d, method)
        assert decompose.cut_tree(merges, 11, 2).tolist() == [0] * 6 + [1] * 5
        assert decompose.cophenetic_correlation(d, merges) > 0.95
    v = spark.createDataFrame([("g", i, x[i].tolist()) for i in range(11)], "grp STRING, item INT, vec ARRAY<DOUBLE>")
    assert decompose.cluster_groups(v, "grp", "item", "vec", 2).select("cluster").distinct().count() == 2


def test_rounding_is_stable(spark):
    assert spark.range(1).select(numbers.rounded(F.lit(-1e-12))).first()[0] == 0.0


def test_consolidation(spark):
    from matrixloom.operators import consolidate

    rows = [("d", 1, list("abcd")), ("d", 2, list("abce")), ("d", 3, list("wxyz")), ("d", 4, list("wxyv")), ("e", 5, ["q"]), ("e", 6, [])]
    m = spark.createDataFrame(rows, "dataset STRING, module_id BIGINT, items ARRAY<STRING>")
    c = consolidate.clustered_modules(m, "dataset", 2)
    got = {r.module_id: r.cluster for r in c.collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}
    bridge = spark.createDataFrame([("P", g) for g in "abcd"] + [("Q", g) for g in "wxyzq"], "program STRING, gene STRING")
    a = consolidate.assigned_programs(consolidate.cluster_program_scores(c, m, bridge, "dataset"), "dataset").collect()
    assert {(r.dataset, r.cluster): r.program for r in a} == {("d", 0): "P", ("d", 1): "Q", ("e", 0): "Q"}
    top = spark.createDataFrame([("m1", "c1", "a"), ("m1", "c1", "b"), ("m1", "c2", "x"), ("m2", "k1", "x"), ("m2", "k2", "a")], "model STRING, component STRING, gene STRING")
    assert consolidate.matched_stability(top, "m1", "m2") == pytest.approx((0.5 + 1.0) / 2)


def test_stream_windows(spark, tmp_path):
    from matrixloom.streaming import scorer

    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 5.0)]
    spark.createDataFrame(rows, "t STRING, k STRING, v DOUBLE").selectExpr("cast(t AS TIMESTAMP) ts", "k", "v").write.parquet(f"{tmp_path}/in.parquet")
    stream = scorer.open_table_stream(spark, f"{tmp_path}/in.parquet")
    for _ in range(2):  # the second call finds nothing new
        scorer.run_once(scorer.event_windows(stream, "ts", "k", "v"), f"{tmp_path}/out")
    got = [(r.k, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()]
    assert got == [("a", 2, 3.0)]
