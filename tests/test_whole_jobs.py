"""Queries that run over all of their operator's job."""

from __future__ import annotations

from matrixloom.operators import classify, scoring
from matrixloom.plans import core


def test_all_models_and_folds(spark, folder, monkeypatch):
    asked = []

    def cross_validate(data, features, label, models, folds=None):
        asked.append((sorted(models), sorted(r[0] for r in data.select("fold").distinct().collect()) if folds is None else folds))
        rows = [(m, f, "ok", 0.5 + f / 10) for m in models for f in range(5)]
        df = spark.createDataFrame(rows, "model STRING, fold INT, status STRING, macro_f1 DOUBLE")
        return df.selectExpr("*", "macro_f1 AS accuracy", "macro_f1 AS balanced_accuracy", "macro_f1 AS weighted_f1")

    monkeypatch.setattr(classify, "cross_validate", cross_validate)
    assert core.QUERIES["model_comparison"](spark, folder).count() == 4
    core.QUERIES["logreg_cv"](spark, folder)
    assert asked == [(sorted(classify.MODELS), [0, 1, 2, 3, 4]), (["logistic"], [0, 1, 2, 3, 4])]


def test_overlaps_of_all_modules_of_a_set(spark, folder):
    m = [(r.module_id, r.feature_set, set(r["items"])) for r in core.modules(spark, folder).collect() if r["items"]]
    expect = {(f, a, b, len(x & y)): len(x & y) / len(x | y) for a, f, x in m for b, g, y in m if f is not None and f == g and a < b and x & y}
    rows = core.QUERIES["module_overlap_within_sets"](spark, folder).collect()
    got = {(r.feature_set, r.a, r.b, r.n): r.jaccard for r in rows}
    assert len(rows) == len(expect) and got.keys() == expect.keys()
    assert all(abs(got[k] - v) < 1e-5 for k, v in expect.items())


def test_consensus_of_all_methods(spark, folder):
    got = core.QUERIES["all_method_consensus"](spark, folder).collect()
    assert {m for r in got for m in r.methods.split(", ")} == set(scoring.METHODS) and max(r.n_methods for r in got) == 5


def test_adjusted_p_values_of_all_programs(spark, folder, monkeypatch):
    def exchanged(*_):
        raise AssertionError("the draws of all repeats are made a table")

    read, proteins = [], core.proteins
    monkeypatch.setattr(core, "_NULL_N", 30)
    monkeypatch.setattr(core.controls, "ranked_draws", exchanged)
    monkeypatch.setattr(core, "proteins", lambda *a: read.append(1) or proteins(*a))
    got = {(r.program, r.metric): (r.p, r.p_adjusted) for r in core.QUERIES["bh_fdr"](spark, folder).collect()}
    assert len(read) == 1
    p = {(r.program, r.metric): r.p for r in core.QUERIES["abundance_null"](spark, folder).collect()}
    low, expect = 1.0, {}
    for i, k in sorted(enumerate(sorted(p, key=lambda k: (p[k], "|".join(k))), 1), reverse=True):
        low = min(low, p[k] * len(p) / i)
        expect[k] = low
    assert len(got) == 36 and got.keys() == expect.keys() and all(got[k][0] == p[k] and abs(got[k][1] - expect[k]) < 1e-4 for k in p)


def test_fits_share_one_count_of_their_rows(spark, monkeypatch):
    def again(*_):
        raise AssertionError("a fit counts its rows again")

    monkeypatch.setattr(classify, "balanced_weights", again)
    monkeypatch.setattr(classify, "TASK_ROWS", 40, raising=False)
    rows = [(i % 3, float(i % 2) + (i % 7) / 10, None if i % 9 else float("nan"), "ab"[i % 2]) for i in range(120)] + [(0, 0.0, 0.0, "rare"), (1, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "fold INT, x1 DOUBLE, x2 DOUBLE, y STRING").repartition(8)
    got = classify.cross_validate(df, ["x1", "x2"], "y", list(classify.MODELS)).collect()
    assert [(r.model, r.fold, r.status) for r in got] == [(m, f, "ok") for m in classify.MODELS for f in range(3)]
    # a label that no training row has doesn't count; where it is trained, it weighs as much as the others
    assert all(r.n == 40 for r in got) and all(r.accuracy > 0.9 for r in got if r.fold == 0 and r.model != "dense_network")
    own = classify.cross_validate(df.where("fold < 2").selectExpr("0 AS fold", "fold = 1 AS is_test", "x1", "x2", "y"), ["x1", "x2"], "y", ["forest"]).collect()
    assert [(r.fold, r.n, r.status) for r in own] == [(0, 40, "ok")]
