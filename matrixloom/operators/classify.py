"""Donor-grouped cross-validation: folds, weights, models and metrics."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.functions.numbers import safe_div
from matrixloom.session import Scratch


def grouped_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0..folds-1 by a seeded digest of the group: a donor's rows are never split.

    No donor counts are gathered; with many donors the folds are about equally large. A null group is one donor.
    """
    if folds < 2:
        raise ValueError("at least two folds are needed")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(group), F.lit(""))))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % folds).cast("int"))


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``df`` with weights rows / (classes x rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    return df.join(n, label).crossJoin(total).withColumn(out, F.col("__t") / (F.col("__k") * F.col("__n"))).drop("__n", "__t", "__k")


def majority_predictions(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``predicted``: the most frequent label of the other folds, the first by name on ties."""
    n = df.groupBy("fold", label).agg(F.count("*").alias("n"))
    total = n.groupBy(label).agg(F.sum("n").alias("total"))
    folds = n.select(F.col("fold").alias("test")).distinct()
    train = folds.crossJoin(total).join(n.select(F.col("fold").alias("test"), label, "n"), ["test", label], "left").withColumn("m", F.col("total") - F.coalesce("n", F.lit(0)))
    best = train.groupBy(F.col("test").alias("fold")).agg(F.min_by(label, F.struct(-F.col("m"), F.col(label))).alias("predicted"))
    return df.join(best, "fold")


def confusion(predictions: DataFrame, label: str, predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """(by, label, predicted, n, share): counts and their share of the label's rows."""
    by = by or []
    c = predictions.groupBy(*by, label, predicted).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, label)))


def metrics(predictions: DataFrame, label: str, predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """accuracy, balanced accuracy, macro and weighted F1 per ``by``, from the contingency table alone.

    Balanced accuracy is the mean recall of the classes that occur as truth; macro F1 is over all classes that
    occur as truth or prediction; weighted F1 weighs by the truth's counts.
    """
    by = by or []
    return _metrics(predictions.groupBy(*by, F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n")), by)


def _metrics(c: DataFrame, by: list[str]) -> DataFrame:
    """:func:`metrics` of the contingency table (by, t, p, n)."""
    truth = c.groupBy(*by, F.col("t").alias("c")).agg(F.sum("n").alias("nt"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    guess = c.groupBy(*by, F.col("p").alias("c")).agg(F.sum("n").alias("np"))
    j = truth.join(guess, [*by, "c"], "full").na.fill(0, ["nt", "np", "hit"])
    f1 = F.coalesce(safe_div(2.0 * F.col("hit"), F.nullif(F.col("nt") + F.col("np"), F.lit(0))), F.lit(0.0))
    return j.groupBy(*by).agg(
        F.sum("nt").alias("n"), (F.sum("hit") / F.sum("nt")).alias("accuracy"), F.avg(F.when(F.col("nt") > 0, F.col("hit") / F.col("nt"))).alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("nt")) / F.sum("nt")).alias("weighted_f1"),
    )


#: name -> (classifier from numbers of features, classes and rows, whether features are scaled)
MODELS: dict[str, tuple[Callable, bool]] = {
    "logistic": (lambda p, k, n: LogisticRegression(family="multinomial", weightCol="__weight", labelCol="__y", featuresCol="__x", regParam=1.0 / max(n, 1), maxIter=100, standardization=False), True),
    "forest": (lambda p, k, n: RandomForestClassifier(numTrees=30, maxDepth=10, minInstancesPerNode=2, weightCol="__weight", labelCol="__y", featuresCol="__x", seed=42), False),
    "bagged_trees": (lambda p, k, n: RandomForestClassifier(numTrees=20, maxDepth=10, featureSubsetStrategy="all", weightCol="__weight", labelCol="__y", featuresCol="__x", seed=42), False),
    "dense_network": (lambda p, k, n: MultilayerPerceptronClassifier(layers=[p, 32, k], labelCol="__y", featuresCol="__x", maxIter=60, seed=42), True),
}
#: Folds that a cross-validation takes at most.
MAX_FOLDS = 1000
#: Rows of a task of a fit. Each step of an optimiser is a job, and trees send the counts of all their nodes from each task, so tasks shouldn't be small.
TASK_ROWS = 50_000
_ROW = "model STRING, fold INT, status STRING, error STRING, n BIGINT, accuracy DOUBLE, balanced_accuracy DOUBLE, macro_f1 DOUBLE, weighted_f1 DOUBLE"


def _fold_counts(name: str, fold: int, train: DataFrame, test: DataFrame, sizes: dict[str, int], width: int, components: int | None) -> tuple[str, list[tuple]]:
    """Fit one model on one fold: (error or nothing, (label, predicted, n) of the test rows).

    ``train`` and ``test`` have ``__label`` and ``__raw``, the vector of ``width`` features; ``sizes`` are the training
    rows of each label. They give the codes, weights and numbers of rows and classes, so nothing is counted again.
    """
    try:
        make, scaled = MODELS[name]
        labels = sorted(sizes, key=lambda x: x.encode("utf-16-be"))  # as Spark sorts them
        n, k = sum(sizes.values()), len(labels)
        weights = F.array(*[F.lit(n / (k * sizes[x])) for x in labels])
        code = StringIndexerModel.from_labels(labels, "__label", "__y", "skip")
        stages, raw = [], "__raw"
        if components:
            stages += [StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True), PCA(k=components, inputCol="__scaled", outputCol="__axes")]
            raw = "__axes"
        if scaled or components:
            stages.append(StandardScaler(inputCol=raw, outputCol="__x", withMean=True))
            raw = "__x"
        model = make(components or width, k, n).setFeaturesCol(raw)
        coded = code.transform(train).withColumn("__weight", F.get(weights, F.col("__y").cast("int")))
        told = Pipeline(stages=[*stages, model]).fit(coded).transform(code.transform(test))
        counts = told.groupBy("__y", "prediction").agg(F.count("*").alias("n")).collect()
        return "", [(labels[int(r[0])], labels[int(r[1])], r["n"]) for r in counts]
    except Exception as e:  # noqa: BLE001
        return str(e)[:200] or type(e).__name__, []


def cross_validate(
    df: DataFrame, features: list[str], label: str, models: list[str], folds: list[int] | None = None, components: int | None = None, parallelism: int | None = None
) -> DataFrame:
    """One row per model and fold: status, error, sizes and the metrics on the fold.

    ``df`` has ``fold``; models are fitted on all rows of the other folds. With a column ``is_test`` the rows of a
    fold are its training and test rows with features of their own. ``components`` puts that many principal axes,
    fitted on the training rows, in the features' place. A model that fails has status ``failed`` and the error's
    text, and the others go on. Missing features are 0. Several fits are under way at a time: half as many as there
    are cores, 8 at most, as the driver holds the nodes of the trees of each.

    The features are gathered in a vector and written once; rows are counted once by fold and label for all fits.
    """
    spark = df.sparkSession
    apart = ["is_test"] if "is_test" in df.columns else []
    scratch = Scratch(spark, "folds")
    known = df.where(F.col(label).isNotNull()).na.fill(0.0, features)
    vector = VectorAssembler(inputCols=features, outputCol="__raw").transform(known)
    data = saved = scratch.save(vector.select("fold", *apart, F.col(label).cast("string").alias("__label"), "__raw"))
    try:
        sizes = data.where("fold IS NOT NULL").groupBy("fold", *apart, "__label").agg(F.count("*").alias("n")).collect()
        data = data.coalesce(max(1, -(-sum(r["n"] for r in sizes) // TASK_ROWS)))
        if folds is None:
            folds = sorted({r["fold"] for r in sizes})
            if len(folds) > MAX_FOLDS:
                raise ValueError(f"more than {MAX_FOLDS} folds")

        def split(f: int) -> tuple[DataFrame, DataFrame, dict[str, int]]:
            inside = (lambda r: r["fold"] == f and r["is_test"] is False) if apart else (lambda r: r["fold"] != f)
            own: dict[str, int] = {}
            for r in filter(inside, sizes):
                own[r["__label"]] = own.get(r["__label"], 0) + r["n"]
            if apart:
                rows = data.where(F.col("fold") == f)
                return rows.where("NOT is_test"), rows.where("is_test"), own
            return data.where(F.col("fold") != f), data.where(F.col("fold") == f), own

        with ThreadPoolExecutor(max_workers=parallelism or min(8, max(1, spark.sparkContext.defaultParallelism // 2))) as pool:
            jobs = [(m, f, pool.submit(inheritable_thread_target(spark)(_fold_counts), m, f, *split(f), len(features), components)) for m in models for f in folds]
            done = [(m, f, *j.result()) for m, f, j in jobs]
    finally:
        scratch.drop(saved)
    counts = spark.createDataFrame([(m, f, *c) for m, f, _, told in done for c in told], "model STRING, fold INT, t STRING, p STRING, n BIGINT")
    of = {(r["model"], r["fold"]): r for r in _metrics(counts, ["model", "fold"]).collect()}
    figures = ("n", "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")
    none = (0, None, None, None, None)
    rows = [(m, f, "failed" if error else "ok", error, *([of[m, f][x] for x in figures] if (m, f) in of else none)) for m, f, error, _ in done]
    return spark.createDataFrame(rows, _ROW)


def fold_summary(folds: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population sd of the metrics over the folds that worked."""
    ms = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")
    return folds.where("status = 'ok'").groupBy(*by).agg(F.count("*").alias("n_folds"), *[x for m in ms for x in (F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}"))])


def best_per(summary: DataFrame, by: list[str], metric: str, name: str) -> DataFrame:
    """The row with the greatest metric per ``by``, the first name on ties."""
    return summary.groupBy(*by).agg(F.min_by(F.struct(F.col(name), F.col(metric)), F.struct(-F.col(metric), F.col(name))).alias("b")).select(*by, f"b.{name}", f"b.{metric}")
