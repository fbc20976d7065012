"""Queries that compare gene sets, ranks of factorisations and representations with random ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from matrixloom.functions import text
from matrixloom.functions.numbers import rounded
from matrixloom.operators import atlas, benchmark, classify, consolidate, decompose, factorgrid, matrix, packed, representation, stats, summarize
from matrixloom.plans import core
from matrixloom.plans.core import bridge, cells, metadata, proteins, query, scored, show
from matrixloom.plans.tables import EXPRESSION, PROGRAMS, table
from matrixloom.schema import PROGRAM_ORDER, slug_text
from matrixloom.session import Scratch


# gene sets against random ones ------------------------------------------------------------------------------
def core_sets(spark, folder):
    """(feature_set, gene): the genes that at least a fifth of the data sets with a list for a program have on it."""
    p = table(spark, folder, PROGRAMS).where("ecm_program IS NOT NULL AND dataset IS NOT NULL")
    lists = p.select("dataset", F.col("ecm_program").alias("feature_set"), F.explode(packed.packed_items(F.col("program_genes"))).alias("g"))
    return benchmark.core_genes(lists.select("dataset", "feature_set", text.normalize_name(F.col("g")).alias("gene")), 0.2)


def _proteome(spark, folder, conditions: bool):
    """(dataset, sample_id, gene, value): tissues by genes, over all samples and, if asked, per condition."""
    p = proteins(spark, folder)
    every = p.withColumn("condition", F.lit("all_samples"))
    rows = every.unionByName(p) if conditions else every
    return rows.groupBy(F.col("condition").alias("dataset"), F.col("tissue").alias("sample_id"), "gene").agg(F.avg("value").alias("value"))


def _labels(values):
    samples = values.select("dataset", "sample_id").distinct()
    return text.map_label(samples, "sample_id", text.TISSUE_SYSTEM, "label", "unknown")


def _benchmark(spark, folder, name, conditions, sets, outside, repeats):
    scratch = Scratch(spark, name)
    values = scratch.save(_proteome(spark, folder, conditions))
    s = scratch.save(sets)
    return scratch.save(benchmark.benchmark(values, _labels(values), s, repeats, outside=outside(s)))


def _told(c):
    return show(c, observed=5, random_mean=5, random_std=5, z=3)


@query()
def specificity_control(spark, folder):
    """All program genes as one set against 300 random sets of other genes, with the figures of all genes beside them."""
    scratch = Scratch(spark, "specificity")
    values = scratch.save(_proteome(spark, folder, False))
    own = scratch.save(core_sets(spark, folder).select(F.lit("programs").alias("feature_set"), "gene").distinct())
    every = values.select(F.lit("all_genes").alias("feature_set"), "gene").distinct()
    got = scratch.save(benchmark.benchmark(values, _labels(values), own.unionByName(every), 300, outside=own))
    whole = got.where("repeat = -1 AND feature_set = 'all_genes'").select("dataset", "metric", F.col("value").alias("all_genes_value"))
    return show(benchmark.compared(got).join(whole, ["dataset", "metric"]), observed=5, random_mean=5, random_std=5, z=3, all_genes_value=5)


@query()
def category_benchmark(spark, folder):
    """Each program's core genes against 1,000 random sets of their size from genes of no program."""
    return _told(benchmark.compared(_benchmark(spark, folder, "category", False, core_sets(spark, folder), lambda s: s, 1000)))


@query()
def cross_dataset_benchmark(spark, folder):
    """The same in every condition's own matrix, 300 repeats, adjusted over all rows."""
    return _told(benchmark.compared(_cross(spark, folder)))


def _cross(spark, folder):
    return _benchmark(spark, folder, "cross", True, core_sets(spark, folder), lambda s: s, 300)


@query()
def category_table(spark, folder):
    """z-scores with a star below p = 0.05, feature sets by metric."""
    c = benchmark.compared(_benchmark(spark, folder, "category", False, core_sets(spark, folder), lambda s: s, 1000))
    c = c.withColumn("figure", atlas.starred(F.col("z"), F.col("p")))
    return c.groupBy("feature_set").pivot("metric", list(benchmark.METRICS)).agg(F.first("figure"))


@query()
def cross_dataset_table(spark, folder):
    """Mean z of the key metrics, feature set and metric by data set."""
    c = benchmark.compared(_cross(spark, folder)).where(F.col("metric").isin(*benchmark.KEY_METRICS))
    t = atlas.pivoted(c, ["feature_set", "metric"], "dataset", "z", ["all_samples", "disease_like", "normal_like", "uncertain"])
    return t.select("feature_set", "metric", *[rounded(F.col(x), 3).alias(x) for x in t.columns[2:]])


# factorisations ---------------------------------------------------------------------------------------------
#: Ranks and seeds of the grid, genes that stand for a component, and genes of a set at least.
RANKS, SEEDS, TOP, LEAST = list(range(2, 11)), 30, 8, 20


def _tissue_values(spark, folder):
    """(feature_set, sample_id, gene, value): detailed tissues by the genes of each program that has at least LEAST there, and by all genes."""
    m = metadata(spark, folder).where("tissue_detail IS NOT NULL").select("sample_id", "tissue_detail")
    mean = cells(spark, folder).join(m, "sample_id").groupBy(F.col("tissue_detail").alias("sample_id"), "gene").agg(F.avg("value").alias("value"))
    genes = mean.select("gene").distinct()
    b = bridge(spark, folder).join(genes, "gene", "left_semi").select(F.col("program").alias("feature_set"), "gene")
    sets = b.unionByName(genes.select(F.lit("all").alias("feature_set"), "gene"))
    big = sets.groupBy("feature_set").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("feature_set")
    return mean.join(sets.join(big, "feature_set", "left_semi"), "gene").select("feature_set", "sample_id", "gene", "value")


def _grid(spark, folder):
    return Scratch(spark, "grid").save(factorgrid.grid(_tissue_values(spark, folder), RANKS, SEEDS, TOP))


@query()
def nmf_stability(spark, folder):
    """Error, sparsity, stability, cophenetic correlation and recovered programs of every feature set and rank."""
    return show(factorgrid.grid_metrics(_grid(spark, folder), bridge(spark, folder)), **dict.fromkeys(("mean_error", "std_error", "mean_sparsity", "mean_stability", "std_stability", "cophenetic"), 4))


@query()
def nmf_rank_recommendation(spark, folder):
    """The rank of each feature set with the best weighted figures of its factorisations."""
    m = factorgrid.grid_metrics(_grid(spark, folder), bridge(spark, folder))
    return show(stats.rank_recommendation(m, "feature_set", "k", "mean_error", "mean_stability", "cophenetic", "mean_recovery"), score=4)


@query()
def nmf_recovery_table(spark, folder):
    """Share of runs that recover each program, feature set and program by rank."""
    r = factorgrid.recovery(_grid(spark, folder), bridge(spark, folder)).withColumn("hit", F.col("recovered").cast("double")).withColumn("rank", F.concat(F.lit("k"), "k"))
    return show(atlas.pivoted(r, ["feature_set", "program"], "rank", "hit", [f"k{k}" for k in RANKS]))


@query()
def nmf_components(spark, folder):
    """Top genes and samples of every component of the first seed."""
    c = _grid(spark, folder).where("seed = 1").select("feature_set", "k", F.posexplode(F.arrays_zip("genes", "samples")).alias("at", "c"))
    return c.select("feature_set", "k", (F.col("at") + 1).alias("component"), F.array_join(F.slice("c.genes", 1, 10), ", ").alias("genes"), F.array_join("c.samples", "; ").alias("samples"))


@query()
def cluster_program_table(spark, folder):
    """Scores of the module clusters of each data set against the programs, one column per program."""
    m, scratch = core._grouped(spark, folder), Scratch(spark, "clusters")
    c = scratch.save(consolidate.clustered_modules(m, "dataset"))
    s = consolidate.cluster_program_scores(c, m, bridge(spark, folder), "dataset").withColumn("program", text.slug(F.col("program")))
    return show(atlas.pivoted(s, ["dataset", "cluster"], "program", "score", [slug_text(p) for p in PROGRAM_ORDER], 0.0), **{slug_text(p): 4 for p in PROGRAM_ORDER})


@query()
def score_axes(spark, folder):
    """Two principal axes (absolute values) of the program scores of at most 150 samples a tissue."""
    some = summarize.stratified_sample(metadata(spark, folder).where("tissue IS NOT NULL"), "tissue", "sample_id", 150).select("sample_id", "tissue")
    s = scored(spark, folder).drop("tissue").join(some, "sample_id").withColumn("value", F.coalesce("score", F.lit(0.0))).withColumn("gene", F.col("program"))
    z = matrix.zscores_by_moments(s.select("sample_id", "gene", "value"))
    coords = decompose.pca(decompose.feature_rows(z, list(PROGRAM_ORDER), "z"), 2)[1]
    return coords.join(some, "sample_id").select("sample_id", "tissue", *[rounded(F.abs(F.col("coords")[i]), 4).alias(f"axis{i + 1}") for i in range(2)])


# representations --------------------------------------------------------------------------------------------
REPEATS = 3


def _representations(spark, folder, models=("logistic",)):
    scratch = Scratch(spark, "representations")
    c = scratch.save(cells(spark, folder))
    genes = sorted(x.upper() for x in table(spark, folder, EXPRESSION).columns if x != "sample_id")
    m = text.map_label(metadata(spark, folder).where("tissue IS NOT NULL"), "tissue", text.TISSUE_SYSTEM, "label", "Other")
    m = summarize.large_classes(m, "label", 10).join(c.select("sample_id").distinct(), "sample_id", "left_semi")
    samples = scratch.save(classify.grouped_folds(m.select("sample_id", "subject_id", "label"), "subject_id", 5))
    sets = scratch.save(core_sets(spark, folder).join(c.select("gene").distinct(), "gene", "left_semi").select(F.col("feature_set").alias("program"), "gene"))
    universe = sets.select("gene").distinct()
    outside = c.select("gene").distinct().join(universe, "gene", "left_anti")
    return scratch.save(representation.compare(representation.jobs_for(sets, universe, outside, REPEATS), c, samples, genes, list(models)))


def _summaries(rows):
    return classify.fold_summary(rows, ["representation", "family", "model"])


@query()
def representation_families(spark, folder):
    """Curated sets, axes and random sets by family: how a classifier does on them."""
    f = representation.family_summary(_summaries(_representations(spark, folder)))
    return show(f, **{x: 3 for x, t in f.dtypes if t == "double"})


@query()
def representation_table(spark, folder):
    """Representations by metric, the best per model marked, with their failed runs."""
    rows = _representations(spark, folder)
    s = _summaries(rows)
    best = classify.best_per(s, ["model"], "mean_balanced_accuracy", "representation").select("model", F.col("representation").alias("best"))
    failed = rows.where("status = 'failed'").groupBy("representation", "model").agg(F.count("*").alias("n_failed"))
    every = rows.select("representation", "family", "model").distinct().join(s, ["representation", "family", "model"], "left").join(best, "model", "left").join(failed, ["representation", "model"], "left")
    t = every.select("representation", "model", (F.col("representation") == F.col("best")).alias("is_best"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), *[f"mean_{m}" for m in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])
    return show(t, **{x: 3 for x, ty in t.dtypes if ty == "double"})


@query()
def representation_failures(spark, folder):
    """Failed runs by model, family and error."""
    return representation.failed_runs(_representations(spark, folder, ("no_such_model",)))
