"""Annotation tables, lookups, source filters and the summaries that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.functions.numbers import rounded
from matrixloom.functions.text import normalize_symbol, stripped
from matrixloom.operators import order
from matrixloom.operators.summarize import top_k
from matrixloom.schema import require_columns

# Layers of a count matrix in the order in which they are preferred.
LAYERS = ("decontXcounts", "raw_counts")
# What supports a source well enough: donors, pseudobulks, cells.
ROBUST = {"n_donors": 2, "n_pseudobulk": 2, "n_cells_total": 100}
# Gene sets that are scored beside the programs.
REFERENCE_SETS = {
    "basement_membrane": [
        "COL4A1", "COL4A2", "COL4A3", "COL4A4", "COL4A5", "COL4A6", "LAMA1", "LAMA2", "LAMA3", "LAMA4", "LAMA5", "LAMB1", "LAMB2", "LAMB3", "LAMB4",
        "LAMC1", "LAMC2", "LAMC3", "NID1", "NID2", "HSPG2", "AGRN", "COL18A1", "COL7A1", "COL17A1",
    ],
    "interstitial_ecm": [
        "COL1A1", "COL1A2", "COL3A1", "COL5A1", "COL5A2", "COL6A1", "COL6A2", "COL6A3", "COL12A1", "COL14A1", "COL15A1", "DCN", "LUM", "BGN", "FMOD",
        "FBLN1", "FBLN2", "FBN1", "ELN", "FN1", "TNC", "THBS1", "THBS2", "SPARC",
    ],
    "perivascular_ecm": [
        "COL4A1", "COL4A2", "COL18A1", "HSPG2", "NID1", "NID2", "LAMA4", "LAMA5", "LAMB1", "LAMB2", "AGRN", "VWF", "EMCN", "MCAM", "PDGFRB", "RGS5",
        "ACTA2", "TAGLN", "CSPG4",
    ],
}
#: Columns that a pivoted table may have.
MAX_COLUMNS = 2000


# annotation and metadata ------------------------------------------------------------------------------------
def annotation(df: DataFrame, division: str, category: str, symbol: str) -> DataFrame:
    """(division, category, gene): each cleaned symbol once, with the first division and category; rows without a symbol drop."""
    require_columns(df, [division, category, symbol], "annotation")
    rows = df.select(F.col(division).alias("division"), F.col(category).alias("category"), normalize_symbol(F.col(symbol)).alias("gene")).where("gene IS NOT NULL")
    return rows.groupBy("gene").agg(F.min(F.struct("division", "category")).alias("a")).select("a.division", "a.category", "gene")


def latest_per(df: DataFrame, key: str, columns: list[str], latest: str) -> DataFrame:
    """Each key once, with the columns of its latest row; of equally late ones the greatest. Rows without a key drop."""
    require_columns(df, [key, *columns, latest])
    best = F.max(F.struct(latest, *columns)).alias("b")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"b.{c}") for c in columns])


def joined_metadata(samples: DataFrame, sample_metadata: DataFrame, subject_metadata: DataFrame, subject_of: Column) -> DataFrame:
    """Samples with their own and their subject's metadata, both left joins; a missing subject is read from the sample id."""
    s = samples.join(sample_metadata, "sample_id", "left").withColumn("subject_id", F.coalesce("subject_id", subject_of))
    return s.join(subject_metadata, "subject_id", "left")


def choose_layer(available: list[str], preferred: str | None = None) -> str | None:
    """The layer asked for, or ValueError; else the first of LAYERS that there is; None stands for the plain matrix."""
    if preferred is not None:
        if preferred not in available:
            raise ValueError(f"no layer {preferred!r}; there are {available}")
        return preferred
    return next((x for x in LAYERS if x in available), None)


def selected_cells(cells: DataFrame, genes: DataFrame, samples: DataFrame) -> DataFrame:
    """Cells of the genes and samples asked for, each repeated symbol's mean, as log2(x + 1); both lists are semi-joins."""
    kept = cells.join(genes.select("gene").distinct(), "gene", "left_semi").join(samples.select("sample_id").distinct(), "sample_id", "left_semi")
    return kept.groupBy("sample_id", "gene").agg(F.log2(F.avg("value") + 1.0).alias("value"))


def looked_up(df: DataFrame, labels: DataFrame, keys: list[str], label: str, default: str) -> DataFrame:
    """``df`` with the label of its keys from a table of (keys, label), ``default`` where there is none; labels are unique by key."""
    one = labels.groupBy(*keys).agg(F.min(label).alias("__label"))
    return df.join(one, keys, "left").withColumn(label, F.coalesce("__label", F.lit(default))).drop("__label")


def composite_id(*parts: Column) -> Column:
    """The parts that there are, joined by `` | ``."""
    return F.concat_ws(" | ", *[stripped(p.cast("string")) for p in parts])


def observed_cells(obs: DataFrame, required: list[str], method: str | None = None) -> DataFrame:
    """Cells with the required columns as strings; only those of one ``method`` if named."""
    require_columns(obs, required, "cells")
    out = obs.select(*[F.col(c).cast("string").alias(c) if c in required else F.col(c) for c in obs.columns])
    return out if method is None else out.where(F.col("method") == method)


# sources ----------------------------------------------------------------------------------------------------
def group_counts(scores: DataFrame, groups: list[str], program: str = "program", score: str = "score") -> DataFrame:
    """Per group and program: n_pseudobulk, n_donors, n_cells_total of the whole group, and mean, median, sd and quartiles of the scores."""
    one = scores.groupBy(*groups, "pseudobulk_id").agg(F.first("donor").alias("donor"), F.first("n_cells").alias("n_cells"))
    counts = one.groupBy(*groups).agg(F.count("*").alias("n_pseudobulk"), F.count_distinct("donor").alias("n_donors"), F.sum("n_cells").alias("n_cells_total"))
    known = scores.where(F.col(score).isNotNull())
    stats = known.groupBy(*groups, program).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))
    j = stats.join(counts, groups).join(order.quantiles(known, [*groups, program], score, [0.25, 0.5, 0.75]), [*groups, program])
    return j.select(*groups, program, "n_pseudobulk", "n_donors", "n_cells_total", "mean_score", F.col("q1").alias("median_score"), "std_score", F.col("q0").alias("q25_score"), F.col("q2").alias("q75_score"))


def supported(summary: DataFrame, least: dict[str, int] = ROBUST) -> DataFrame:
    """Rows of a summary with enough support in every count named."""
    for c, n in least.items():
        summary = summary.where(F.col(c) >= n)
    return summary


def source_report(consensus: DataFrame, first: int = 5, overall: int = 8) -> DataFrame:
    """Per program: items, items on which methods agree, the first of these, and the first overall with their best score."""
    place = F.row_number().over(Window.partitionBy("program").orderBy(F.desc("consensus"), "best_rank", F.desc(F.round("max_score", 9)), "item"))
    told = F.concat(F.col("item"), F.format_string(" (%.2f)", rounded(F.col("max_score"), 2)))
    listed = lambda c, of: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("place", of.alias("t"))))), lambda x: x["t"]), "; ")
    return consensus.withColumn("place", place).groupBy("program").agg(
        F.count("*").alias("n_items"), F.count_if("consensus").alias("n_consensus"), listed(F.col("consensus") & (F.col("place") <= first), F.col("item")).alias("consensus_items"),
        listed(F.col("place") <= overall, told).alias("top_items"),
    )


# modules and programs ---------------------------------------------------------------------------------------
def reproducibility(best: DataFrame) -> DataFrame:
    """Per program the modules that match it: their number, data sets, feature sets and mean fit.

    ``best``: the columns of :func:`genesets.best_match` with dataset and feature_set.
    """
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    return best.where("is_match").groupBy(F.col("assigned").alias("program")).agg(
        F.count("*").alias("n_modules"), F.count_distinct("dataset").alias("n_datasets"), joined("dataset").alias("datasets"), F.count_distinct("feature_set").alias("n_feature_sets"),
        joined("feature_set").alias("feature_sets"), F.avg("overlap").alias("mean_overlap"), F.avg("jaccard").alias("mean_jaccard"), F.avg("n").alias("mean_common"),
    )


def cluster_summary(modules: DataFrame, cluster: str, genes: str, tissues: str, n_genes: int = 30, n_tissues: int = 15) -> DataFrame:
    """Per cluster: modules, feature sets, different genes, and the most frequent genes and tissues, ties by name."""

    def most(column: str, n: int, sep: str, out: str) -> DataFrame:
        f = modules.select(cluster, F.explode(column).alias("item")).groupBy(cluster, "item").agg(F.count("*").alias("c"))
        top = top_k(f, [cluster], [F.desc("c"), F.col("item")], n)
        return top.groupBy(cluster).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), sep).alias(out))

    base = modules.groupBy(cluster).agg(F.count("*").alias("n_modules"), F.count_distinct("feature_set").alias("n_feature_sets"), F.array_join(F.array_sort(F.collect_set("feature_set")), "; ").alias("feature_sets"))
    different = modules.select(cluster, F.explode(genes).alias("g")).groupBy(cluster).agg(F.count_distinct("g").alias("n_genes"))
    return base.join(different, cluster, "left").join(most(genes, n_genes, ", ", "top_genes"), cluster, "left").join(most(tissues, n_tissues, "; ", "top_tissues"), cluster, "left")


def program_sets_with_tissues(modules: DataFrame, program: str, genes: str, tissues: str, most_genes: int | None = None) -> DataFrame:
    """(program, n_modules, n_genes, genes, n_tissues, tissues): unions over a program's modules, at most the first ``most_genes`` of each."""
    of = F.col(genes) if most_genes is None else F.slice(genes, 1, most_genes)
    m = modules.where(F.col(program).isNotNull())
    n = m.groupBy(program).agg(F.count("*").alias("n_modules"))
    union = lambda c, name: m.select(program, F.explode(c).alias("x")).groupBy(program).agg(F.array_sort(F.collect_set("x")).alias(name))
    j = n.join(union(of, "g"), program, "left").join(union(F.col(tissues), "t"), program, "left")
    none = F.array().cast("array<string>")
    g, t = F.coalesce("g", none), F.coalesce("t", none)
    return j.select(F.col(program).alias("program"), "n_modules", F.size(g).alias("n_genes"), F.array_join(g, ", ").alias("genes"), F.size(t).alias("n_tissues"), F.array_join(t, "; ").alias("tissues"))


def top_tissue_overlap(scores: DataFrame, sets: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """Per group and program: the top tissues by score, and those of them that are also the program's own.

    ``scores``: (by, program, tissue, score); ``sets``: (program, tissue).
    """
    top = top_k(scores, [*by, "program"], [F.desc(F.round("score", 9)), F.col("tissue")], k)
    own = sets.select("program", "tissue").distinct().withColumn("own", F.lit(True))
    in_order = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("rank", "tissue")))), lambda x: x["tissue"]), "; ")
    return top.join(own, ["program", "tissue"], "left").groupBy(*by, "program").agg(
        in_order(F.lit(True)).alias("top_tissues"), F.count("own").alias("n_common"), in_order(F.col("own")).alias("common_tissues"), F.avg("score").alias("mean_top"), F.max("score").alias("max_top")
    )


# tables -----------------------------------------------------------------------------------------------------
def pivoted(df: DataFrame, row: str | list[str], column: str, value: str, columns: list[str] | None = None, fill: float | None = None) -> DataFrame:
    """One row per ``row`` and one column per value of ``column``, means of ``value``; absent cells ``fill`` or null.

    The columns are looked up if they aren't named; more than MAX_COLUMNS raise ValueError.
    """
    if columns is None:
        columns = sorted(r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(MAX_COLUMNS + 1).collect())
        if len(columns) > MAX_COLUMNS:
            raise ValueError(f"{column} has more than {MAX_COLUMNS} values")
    out = df.withColumn(column, F.col(column).cast("string")).groupBy(row).pivot(column, columns).agg(F.avg(value))
    return out if fill is None else out.na.fill(fill, columns)


def starred(value: Column, p: Column, digits: int = 2, level: float = 0.05) -> Column:
    """A figure as text, with a star where its p-value is below ``level``."""
    return F.concat(F.format_string(f"%.{digits}f", rounded(value, digits)), F.when(p < level, "*").otherwise(""))
