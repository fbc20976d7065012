"""Gene programs as bridge tables (program, gene), their availability and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.functions.numbers import safe_div
from matrixloom.functions.text import normalize_name, slug
from matrixloom.operators.packed import packed_items


def program_bridge(df: DataFrame, program: str, genes: str) -> DataFrame:
    """(program, gene): union over the rows of a program of the genes packed in ``genes``, each once."""
    items = F.explode(packed_items(F.col(genes))).alias("gene")
    rows = df.where(F.col(program).isNotNull()).select(F.col(program).alias("program"), items)
    return rows.select("program", normalize_name(F.col("gene")).alias("gene")).distinct()


def availability(bridge: DataFrame, cells: DataFrame) -> DataFrame:
    """(program, n_genes, n_available, fraction, available, missing): lists sorted and joined by ", "."""
    have = cells.select("gene").distinct().withColumn("here", F.lit(True))
    j = bridge.join(have, "gene", "left")
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("gene")))), ", ")
    return j.groupBy("program").agg(
        F.count("*").alias("n_genes"), F.count("here").alias("n_available"), (F.count("here") / F.count("*")).alias("fraction"),
        listed(F.col("here")).alias("available"), listed(F.col("here").isNull()).alias("missing"),
    )


def numbered_genes(bridge: DataFrame) -> DataFrame:
    """(program, rank, gene): the genes of each program in alphabetical order."""
    s = bridge.groupBy("program").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    return s.select("program", F.posexplode("genes").alias("at", "gene")).select("program", (F.col("at") + 1).alias("rank"), "gene")


def feature_sets(annotation: DataFrame, levels: dict[str, str], universe_name: str = "all", min_genes: int = 1) -> DataFrame:
    """(feature_set, gene): everything, and one set ``level__slug`` for each value of each annotation level."""
    genes = annotation.where("gene IS NOT NULL")
    out = genes.select(F.lit(universe_name).alias("feature_set"), "gene")
    for name, column in levels.items():
        out = out.unionByName(genes.where(F.col(column).isNotNull()).select(F.concat(F.lit(name + "__"), slug(F.col(column))).alias("feature_set"), "gene"))
    out = out.distinct()
    big = out.groupBy("feature_set").agg(F.count("*").alias("n")).where(F.col("n") >= min_genes)
    return out.join(big.select("feature_set"), "feature_set", "left_semi")


def overlaps(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(a, b, n, na, nb, jaccard, overlap) of all pairs of sets that share a gene.

    ``left`` and ``right`` are (name, gene); without ``right`` the pairs of ``left`` with a < b. Sets meet
    through their common genes, so pairs without any are never made.
    """
    x = left.select(F.col("name").alias("a"), "gene").distinct()
    y = (left if right is None else right).select(F.col("name").alias("b"), "gene").distinct()
    na, nb = x.groupBy("a").agg(F.count("*").alias("na")), y.groupBy("b").agg(F.count("*").alias("nb"))
    common = x.join(y, "gene")
    common = common.where("a < b") if right is None else common
    n = common.groupBy("a", "b").agg(F.count("*").alias("n")).join(na, "a").join(nb, "b")
    return n.select(
        "a", "b", "n", "na", "nb", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"), safe_div(F.col("n"), F.least("na", "nb")).alias("overlap")
    )


def best_match(pairs: DataFrame, min_common: int = 4, min_overlap: float = 0.13, unassigned: str = "Unassigned/weak match") -> DataFrame:
    """The best ``b`` of each ``a`` by overlap, jaccard, number in common and name, and whether it counts as recovered."""
    order = Window.partitionBy("a").orderBy(F.desc("overlap"), F.desc("jaccard"), F.desc("n"), "b")
    best = pairs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    good = (F.col("n") >= min_common) & (F.col("overlap") >= min_overlap)
    return best.withColumn("is_match", good).withColumn("assigned", F.when(good, F.col("b")).otherwise(unassigned))


def presence(df: DataFrame, row: str, column: str, values: list[str], condition: str | None = None) -> DataFrame:
    """Counts of rows by ``row`` x ``column``, all named values as columns, 0 where there are none."""
    d = df.where(condition) if condition else df
    return d.groupBy(row).pivot(column, values).count().na.fill(0, values)


def program_rollup(modules: DataFrame, genes_per_module: int = 5, max_genes: int = 25) -> DataFrame:
    """Per program: modules, feature sets, confident modules, and the leading genes of its modules in order.

    ``modules``: program, module_id, feature_set, confidence_score, items (ordered genes).
    """
    own = modules.select("program", "module_id", "feature_set", "confidence_score", F.slice("items", 1, genes_per_module).alias("lead"))
    g = own.groupBy("program").agg(
        F.count("*").alias("n_modules"), F.count_distinct("feature_set").alias("n_feature_sets"), F.count_if(F.col("confidence_score") >= 4).alias("n_confident"),
        F.max("confidence_score").alias("best_confidence"),
    )
    placed = own.select("program", "module_id", F.posexplode("lead").alias("at", "gene")).groupBy("program", "gene").agg(F.min(F.struct("module_id", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("program").orderBy("first", "gene"))
    top = placed.withColumn("rn", rank).where(F.col("rn") <= max_genes).groupBy("program").agg(F.sort_array(F.collect_list(F.struct("rn", "gene"))).alias("s"))
    return g.join(top.select("program", F.array_join(F.transform("s", lambda x: x["gene"]), ", ").alias("lead_genes")), "program", "left")
