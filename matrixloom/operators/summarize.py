"""Group summaries, top lists, consensus and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.functions.numbers import safe_div
from matrixloom.operators import order


def group_summary(scores: DataFrame, groups: list[str], program: str = "program", score: str = "score", sample: str = "sample_id", subject: str = "subject_id") -> DataFrame:
    """Per group and program: n_samples, n_subjects (distinct, of the whole group), mean, median, population sd, quartiles.

    Null groups are groups; programs without any score in a group are skipped. The distinct counts are taken
    once per group, not once per program.
    """
    counts = scores.groupBy(*groups).agg(F.count_distinct(sample).alias("n_samples"), F.count_distinct(subject).alias("n_subjects"))
    known = scores.where(F.col(score).isNotNull())
    stats = known.groupBy(*groups, program).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))
    q = order.quantiles(known, [*groups, program], score, [0.25, 0.5, 0.75])

    def same(a: str, b: str, columns: list[str]) -> Column:
        out = F.lit(True)
        for g in columns:
            out = out & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
        return out

    j = stats.alias("s").join(counts.alias("c"), same("s", "c", groups)).join(q.alias("q"), same("s", "q", [*groups, program]))
    return j.select(
        *[F.col(f"s.{g}").alias(g) for g in groups], F.col(f"s.{program}").alias(program), "n_samples", "n_subjects", "mean_score", F.col("q1").alias("median_score"),
        "std_score", F.col("q0").alias("q25_score"), F.col("q2").alias("q75_score"),
    )


def variability(scores: DataFrame, groups: list[str], score: str = "score") -> DataFrame:
    """Mean, sd and |sd / mean| per group; null where the mean is 0."""
    g = scores.where(F.col(score).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))
    return g.withColumn("variability", F.abs(safe_div(F.col("std_score"), F.nullif("mean_score", F.lit(0.0)))))


def top_k(df: DataFrame, by: list[str], ordering: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*ordering))).where(F.col(rank) <= k)


def top_two_sided(df: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The ``k`` greatest and ``k`` smallest rows of each group, with their side."""
    high = top_k(df, by, [F.desc(value), F.col(tie)], k).withColumn("side", F.lit("positive"))
    return high.unionByName(top_k(df, by, [F.asc(value), F.col(tie)], k).withColumn("side", F.lit("negative")))


def large_classes(df: DataFrame, label: str, at_least: int) -> DataFrame:
    """Rows whose label has at least ``at_least`` rows; null labels drop. Counts are joined back, so no class is gathered."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= at_least)
    return df.join(n.select(label), label, "left_semi")


def with_totals(df: DataFrame, group: str, label: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates per value of ``group`` and over all rows, the latter under ``label``; a null group keeps its null."""
    g = df.rollup(group).agg(F.grouping(group).alias("__all"), *aggregates)
    return g.withColumn(group, F.when(F.col("__all") == 1, label).otherwise(F.col(group))).drop("__all")


def four_way_matrix(rows: DataFrame, row: str = "tissue", gene: str = "gene", value: str = "value", sample: str = "sample_id", condition: str = "condition", total: str = "all_samples") -> DataFrame:
    """(condition, row, gene, mean, max, n_samples, present) per condition and over all of them, in one aggregation."""
    g = rows.groupingSets([[row, gene, condition], [row, gene]], row, gene, condition).agg(
        F.grouping(condition).alias("__all"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.count_distinct(sample).alias("n_samples")
    )
    g = g.withColumn(condition, F.when(F.col("__all") == 1, total).otherwise(F.col(condition))).drop("__all")
    return g.withColumn("present", (F.col("n_samples") > 0).cast("int"))


def consensus(ranked: DataFrame, program: str = "program", item: str = "item", method: str = "method", max_rank: int = 10, min_methods: int = 2) -> DataFrame:
    """Per program and item of the methods' top lists: methods, best rank, mean and best score, and whether enough methods agree."""
    g = ranked.where(F.col("rank") <= max_rank).groupBy(program, item).agg(
        F.count_distinct(method).alias("n_methods"), F.array_join(F.array_sort(F.collect_set(method)), ", ").alias("methods"), F.min("rank").alias("best_rank"),
        F.avg("score").alias("mean_score"), F.max("score").alias("max_score"),
    )
    return g.withColumn("consensus", F.col("n_methods") >= min_methods)


def term_frequency(df: DataFrame, cluster: str, items: str, top: int) -> DataFrame:
    """(cluster, item, n, rank): the most common items of the list column per cluster, ties by name."""
    n = df.select(cluster, F.explode(items).alias("item")).groupBy(cluster, "item").agg(F.count("*").alias("n"))
    return top_k(n, [cluster], [F.desc("n"), F.col("item")], top)


def stratified_sample(df: DataFrame, stratum: str, key: str, at_most: int, seed: int = 42) -> DataFrame:
    """At most ``at_most`` rows per stratum, in the order of a seeded digest of the key: the same rows in every run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return top_k(df, [stratum], [digest, F.col(key)], at_most, "pick")


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, n) of equal-width bins between the extremes; the greatest value belongs to the last bin."""
    e = df.where(F.col(value).isNotNull()).agg(F.min(value).alias("lo0"), F.max(value).alias("hi0"))
    width = (F.col("hi0") - F.col("lo0")) / bins
    at = F.when(F.col("hi0") > F.col("lo0"), F.least(F.floor((F.col(value) - F.col("lo0")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    g = df.where(F.col(value).isNotNull()).join(F.broadcast(e)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.first("lo0").alias("lo0"), F.first("hi0").alias("hi0"))
    return g.select("bin", (F.col("lo0") + F.col("bin") * width).alias("lo"), (F.col("lo0") + (F.col("bin") + 1) * width).alias("hi"), "n")


def robust_range(df: DataFrame, value: str) -> DataFrame:
    """(lo, hi): 2nd and 98th percentile; the extremes where they are equal, widened by 1 where those are; -1, 1 without values."""
    known = df.where(F.col(value).isNotNull())
    p = known.agg(F.min(value).alias("a"), F.max(value).alias("z")).join(order.quantiles(known, [], value, [0.02, 0.98]), F.lit(True), "left")  # one row beside one or none
    same, flat = F.col("q0") == F.col("q1"), F.col("a") == F.col("z")
    lo = F.when(F.col("a").isNull(), -1.0).when(~same, F.col("q0")).when(~flat, F.col("a")).otherwise(F.col("a") - 1.0)
    hi = F.when(F.col("a").isNull(), 1.0).when(~same, F.col("q1")).when(~flat, F.col("z")).otherwise(F.col("z") + 1.0)
    return p.select(lo.alias("lo"), hi.alias("hi"))
