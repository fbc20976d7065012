"""Ranks and exact quantiles of groups of any size: values are sorted by ranges, so no group lies in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.session import Scratch


def _placed(df: DataFrame, by: list[str], value: str, parts: int | None) -> DataFrame:
    """``df`` in ranges of (by, value), each row with its range (__p), its group (__g) and the rows of the group in the ranges before (__before)."""
    scratch = Scratch(df.sparkSession, "order")
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__g", F.struct(F.lit(0).alias("any"), *[F.col(b) for b in by]))
    rows = scratch.save(keyed.repartitionByRange(n, "__g", value).withColumn("__p", F.spark_partition_id()))
    counts = rows.groupBy("__p", "__g").agg(F.count("*").alias("__n"))  # at most ranges + groups rows
    earlier = F.sum("__n").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("__n").over(Window.partitionBy("__g"))
    told = counts.select("__p", "__g", F.coalesce(earlier, F.lit(0)).alias("__before"), total.alias("__total"))
    return rows.join(told, ["__p", "__g"])


def ranks(df: DataFrame, by: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with the rank of each row's value in its group from 1, ties at their mean rank. Null values must be left out before; null groups are groups.

    Equal values of a group are in one range, so ranges are ranked apart and moved up by the rows before them.
    """
    p = _placed(df, by, value, parts)
    ties = F.count("*").over(Window.partitionBy("__p", "__g", value))
    own = F.rank().over(Window.partitionBy("__p", "__g").orderBy(value))
    return p.withColumn(out, F.col("__before") + own + (ties - 1) / 2.0).drop("__p", "__g", "__before", "__total")


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], parts: int | None = None) -> DataFrame:
    """(by, n, q0, q1, ...): linearly interpolated quantiles of each group; null and NaN values don't count, groups without others have no row."""
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    p = _placed(rows, by, "__v", parts)
    at = F.col("__before") + F.row_number().over(Window.partitionBy("__p", "__g").orderBy("__v")) - 1
    h = [(F.col("__total") - 1) * F.lit(float(q)) for q in probabilities]
    low = [F.floor(x) for x in h]
    wanted = F.lit(False)
    for x in low:
        wanted = wanted | (F.col("__at") == x) | (F.col("__at") == x + 1)
    some = p.withColumn("__at", at).where(wanted)
    picked = [F.max(F.when(F.col("__at") == x, F.col("__v"))).alias(f"__l{i}") for i, x in enumerate(low)] + [F.max(F.when(F.col("__at") == x + 1, F.col("__v"))).alias(f"__h{i}") for i, x in enumerate(low)]
    g = some.groupBy("__g").agg(F.max("__total").alias("n"), *picked)
    total = lambda q: (F.col("n") - 1) * F.lit(float(q))
    values = [(F.col(f"__l{i}") + (F.coalesce(f"__h{i}", f"__l{i}") - F.col(f"__l{i}")) * (total(q) - F.floor(total(q)))).alias(f"q{i}") for i, q in enumerate(probabilities)]
    return g.select(*[F.col(f"__g.`{b}`").alias(b) for b in by], "n", *values)
