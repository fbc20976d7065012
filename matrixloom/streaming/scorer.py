"""Program scores of samples as they arrive: a stream joined to static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.functions.numbers import number
from matrixloom.operators.scoring import row_scorer


def score_stream(stream: DataFrame, key: str, genes: list[str], bridge: DataFrame, moments: DataFrame) -> DataFrame:
    """(sample_id, program, n_genes, mean, zscore_mean) of every arriving wide row; missing values are 0.

    Gene moments and programs are static; a sample is complete in its row, so its scores need no state.
    """
    run, schema = row_scorer([g.upper() for g in genes], bridge, moments, ("mean", "zscore_mean"))
    values = F.array(*[F.coalesce(number(F.col(f"`{g}`")), F.lit(0.0)) for g in genes]).alias("values")
    return stream.select(F.col(key).cast("string").alias("sample_id"), values).mapInArrow(run, schema)


def run_once(stream: DataFrame, folder: str) -> None:
    """Write all that has arrived to Parquet below ``folder`` and stop; a later call goes on where this one ended."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()


def event_windows(stream: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts, sums and means per time window and key; events later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("window_start"), key, "n", "total"
    )


def open_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (file or folder) as a stream with the table's schema."""
    as_pattern = f"{path[:-1]}[{path[-1]}]"  # a stream's path must be a folder or a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(as_pattern)
