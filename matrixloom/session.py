"""Session defaults and the shared scratch folder in which long lineages are cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files are deleted when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "matrixloom") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session, in which every task runs on this machine, gets a folder of its own when
    the setting is absent.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir()
    if kept:
        return kept.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    spark.sparkContext.setCheckpointDir(at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    except Exception:  # noqa: BLE001
        pass  # the session has ended before


class Scratch:
    """Tables written to the shared folder: they cut the lineage and outlive a lost executor.

    Results read them, so they stay until the driver's Python ends and are deleted then, if the session still runs.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.at = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_delete_at_exit, spark, self.at)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the written table; the shuffle files of the step are deleted with its end."""
        self.n += 1
        path = f"{self.at}/{self.n}"
        schema = df.schema
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEAN_UP) if before is None else self.spark.conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table saved here that nothing reads any more; tables derived from one are not touched."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)
