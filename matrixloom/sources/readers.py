"""Readers of the file kinds the pipelines take."""

from __future__ import annotations

import dataclasses
import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matrixloom.functions.numbers import number
from matrixloom.functions.text import normalize_symbol
from matrixloom.schema import require_columns

# Columns of a headerless spot position file.
POSITION_COLUMNS = "barcode STRING, in_tissue INT, array_row INT, array_col INT, pxl_row_in_fullres DOUBLE, pxl_col_in_fullres DOUBLE"
# Names under which a gene symbol column is looked for, in this order.
SYMBOL_COLUMNS = ("Gene Symbol", "gene_symbol", "Gene symbol", "Symbol", "symbol", "Gene", "gene", "Gene name", "Gene Name")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """A table by the suffix of its path: .csv, .tsv, .txt (tab), .parquet, .json, .orc; also with .gz.

    Another suffix raises ValueError. Column names are stripped of white space.
    """
    kind = path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("csv", "tsv", "txt"):
        df = reader.option("header", header).option("sep", "," if kind == "csv" else "\t").csv(path)
    elif kind in ("parquet", "json", "orc"):
        df = getattr(reader, kind)(path)
    else:
        raise ValueError(f"no reader for {path!r}: csv, tsv, txt, parquet, json and orc are known")
    return df.toDF(*[c.strip() for c in df.columns])


def read_zipped_tsv(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t", header: bool = True) -> DataFrame:
    """Rows of the tables inside zip archives, every archive read by one task, line by line.

    Values are strings in the columns of ``schema``; missing trailing fields are null.
    """
    names = schema.fieldNames()

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in z.namelist():
                        rows: list[list] = []
                        with io.TextIOWrapper(z.open(member), "utf-8", newline="") as lines:
                            for i, line in enumerate(lines):
                                if header and i == 0:
                                    continue
                                parts = line.rstrip("\r\n").split(sep)
                                rows.append((parts + [None] * len(names))[: len(names)])
                                if len(rows) == 20_000:
                                    yield _strings(rows, names)
                                    rows = []
                        if rows:
                            yield _strings(rows, names)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unzip, text)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def _strings(rows: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)


def read_positions(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """Spot positions with or without a header; ``in_tissue`` null is 0."""
    df = spark.read.schema(POSITION_COLUMNS).option("header", header).csv(path)
    return df.withColumn("in_tissue", F.coalesce("in_tissue", F.lit(0)))


def read_scale_factors(spark: SparkSession, path: str) -> DataFrame:
    """(name, factor) of a JSON object of numbers."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "MAP<STRING, DOUBLE>")).alias("name", "factor"))


def read_coo(spark: SparkSession, path: str, row: str, gene: str, value: str, feature_type: str | None = None) -> DataFrame:
    """(row, gene, value) of a sparse matrix in coordinate form; duplicates added up, zeros dropped, feature type filtered if named."""
    df = read_table(spark, path)
    require_columns(df, [row, gene, value], "sparse matrix")
    if feature_type is not None:
        df = df.where(F.col("feature_type") == feature_type)
    return df.groupBy(row, F.upper(gene).alias("gene")).agg(F.sum(number(F.col(value))).alias("value")).where("value <> 0")


def kept_rows(manifest: DataFrame, flag: str = "use_now", yes: tuple[str, ...] = ("yes", "true", "1")) -> DataFrame:
    """Rows of a manifest that are switched on; an error if none is."""
    df = manifest.where(F.lower(F.trim(F.col(flag).cast("string"))).isin(*yes))
    if df.isEmpty():
        raise ValueError(f"no row of the manifest has {flag} in {yes}")
    return df


def find_first(folder: str, patterns: list[str]) -> str:
    """The alphabetically first file of the first pattern that has any."""
    for p in patterns:
        if found := sorted(Path(folder).glob(p)):
            return str(found[0])
    raise FileNotFoundError(f"no file of {patterns} in {folder}")


def symbol_column(columns: list[str]) -> str:
    """The column that holds gene symbols: a known name, else one whose name speaks of gene and symbol."""
    for c in SYMBOL_COLUMNS:
        if c in columns:
            return c
    for c in columns:
        if "gene" in c.lower() and "symbol" in c.lower():
            return c
    raise ValueError(f"no gene symbol column among {columns}")


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n, n_null, n_distinct, lo, hi) of every column, in one pass; distinct counts are approximate."""
    parts = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        text = x.cast("string") if not t.startswith(("array", "map", "struct", "binary")) else F.to_json(x) if not t.startswith("binary") else F.hex(x)
        parts.append(F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("type"), F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_null"),
            F.approx_count_distinct(text).alias("n_distinct"), F.min(text).alias("lo"), F.max(text).alias("hi"),
        ))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


@dataclasses.dataclass(frozen=True)
class DatasetConfig:
    """Where a data set's matrix is: a wide table of samples, a long one if gene and value columns are named, or genes by samples.

    ``mapper`` names the label rules of its samples; ``one_of`` and ``latest`` reduce repeated records to the latest.
    """

    name: str
    path: str
    sample: str
    gene: str | None = None
    value: str | None = None
    mapper: str | None = None
    genes_as_rows: bool = False
    where: str | None = None
    one_of: str | None = None
    latest: str | None = None


def load_dataset(spark: SparkSession, config: DatasetConfig) -> DataFrame:
    """(sample_id, gene, value) of a configured data set, repeated cells as their mean; missing columns raise ValueError."""
    from matrixloom.operators import matrix

    df = read_table(spark, config.path)
    require_columns(df, [c for c in (config.sample, config.gene, config.value, config.one_of, config.latest) if c], config.name)
    df = df.where(config.where) if config.where else df
    if config.genes_as_rows:
        return gene_rows(df, config.sample)
    if config.gene is None:
        return matrix.unpivot_wide(df, config.sample)
    if config.one_of:
        best = F.max(F.struct(config.latest, config.sample, config.gene, config.value)).alias("b")
        df = df.groupBy(config.one_of).agg(best).select("b.*")
    return matrix.pivot_mean(df, F.col(config.sample), normalize_symbol(F.col(config.gene)), F.col(config.value))


def gene_rows(df: DataFrame, symbol: str, samples: list[str] | None = None) -> DataFrame:
    """(sample_id, gene, value) of a table with one row per gene and one column per sample; repeated symbols as their mean.

    Only the columns of ``samples`` are read if they are named; null cells don't count.
    """
    require_columns(df, [symbol, *(samples or [])], "expression")
    names = [c for c in df.columns if c != symbol and dict(df.dtypes)[c] in ("double", "float", "int", "bigint")] if samples is None else samples
    gene = normalize_symbol(F.col(f"`{symbol}`"))
    once = df.select(gene.alias("gene"), *[number(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(names)]).where("gene IS NOT NULL")
    mean = once.groupBy("gene").agg(*[F.avg(f"__{i}").alias(f"__{i}") for i in range(len(names))])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("sample_id"), F.col(f"__{i}").alias("value")) for i, c in enumerate(names)])).alias("c")
    return mean.select("gene", cells).select("c.sample_id", "gene", "c.value").where("value IS NOT NULL")


def inspect(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, found, n_rows, n_columns, error) of each path; what can't be read is told, not raised."""
    rows = []
    for name, path in paths.items():
        try:
            df = read_table(spark, path)
            rows.append((name, True, df.count(), len(df.columns), None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, False, None, None, str(e)[:200]))
    return spark.createDataFrame(rows, "name STRING, found BOOLEAN, n_rows BIGINT, n_columns INT, error STRING")


def component_genes(weights: DataFrame, first: int) -> DataFrame:
    """(model, component, genes): the genes of rank 1 to ``first`` of each component, by weight and name."""
    from matrixloom.operators.summarize import top_k

    require_columns(weights, ["model", "component", "gene", "weight"], "component table")
    top = top_k(weights, ["model", "component"], [F.desc("weight"), F.col("gene")], first)
    return top.groupBy("model", "component").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gene"))), lambda x: x["gene"]).alias("genes"))
