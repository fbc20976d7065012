"""Entity-attribute-value rows into a wide table with one typed column per attribute.

Cells are combined before any shuffle moves them by entity, so an entity with a third of all rows
arrives as no more rows than there are attributes. Entities are then hashed into buckets; within a
bucket, blocks of entities are dictionary-encoded and their values scattered into one numpy array per
type, by row and column index, and handed to Spark as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matrixloom.operators.packed import BLANKS
from matrixloom.operators.segments import run_starts, whole_runs
from matrixloom.schema import require_columns

# Type name -> Spark type, Arrow type, numpy type
TYPES: dict[str, tuple[T.DataType, pa.DataType, type]] = {
    "double": (T.DoubleType(), pa.float64(), np.float64),
    "bigint": (T.LongType(), pa.int64(), np.int64),
    "string": (T.StringType(), pa.string(), object),
}
#: Bytes of values that one block of the wide table may hold in a task.
BLOCK_BYTES = 24 << 20


def clean_symbol(c: Column) -> Column:
    """Upper case without any white space around; blank, NAN and NONE become null."""
    s = F.upper(F.trim(c, F.lit(BLANKS)))
    return F.when(~s.isin("", "NAN", "NONE"), s)


def eav_cells(df: DataFrame, entity: str, attribute: Column, value: Column, record: str | None = None) -> DataFrame:
    """(entity, attribute, value): the mean per entity and attribute, a repeated record counted once.

    null and NaN values and rows without entity or attribute make no cell. Repeated records must agree
    in their value; the greatest counts where they do not. A null record id is a record of its own.
    """
    rows = df.select(
        F.col(f"`{entity}`").alias("entity"), attribute.alias("attribute"), value.cast("double").alias("value"),
        (F.col(f"`{record}`") if record else F.lit(None).cast("bigint")).alias("record"),
    ).where(F.col("entity").isNotNull() & F.col("attribute").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    mean = [F.sum("value").alias("s"), F.count("value").alias("n")]
    if record:
        known = rows.where(F.col("record").isNotNull()).groupBy("entity", "attribute", "record").agg(F.max("value").alias("value"))
        sums = known.groupBy("entity", "attribute").agg(*mean).unionByName(
            rows.where(F.col("record").isNull()).groupBy("entity", "attribute").agg(*mean)
        )
        return sums.groupBy("entity", "attribute").agg((F.sum("s") / F.sum("n")).alias("value"))
    return rows.groupBy("entity", "attribute").agg(F.avg("value").alias("value"))


def attribute_dictionary(cells: DataFrame, max_attributes: int = 20_000) -> list[str]:
    """The sorted attributes: the columns of the wide table. Their number is checked before they are collected."""
    names = [r[0] for r in cells.select("attribute").where(F.col("attribute").isNotNull()).distinct().limit(max_attributes + 1).collect()]
    if len(names) > max_attributes:
        raise ValueError(f"more than {max_attributes} attributes: no table can have that many columns")
    return sorted(names)


def _blocks(columns: list[str], kinds: dict[str, str], value_columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """(entities, {type: (values, filled)}) of blocks of entities, from cells sorted by entity."""
    code = {a: i for i, a in enumerate(columns)}
    of_kind = {k: [i for i, a in enumerate(columns) if kinds[a] == k] for k in value_columns}
    within = np.zeros(len(columns), np.int64)
    for ids in of_kind.values():
        within[ids] = np.arange(len(ids))
    kind_of = np.array([value_columns.index(kinds[a]) for a in columns], np.int64)
    step = max(16, BLOCK_BYTES // (8 * max(1, len(columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in whole_runs(batches, "entity", 20_000):
            t = t.combine_chunks()
            entity = t.column("entity").combine_chunks()
            key = entity.dictionary_encode()
            key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
            starts = run_starts(key.indices.to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            attr = t.column("attribute").combine_chunks().dictionary_encode()
            codes = np.array([code.get(a, -1) for a in attr.dictionary.to_pylist()], np.int64)[attr.indices.to_numpy(zero_copy_only=False)]
            raw = {k: t.column(k).combine_chunks() for k in value_columns}
            for first in range(0, len(starts) - 1, step):
                last = min(first + step, len(starts) - 1)
                lo, hi = starts[first], starts[last]
                out = {}
                for k, kind in enumerate(value_columns):
                    values = np.zeros((last - first, len(of_kind[kind])), TYPES[kind][2])
                    filled = np.zeros(values.shape, bool)
                    cell = raw[kind].slice(lo, hi - lo)
                    use = (codes[lo:hi] >= 0) & (kind_of[codes[lo:hi]] == k) & cell.is_valid().to_numpy(zero_copy_only=False)
                    at = row[lo:hi][use] - first, within[codes[lo:hi][use]]
                    values[at] = cell.filter(pa.array(use)).to_numpy(zero_copy_only=False)
                    filled[at] = True
                    out[kind] = values, filled
                yield entity.take(pa.array(starts[first:last])), out

    return run


def _sorted_cells(cells: DataFrame, value_columns: list[str], buckets: int | None) -> DataFrame:
    n = [buckets] if buckets else []
    return cells.select("entity", "attribute", *value_columns).repartition(*n, "entity").sortWithinPartitions("entity")


def eav_to_wide(
    cells: DataFrame, columns: list[str] | None = None, kinds: dict[str, str] | None = None, entity: str = "entity",
    values: dict[str, str] | None = None, buckets: int | None = None,
) -> DataFrame:
    """One row per entity and one typed column per attribute.

    ``cells`` has ``entity``, ``attribute`` and the value columns named by ``values`` (type -> column;
    default one DOUBLE column ``value``), at most one row per entity and attribute. ``columns`` are the
    attributes to show (default: all there are); ``kinds`` gives the type of each. A cell without a row
    is null; an entity whose attributes are all outside ``columns`` keeps its row. An attribute called
    like the entity column gets the suffix ``__attribute``. Empty tables give an empty wide table.
    """
    values = values or {"double": "value"}
    columns = attribute_dictionary(cells) if columns is None else columns
    kinds = kinds or dict.fromkeys(columns, next(iter(values)))
    kind_list = list(values)
    cells = cells.select("entity", "attribute", *[F.col(c).alias(k) for k, c in values.items()])
    shown = [c if c != entity else f"{c}__attribute" for c in columns]
    of = cells.schema["entity"].dataType
    schema = T.StructType([T.StructField(entity, of)] + [T.StructField(s, TYPES[kinds[c]][0]) for s, c in zip(shown, columns)])
    blocks = _blocks(columns, kinds, kind_list)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entities, per in blocks(batches):
            at = dict.fromkeys(kind_list, 0)
            arrays = [entities]
            for c in columns:
                k = kinds[c]
                v, f = per[k]
                arrays.append(pa.array(v[:, at[k]], TYPES[k][1], mask=~f[:, at[k]]))
                at[k] += 1
            yield pa.RecordBatch.from_arrays(arrays, names=[entity, *shown])

    return _sorted_cells(cells, kind_list, buckets).mapInArrow(emit, schema)


def wide_filled_cells(cells: DataFrame, columns: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """(entity, attribute, value) of the filled cells, read back from the arrays of the wide table.

    The blocks are those of :func:`eav_to_wide` with one DOUBLE column per attribute; only their filled
    cells leave the task, so the thousands of empty ones are not moved through the JVM.
    """
    columns = attribute_dictionary(cells) if columns is None else columns
    names = pa.array(columns, pa.string())
    blocks = _blocks(columns, dict.fromkeys(columns, "double"), ["double"])
    schema = T.StructType([T.StructField("entity", cells.schema["entity"].dataType), T.StructField("attribute", T.StringType()), T.StructField("value", T.DoubleType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entities, per in blocks(batches):
            v, f = per["double"]
            row, col = np.nonzero(f)
            yield pa.RecordBatch.from_arrays([entities.take(pa.array(row)), names.take(pa.array(col)), pa.array(v[row, col])], names=["entity", "attribute", "value"])

    return _sorted_cells(cells.select("entity", "attribute", F.col("value").alias("double")), ["double"], buckets).mapInArrow(emit, schema)


def most_common(df: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """The most common non-null value of ``column`` per key, the smallest on ties."""
    n = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("__n"))
    return n.groupBy(key).agg(F.min_by(column, F.struct(-F.col("__n"), F.col(column))).alias(out))


def run_cells(proteomics: DataFrame) -> DataFrame:
    """Cells of the proteomics table: run, cleaned gene symbol, mean log1p_nsaf."""
    require_columns(proteomics, ["run_id", "gene_symbol", "log1p_nsaf", "record_id"], "proteomics table")
    return eav_cells(proteomics, "run_id", clean_symbol(F.col("gene_symbol")), F.col("log1p_nsaf"), record="record_id")
