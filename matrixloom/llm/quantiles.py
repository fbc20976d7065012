"""Percentiles per group by distributed multi-select, and summaries that merge without the values.

The values of a group lie in blocks of bounded size (a large group has many, so no task holds one whole).
In every round each block proposes the median of its values that are still in question, the weighted median
of the proposals becomes the group's pivot, the blocks count below, equal and above it, and the ranges that
are ruled out are discarded: the next round reads only what is still in question, until the wanted rank is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrixloom.session import Scratch

#: Rows of a group in a block, about; a group with more is spread over several blocks and tasks.
BLOCK = 256
#: Proposals that meet in one row; those of more blocks are combined level by level.
FAN_IN = 1024


def value_blocks(df: DataFrame, keys: list[str], values: dict[str, str], row_id: Column, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(grp, salt, salts, values): the sorted values of every group in blocks. null and NaN are left out.

    ``values`` names the measures (name -> column); ``grp`` is a struct of the key columns (nulls are a key of
    their own) and ``measure``. ``row_id`` spreads the rows of a large group over its blocks.
    """
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], row_id.alias("id"), *[clean(f"`{c}`").alias(f"v{i}") for i, c in enumerate(values.values())])
    by = [f"k{i}" for i in range(len(keys))]
    salts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    # groups beyond the block size number at most the rows divided by the block size
    large = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*[F.col(b).alias(f"g{b}") for b in by], salts.alias("salts"))
    same = [F.col(b).eqNullSafe(F.col(f"g{b}")) for b in by]
    on = same[0]
    for c in same[1:]:
        on = on & c
    spread = rows.join(large, on, "left").select(*by, "id", *[f"v{i}" for i in range(len(values))], F.coalesce("salts", F.lit(1)).alias("salts"))
    blocks = spread.groupBy(*by, F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "salts").agg(
        *[F.sort_array(F.collect_list(f"v{i}")).alias(f"v{i}") for i in range(len(values))]
    )
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"v{i}").alias("values")) for i, m in enumerate(values)]))
    out = blocks.select(*by, "salt", "salts", each.alias("m")).where(F.size("m.values") > 0)
    return scratch.save(out.select(F.struct(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col("m.measure").alias("measure")).alias("grp"), "salt", "salts", "m.values"))


def _bisect(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """For each i the insertion point of x[i] in the sorted flat[lo[i]:hi[i]]."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        v = flat[np.where(open_, mid, 0)]
        below = (v <= x if right else v < x) & open_
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)


_COUNTS = "grp {0}, salt INT, k INT, below BIGINT, equal BIGINT, low_n BIGINT, low_med DOUBLE, high_n BIGINT, high_med DOUBLE, next_v DOUBLE, values ARRAY<DOUBLE>"


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three-way counts of the pivot in each block, the block's proposal for either side, and what of the block is in question.

    Columns in: grp, salt, values, asks (array of k, lo, hi, pivot). Values in question lie strictly between lo
    and hi; a null bound is none. The first round has no pivot: it proposes over all values. The values that
    some k still asks for are in the row of the block's first k.
    """
    for b in batches:
        values, asks = b.column(2), b.column(3)
        flat = values.flatten().to_numpy(zero_copy_only=False)
        if not len(flat):
            continue
        ends = np.cumsum(np.diff(values.offsets.to_numpy()))
        begins = np.concatenate(([0], ends[:-1]))
        per = np.diff(asks.offsets.to_numpy())
        row = np.repeat(np.arange(b.num_rows), per)
        ask = asks.flatten()
        k, lo_v, hi_v, pivot = (ask.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(4))
        lo_v, hi_v = np.where(np.isnan(lo_v), -np.inf, lo_v), np.where(np.isnan(hi_v), np.inf, hi_v)
        first, last = begins[row], ends[row]
        start = np.where(np.isinf(lo_v), first, _bisect(flat, first, last, lo_v, True))
        stop = np.where(np.isinf(hi_v), last, _bisect(flat, first, last, hi_v, False))
        stop = np.maximum(start, stop)
        fresh = np.isnan(pivot)
        p = np.where(fresh, np.inf, pivot)
        less = np.where(fresh, stop, _bisect(flat, first, last, p, False))
        ahead = np.where(fresh, last, _bisect(flat, first, last, p, True))
        less, upto = np.clip(less, start, stop), np.clip(np.where(fresh, stop, ahead), start, stop)

        def middle(a: np.ndarray, z: np.ndarray) -> pa.Array:
            return pa.array(flat[np.where(a < z, (a + z - 1) // 2, 0)], mask=a >= z)

        one = np.flatnonzero(np.diff(row, prepend=-1))
        left, right = np.minimum.reduceat(start, one), np.maximum.reduceat(stop, one)
        n = np.zeros(len(row), np.int64)
        n[one] = right - left
        at = np.repeat(left - np.concatenate(([0], np.cumsum(right - left)[:-1])), right - left) + np.arange(int((right - left).sum()))
        kept = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat[at]))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(less - start), pa.array(upto - less),
             pa.array(less - start), middle(start, less), pa.array(stop - upto), middle(upto, stop),
             pa.array(flat[np.where(ahead < last, ahead, 0)], mask=ahead >= last), kept],
            names=["grp", "salt", "k", "below", "equal", "low_n", "low_med", "high_n", "high_med", "next_v", "values"],
        )


def _weighted_median(n: str, med: str) -> Column:
    """The weighted median of at most FAN_IN proposals: the first at which half of the weight is reached."""
    pairs = F.sort_array(F.collect_list(F.when(F.col(med).isNotNull(), F.struct(F.col(med).alias("m"), F.col(n).alias("w")))))
    half = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + x["w"])
    walk = F.aggregate(
        pairs, F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("m")),
        lambda a, x: F.struct((a["seen"] + x["w"]).alias("seen"), F.when(a["m"].isNull() & (2 * (a["seen"] + x["w"]) >= half), x["m"]).otherwise(a["m"]).alias("m")),
    )
    return walk["m"]


def _pooled(counted: DataFrame, most_salts: int, fan_in: int) -> DataFrame:
    """(grp, k, below, equal, low, high, next_v): the blocks' counts and proposals, combined ``fan_in`` at a time.

    The median of medians of several levels is no exact median, but an eighth of the values in question, or more
    by level, lies on either side of it.
    """
    level = counted
    while most_salts > fan_in:
        most_salts = -(-most_salts // fan_in)
        level = level.groupBy("grp", "k", F.floor(F.col("salt") / F.lit(fan_in)).cast("int").alias("salt")).agg(*_combined()).withColumnsRenamed(_NAMES | {"low": "low_med", "high": "high_med"})
    return level.groupBy("grp", "k").agg(*_combined()).withColumnsRenamed(_NAMES)


_NAMES = {f"{c}_": c for c in ("below", "equal", "low_n", "high_n", "next_v")}


def _combined() -> list[Column]:
    sums = [F.sum(c).alias(f"{c}_") for c in ("below", "equal", "low_n", "high_n")]
    return [*sums, _weighted_median("low_n", "low_med").alias("low"), _weighted_median("high_n", "high_med").alias("high"), F.min("next_v").alias("next_v_")]


def _rounds_in_task(probabilities: list[float]):
    """Groups of one block: the same rounds, in which the block's own median is the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(values.offsets.to_numpy())
            begin = np.cumsum(n) - n
            m = len(probabilities)
            row, p = np.repeat(np.arange(b.num_rows), m), np.tile(np.array(probabilities), b.num_rows)
            h = (n[row] - 1) * p
            want = begin[row] + np.floor(h).astype(np.int64)
            lo, hi = begin[row].copy(), begin[row] + n[row]
            found = np.full(len(row), -1, np.int64)
            while (found < 0).any():
                pivot = flat[np.where(found < 0, (lo + hi - 1) // 2, 0)]
                less, upto = _bisect(flat, lo, hi, pivot, False), _bisect(flat, lo, hi, pivot, True)
                hit = (found < 0) & (less <= want) & (want < upto)
                found = np.where(hit, want, found)
                left, right = (found < 0) & (want < less), (found < 0) & (want >= upto)
                hi, lo = np.where(left, less, hi), np.where(right, upto, lo)
            low = flat[found]
            high = flat[np.minimum(found + 1, begin[row] + n[row] - 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(m, dtype=np.int32), b.num_rows)), pa.array(n[row].astype(np.int64)), pa.array(low + (h - np.floor(h)) * (high - low))],
                names=["grp", "k", "n", "value"],
            )

    return run


def multi_select(blocks: DataFrame, probabilities: list[float], scratch: Scratch, max_rounds: int = 200, fan_in: int = FAN_IN) -> DataFrame:
    """(grp, k, n, value): for each group and probability ``k`` the percentile, linearly interpolated.

    ``blocks`` come from :func:`value_blocks`. Exact: rank h = (n - 1) p, its lower neighbour is selected and
    the next greater value found beside it. Groups without values have no row. Ties are counted as equals,
    so a group of one repeated value ends in the first round. A search that doesn't end in ``max_rounds`` is an error.
    """
    of = blocks.schema["grp"].dataType.simpleString()
    one = blocks.where("salts = 1").select("grp", "values").mapInArrow(_rounds_in_task(probabilities), f"grp {of}, k INT, n BIGINT, value DOUBLE")
    blocks = blocks.where("salts > 1").select("grp", "salt", "salts", "values")
    sizes = blocks.groupBy("grp").agg(F.sum(F.size("values")).alias("n"), F.max("salts").alias("salts"))
    wanted = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)])
    state = sizes.select("grp", "n", "salts", F.explode(wanted).alias("w")).select(
        "grp", "n", "salts", "w.k", ((F.col("n") - 1) * F.col("w.p")).alias("h"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("pivot"), F.lit(0).cast("bigint").alias("before"),
        F.lit(None).cast("double").alias("found"), F.lit(None).cast("double").alias("above"),
    )
    state = scratch.save(state)
    most_salts = state.agg(F.max("salts")).first()[0]
    if most_salts is None:
        return one
    done, left, previous = [], blocks.select("grp", "salt", "values"), None
    spot = F.pmod(F.col("salt"), F.lit(fan_in))  # a group's blocks meet its pivots in as many places
    for _ in range(max_rounds):
        asks = (
            state.groupBy("grp").agg(F.max("salts").alias("salts"), F.collect_list(F.struct("k", "lo", "hi", "pivot")).alias("asks"))
            .select("grp", F.explode(F.sequence(F.lit(0), F.least(F.col("salts"), F.lit(fan_in)) - 1)).alias("spot"), "asks")
        )
        counted = scratch.save(left.withColumn("spot", spot).join(asks, ["grp", "spot"]).select("grp", "salt", "values", "asks").mapInArrow(_count_blocks, _COUNTS.format(of)))
        counts = _pooled(counted.drop("values"), most_salts, fan_in)
        left = counted.where(F.size("values") > 0).select("grp", "salt", "values")
        rank = F.floor(F.col("h")).cast("bigint")
        s = state.join(counts, ["grp", "k"])
        start, lower = F.col("pivot").isNull(), rank < F.col("before") + F.col("below")
        hit = ~start & ~lower & (rank < F.col("before") + F.col("below") + F.col("equal"))
        # the value after the hit is the same one while equals remain, else the smallest greater one, which may be the upper bound
        more = rank + 1 < F.col("before") + F.col("below") + F.col("equal")
        moved = s.select(
            "grp", "n", "salts", "k", "h",
            F.when(start | lower | hit, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
            F.when(~start & lower, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(start | lower, F.col("low")).otherwise(F.col("high")).alias("pivot"),
            F.when(start | lower | hit, F.col("before")).otherwise(F.col("before") + F.col("below") + F.col("equal")).alias("before"),
            F.when(hit, F.col("pivot")).alias("found"),
            F.when(hit, F.when(more, F.col("pivot")).otherwise(F.coalesce(F.least("next_v", "hi"), "pivot"))).alias("above"),
        )
        moved = scratch.save(moved)
        scratch.drop(state)
        scratch.drop(previous)
        previous = counted
        done.append(moved.where("found IS NOT NULL"))
        state = moved.where("found IS NULL")
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"percentiles are still open after {max_rounds} rounds")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return one.unionByName(out.select("grp", "k", "n", (F.col("found") + (F.col("h") - F.floor("h")) * (F.col("above") - F.col("found"))).alias("value")))


def percentiles(
    df: DataFrame, keys: list[str], values: dict[str, str], probabilities: list[float], scratch: Scratch, row_id: Column | None = None, block: int = BLOCK
) -> DataFrame:
    """The key columns, measure, n and q0, q1, ...: exact percentiles per group and measure, linearly interpolated.

    null and NaN values don't count; a group without any others has no row; an empty table gives none.
    """
    row_id = F.monotonically_increasing_id() if row_id is None else row_id
    found = multi_select(value_blocks(df, keys, values, row_id, scratch, block), probabilities, scratch)
    wide = found.groupBy("grp").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("k") == i, F.col("value"))).alias(f"q{i}") for i in range(len(probabilities))])
    return wide.select(*[F.col(f"grp.`{k}`").alias(k) for k in [*keys, "measure"]], "n", *[f"q{i}" for i in range(len(probabilities))])


def grid_summary(df: DataFrame, keys: list[str], value: str, width: float = 0.01) -> DataFrame:
    """(keys, cell, n): how many values of each group lie in each cell of a fixed grid.

    A summary that merges: those of other partitions, days or releases are added up cell by cell. A percentile
    read from it is off by at most half a ``width``, whatever the number of values. It is meant for values of a
    known scale: a group has as many cells as its range has widths, and beyond 2^53 widths from 0 cells are no longer exact.
    """
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, F.floor(v / F.lit(width)).alias("cell")).agg(F.count("*").alias("n"))


def merge_summaries(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of finer groups added up to the groups of ``keys``."""
    return summary.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))


def summary_percentiles(summary: DataFrame, keys: list[str], probabilities: list[float], width: float = 0.01) -> DataFrame:
    """(keys, n, q0, q1, ...): percentiles of the lower rank from a merged grid summary, the middle of their cell."""
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("cell"))
    s = summary.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    at = [F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * F.lit(p)), F.col("cell"))).alias(f"c{i}") for i, p in enumerate(probabilities)]
    out = s.groupBy(*keys).agg(F.max("total").alias("n"), *at)
    return out.select(*keys, "n", *[((F.col(f"c{i}") + 0.5) * F.lit(width)).alias(f"q{i}") for i in range(len(probabilities))])
