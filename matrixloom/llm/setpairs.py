"""All similar pairs of set-valued records, by recursive chosen-path splitting.

A record branches into a child node for each of its tokens that a hash shared by all records of the node
chooses; the chance is such that two similar sets expect ``spread`` common children. Nodes that are small are
compared by brute force, larger ones branch again. Several trees bring the recall to its target, and every
pair is verified on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrixloom.operators.segments import run_starts, whole_runs
from matrixloom.session import Scratch

#: Records of a node that are compared by brute force. A larger node costs as many comparisons as the nodes it would
#: branch into, but its sets are sent once and not once for every branch.
LEAF = 512
#: Places in which the records of one node learn that it is large.
PARTS = 16
#: Levels of branching; nodes that are larger even then are compared block by block.
MAX_DEPTH = 5
#: Common children that two records at the threshold expect.
SPREAD = 2.0


def trees_for(recall: float, spread: float = SPREAD) -> int:
    """Trees until a pair at the threshold is missed with at most 1 - recall.

    The number of common children is about Poisson with mean ``spread``; a lineage survives all levels with
    the chance s that solves s = 1 - exp(-spread * s).
    """
    s = 1.0
    for _ in range(100):
        s = 1 - math.exp(-spread * s)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - s)))


def set_classes(sets: DataFrame) -> DataFrame:
    """(key, grp, cls, items): ``items`` without nulls and repeats, in order; equal sets of a group share ``cls``.

    Records without items or with a null group or key are left out: they have no pairs.
    """
    items = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    named = sets.select("key", F.col("grp").cast("string").alias("grp"), items.alias("items"))
    named = named.where("key IS NOT NULL AND grp IS NOT NULL AND size(items) > 0")
    return named.select("key", "grp", F.md5(F.array_join(F.transform("items", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")).alias("cls"), "items")


def _uniform(h: Column) -> Column:
    return F.shiftrightunsigned(h, 11) * F.lit(2.0**-53)


def _leaf_pairs(threshold: float):
    """Pairs of a node whose hashed sets reach the threshold; right sides come from another table if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "node", 4_000):
            t = t.combine_chunks()
            starts = run_starts(t.column("node").combine_chunks().to_numpy())
            rid, side = t.column("rid").combine_chunks().to_numpy(), t.column("side").combine_chunks().to_numpy()
            toks = t.column("toks").combine_chunks()
            flat, ends = toks.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(toks.offsets.to_numpy()))))
            out_a, out_b = [], []
            for a, b in zip(starts[:-1], starts[1:]):
                m = b - a
                if m < 2:
                    continue
                n = np.diff(ends[a : b + 1])
                own = flat[ends[a] : ends[b]]
                row = np.repeat(np.arange(m), n)
                names, col = np.unique(own, return_inverse=True)
                keep = np.bincount(col) > 1  # tokens of one record make no overlap
                col_of = np.cumsum(keep) - 1
                used = keep[col]
                row, col = row[used], col_of[col[used]]
                width = int(keep.sum())
                common = np.zeros((m, m), np.float32)
                for c in range(0, width, 4096):
                    part = (col >= c) & (col < c + 4096)
                    x = np.zeros((m, min(4096, width - c)), np.float32)
                    x[row[part], col[part] - c] = 1
                    common += x @ x.T
                alike = common * (1 + threshold) >= threshold * (n[:, None] + n[None, :]) - 1e-6
                s = side[a:b]
                alike &= (s[:, None] == 0) & (s[None, :] == 1) if (side_mode := bool(side.any())) else np.triu(np.ones((m, m), bool), 1)
                i, j = np.nonzero(alike)
                x, y = rid[a + i], rid[a + j]
                out_a.append(x if side_mode else np.minimum(x, y))
                out_b.append(y if side_mode else np.maximum(x, y))
            if out_a:
                pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]] if not side.any() else pairs
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, leaf: int) -> DataFrame:
    """The rows of large nodes in smaller ones, so that every block of a node meets every other one."""
    m = F.ceil(F.col("members") / F.lit(leaf / 2)).cast("int")
    block = F.pmod(F.xxhash64("rid"), m).cast("int")
    met = rows.withColumn("o", F.explode(F.sequence(F.lit(0), m - 1)))
    return met.select(F.xxhash64("node", F.least(block, "o"), F.greatest(block, "o")).alias("node"), "rid", "side", "toks")


def similar_classes(
    classes: DataFrame, threshold: float, scratch: Scratch, other: DataFrame | None = None, recall: float = 0.9999,
    leaf: int = LEAF, max_depth: int = MAX_DEPTH, spread: float = SPREAD,
) -> DataFrame:
    """(grp, cls_a, cls_b, common, overlap): pairs of different sets of a group with Jaccard overlap >= threshold.

    Within ``classes`` (of :func:`set_classes`), or between it and ``other``. Each set of a group is
    compared once however many records have it. A pair at the threshold is missed with at most 1 - recall,
    more similar ones less; every pair returned is exact.
    """
    trees = trees_for(recall, spread)

    def distinct_sets(c: DataFrame, side: int) -> DataFrame:
        one = c.groupBy("grp", "cls").agg(F.first("items").alias("items"))
        return one.select("grp", "cls", "items", F.xxhash64("grp", "cls").alias("rid"), F.lit(side).alias("side"))

    sets = distinct_sets(classes, 0)
    sets = scratch.save(sets if other is None else sets.unionByName(distinct_sets(other, 1)))
    level = sets.select(
        F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"), "grp", "rid", "side", F.transform("items", lambda x: F.xxhash64(x)).alias("toks")
    ).select(F.xxhash64("tree", "grp").alias("node"), "rid", "side", "toks", F.array().cast("array<bigint>").alias("path"))
    found, written = [], None
    for depth in range(max_depth + 1):
        level = scratch.save(level)
        big = level.groupBy("node").agg(F.count("*").alias("members")).where(F.col("members") > leaf)
        told = big.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        placed = level.withColumn("part", F.pmod("rid", F.lit(PARTS)).cast("int")).join(told, ["node", "part"], "left").drop("part")
        small = placed.where("members IS NULL").select("node", "rid", "side", "toks")
        rest = placed.where("members IS NOT NULL")
        if depth == max_depth:
            small = small.unionByName(_in_blocks(rest, leaf))
        elif depth:  # two sets that share the path alone have no common child; at the threshold such sets are that short
            short = rest.drop("members").where(F.size("toks") * F.lit(threshold) <= F.lit(depth + 1e-9))
            small = small.unionByName(_in_blocks(short.join(short.groupBy("node").agg(F.count("*").alias("members")), "node"), leaf))
        ordered = small.repartition("node").sortWithinPartitions("node")
        found.append(scratch.save(ordered.mapInArrow(_leaf_pairs(threshold), "a BIGINT, b BIGINT").distinct()))
        if depth == max_depth or big.isEmpty():
            break
        chance = F.lit(spread) / F.greatest(F.size("toks") * F.lit(threshold) - F.lit(depth), F.lit(1.0))
        chosen = F.filter("toks", lambda t: (_uniform(F.xxhash64("node", t)) < chance) & ~F.array_contains("path", t))
        level = rest.select("node", "rid", "side", "toks", "path", F.explode(chosen).alias("t")).select(
            F.xxhash64("node", "t", F.lit(1)).alias("node"), "rid", "side", "toks", F.array_append("path", F.col("t")).alias("path")
        )
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    left = sets.where("side = 0").select(F.col("rid").alias("a"), "grp", F.col("cls").alias("cls_a"), F.col("items").alias("xs"))
    right = sets.where("side = 1" if other is not None else "side = 0").select(F.col("rid").alias("b"), F.col("grp").alias("grp_b"), F.col("cls").alias("cls_b"), F.col("items").alias("ys"))
    both = pairs.distinct().join(left, "a").join(right, "b").where("grp = grp_b").withColumn("common", F.size(F.array_intersect("xs", "ys")))
    return (
        both.withColumn("overlap", F.col("common") / (F.size("xs") + F.size("ys") - F.col("common"))).where(F.col("overlap") >= threshold - 1e-12)
        .select("grp", "cls_a", "cls_b", "common", "overlap")
    )


def expand_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, overlap): record pairs, a < b, from pairs of classes and from the records of one class."""
    m = classes.select("key", "grp", "cls")
    across = (
        pairs.join(m.select("grp", F.col("cls").alias("cls_a"), F.col("key").alias("x")), ["grp", "cls_a"])
        .join(m.select("grp", F.col("cls").alias("cls_b"), F.col("key").alias("y")), ["grp", "cls_b"])
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")
    )
    shared = m.groupBy("grp", "cls").agg(F.count("*").alias("n")).where("n > 1").select("grp", "cls")
    copies = m.join(shared, ["grp", "cls"])
    within = copies.select("grp", "cls", F.col("key").alias("a")).join(copies.select("grp", "cls", F.col("key").alias("b")), ["grp", "cls"]).where("a < b")
    return across.unionByName(within.select("a", "b", F.lit(1.0).alias("overlap")))


def link_counts(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, grp, cls, n_links): for each record its class and the number of records it is similar to."""
    size = classes.groupBy("grp", "cls").agg(F.count("*").alias("n"))
    ends = pairs.select("grp", F.col("cls_a").alias("cls"), F.col("cls_b").alias("to")).unionByName(pairs.select("grp", F.col("cls_b").alias("cls"), F.col("cls_a").alias("to")))
    far = ends.join(size.select("grp", F.col("cls").alias("to"), F.col("n").alias("n_to")), ["grp", "to"]).groupBy("grp", "cls").agg(F.sum("n_to").alias("far"))
    per = size.join(far, ["grp", "cls"], "left").select("grp", "cls", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return classes.select("key", "grp", "cls").join(per, ["grp", "cls"]).select("key", "grp", "cls", "n_links")
