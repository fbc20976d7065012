"""Evaluation passages that leak into documents, found by greedy string tiling.

Every run of ``min_words`` words of an item is a seed, hashed by a rolling Karp-Rabin hash. The documents'
runs are hashed the same way, joined to the seeds, and grown to maximal matches along their diagonals; the
longest matches that don't overlap are marked first. Tiles may lie in any order, so reordered passages count.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.llm.lookalike import fold_text
from matrixloom.operators.segments import run_starts, whole_runs
from matrixloom.session import Scratch

_WORD = re.compile(r"[^\W_]+")
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bits of the filter of seeds that goes to every task: 16 per seed, but between these bounds (32 KB and 32 MB).
FILTER_BITS = (1 << 18, 1 << 28)
SLICE_BITS = 1 << 18
#: Different tokens whose words a task remembers.
REMEMBERED = 200_000


class TokenWords(dict):
    """{token between blanks: its words}, each folded once; a token with nothing but ASCII needs no folding."""

    def __missing__(self, token: str) -> tuple:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = out = tuple(self.of(w) for w in _WORD.findall((token if token.isascii() else fold_text(token)).casefold()))
        return out

    @staticmethod
    def of(word: str):
        return word


class TokenHashes(TokenWords):
    """{token between blanks: the 64-bit numbers of its words}."""

    @staticmethod
    def of(word: str) -> int:
        return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without regard to case and look-alike or invisible characters."""
    return list(itertools.chain.from_iterable(map(TokenWords().__getitem__, text.split()))) if text else []


def rolling(words: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all runs of ``k`` words given by their numbers."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * base + words[j : j + n]
    return h


def _runs(kind: str, k: int, bits: Broadcast | None = None):
    """A ``mapInArrow`` function: (key, position, two hashes) of the runs of k words that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenHashes()
        passes = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        for b in batches:
            rows, pos, first, second = [], [], [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                words = np.fromiter(itertools.chain.from_iterable(map(known.__getitem__, s.split())), np.uint64)
                if len(words) < k:
                    continue
                h = rolling(words, k, _BASE[0])
                at = np.arange(len(h))
                if passes is not None:
                    bit = h & np.uint64(len(passes) * 8 - 1)
                    at = np.flatnonzero(passes[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                if len(at):
                    rows.append(np.full(len(at), i))
                    pos.append(at)
                    first.append(h[at])
                    second.append(rolling(words, k, _BASE[1])[at])
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(pos).astype(np.int32)),
                     pa.array(np.concatenate(first).view(np.int64)), pa.array(np.concatenate(second).view(np.int64))],
                    names=[kind, "pos", "h1", "h2"],
                )

    return run


def _seed_filter(seeds: DataFrame) -> bytes:
    """A bitset with the first hashes of the seeds, of bounded size whatever their number; the join decides what passes."""
    n = seeds.count()
    bits = min(max(FILTER_BITS[0], 1 << (16 * n).bit_length()), FILTER_BITS[1])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "slice"):
            t = t.combine_chunks()
            number, bit = t.column("slice").to_numpy(), t.column("bit").to_numpy()
            starts = run_starts(number)
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                flags = np.zeros(SLICE_BITS, bool)
                flags[bit[a:b]] = True
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(number[starts[:-1]]), pa.array(out, pa.binary())], names=["slice", "bits"])

    bit = F.col("h1").bitwiseAND(F.lit(bits - 1))
    of = seeds.select(F.floor(bit / SLICE_BITS).cast("int").alias("slice"), F.pmod(bit, F.lit(SLICE_BITS)).cast("int").alias("bit")).distinct()
    slices = of.repartition("slice").sortWithinPartitions("slice").mapInArrow(pack, "slice INT, bits BINARY").collect()
    out = bytearray(bits // 8)
    for r in slices:
        out[r.slice * SLICE_BITS // 8 : (r.slice + 1) * SLICE_BITS // 8] = r.bits
    return bytes(out)


def shared_seeds(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, k: int) -> DataFrame:
    """(doc, item, pos, ipos) of every run of ``k`` words that a document and an item share.

    The documents are read once, whatever the size of the test set: a filter of bounded size keeps the runs that
    may be seeds, and a join on both hashes decides.
    """
    spark = docs.sparkSession
    of, item_of = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    named = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    texts = docs.select(F.col(f"`{doc_key}`").alias("doc"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    seeds = Scratch(spark, "seeds").save(named.mapInArrow(_runs("item", k), f"item {item_of}, pos INT, h1 BIGINT, h2 BIGINT"))
    found = texts.mapInArrow(_runs("doc", k, spark.sparkContext.broadcast(_seed_filter(seeds))), f"doc {of}, pos INT, h1 BIGINT, h2 BIGINT")
    return found.join(seeds.withColumnRenamed("pos", "ipos"), ["h1", "h2"]).select("doc", "item", "pos", "ipos")


def greedy_tiles(matches: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """Tiles (length, item start, document start) from maximal matches, longest first.

    What is left of a match beside the tiles marked before it competes again while it has ``k`` words.
    """
    heap = [(-n, i, d) for n, i, d in matches if n >= k]
    heapq.heapify(heap)
    item_marked: set[int] = set()
    doc_marked: set[int] = set()
    tiles = []
    while heap:
        n, i, d = heapq.heappop(heap)
        free = [p for p in range(-n) if i + p not in item_marked and d + p not in doc_marked]
        if len(free) == -n:
            tiles.append((-n, i, d))
            item_marked.update(range(i, i - n))
            doc_marked.update(range(d, d - n))
            continue
        runs = np.split(np.array(free, np.int64), np.flatnonzero(np.diff(free) != 1) + 1) if free else []
        for r in runs:
            if len(r) >= k:
                heapq.heappush(heap, (-len(r), i + int(r[0]), d + int(r[0])))
    return tiles


def leaks(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "item_text", min_words: int = 12, min_coverage: float = 0.0,
) -> DataFrame:
    """Documents with passages of items: one row per document and item.

    Columns: doc, item, n_tiles, longest, covered (words of the item under tiles), item_words, coverage
    and reordered (whether the tiles lie in another order than in the item). A row has a tile of at least
    ``min_words`` consecutive words and at least ``min_coverage`` of the item covered. Null, empty and
    shorter texts and items give none; repeated rows of a document or item add nothing; other columns
    may have any name.
    """
    item_words = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("t"))
    item_of = items.schema[item_key].dataType.simpleString()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words_of(t)) for t in b.column(1).to_pylist()], pa.int32())], names=["item", "item_words"])

    sizes = item_words.mapInArrow(lengths, f"item {item_of}, item_words INT").groupBy("item").agg(F.max("item_words").alias("item_words"))
    seeds = shared_seeds(docs, doc_key, text, items, item_key, item_text, min_words).distinct()
    diagonal = Window.partitionBy("doc", "item", F.col("pos") - F.col("ipos")).orderBy("pos")
    runs = (
        seeds.withColumn("run", F.col("pos") - F.row_number().over(diagonal))
        .groupBy("doc", "item", (F.col("pos") - F.col("ipos")).alias("shift"), "run")
        .agg(F.min("ipos").alias("ipos"), F.min("pos").alias("pos"), (F.count("*") + (min_words - 1)).cast("int").alias("n"))
    )
    of = docs.schema[doc_key].dataType.simpleString()
    schema = f"doc {of}, item {item_of}, n_tiles INT, longest INT, covered INT, reordered BOOLEAN"

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "doc", 5_000):
            doc, item = np.array(t.column("doc").to_pylist(), object), np.array(t.column("item").to_pylist(), object)
            rows = list(zip(t.column("n").to_pylist(), t.column("ipos").to_pylist(), t.column("pos").to_pylist()))
            starts = run_starts(doc, item)
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                tiles = sorted(greedy_tiles(rows[a:b], min_words), key=lambda x: x[2])
                order = [x[1] for x in tiles]
                out.append((len(tiles), max(x[0] for x in tiles), sum(x[0] for x in tiles), order != sorted(order)))
            at = pa.array(starts[:-1])
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [t.column("doc").combine_chunks().take(at), t.column("item").combine_chunks().take(at)]
                + [pa.array(c, ty) for c, ty in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.bool_()))],
                names=["doc", "item", "n_tiles", "longest", "covered", "reordered"],
            )

    tiles = runs.select("doc", "item", "n", "ipos", "pos").repartition("doc").sortWithinPartitions("doc", "item", "pos").mapInArrow(tile, schema)
    return (
        tiles.join(sizes, "item").withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= min_coverage)
        .select("doc", "item", "n_tiles", "longest", "covered", "item_words", "coverage", "reordered")
    )
