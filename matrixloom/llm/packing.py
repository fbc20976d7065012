"""Documents into containers of a fixed number of tokens: bounded-space best fit.

Each task packs the documents of its partition as they come, with a fixed number of open containers whose
free space is a bit in a bitset; the fullest that still takes the item gets it, and when a new container
is needed while all are open, the fullest closes first. Containers still open at the end of the partitions
are packed into one another by the same rule, in groups of partitions, until one group is left.
"""

from __future__ import annotations

import base64
import functools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.session import Scratch

CAPACITY = 4096
OPEN_BINS = 64
#: Groups whose open containers meet in one task of the next level.
FAN_IN = 32


@functools.cache
def tokenizer(path: str | None = None):
    """The tokenizer of a ``.tiktoken`` rank file; by default the public byte-level BPE vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class OpenBins:
    """At most ``limit`` open bins, found by their free space through a bitset."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.bits, self.open = 0, 0
        self.by_free: dict[int, list] = defaultdict(list)

    def _take(self, free: int, oldest: bool = False):
        bins = self.by_free[free]
        b = bins.pop(bins.index(min(bins)) if oldest else -1)
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def put(self, size: int, new):
        """The bin for an item: the best fit, or ``new()`` after the fullest has closed. 0 < size <= capacity.

        Of equally full ones the latest used takes the item, and the one with the smallest number closes.
        """
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1, oldest=True)
            free, b = self.capacity, new()
        if free > size:
            left = free - size
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        return b

    def left(self) -> list[tuple]:
        """(bin, filled) of the bins still open."""
        return [(b, self.capacity - free) for free, bins in self.by_free.items() for b in bins]


def pack(
    docs: DataFrame, key: str, text: str, scratch: Scratch, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, vocabulary: str | None = None,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(key, piece, token_start, n_tokens, container): which tokens of each document lie in which container.

    A document of at most ``capacity`` tokens is one piece. A longer one is cut into full containers of its
    own and a rest that is packed like any document. Null and empty texts have no tokens: one row with
    container null. Rows that repeat a key are packed as documents of their own. Other columns may have any
    name. The result depends on how the table is split into partitions, not on timing: a task that runs
    again packs the same way.
    """
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    of = docs.schema[key].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        bins, made = OpenBins(capacity, open_bins), iter(range(part << 40, (part + 1) << 40))
        for b in batches:
            at, piece, start, n, bin_of = [], [], [], [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                size = len(enc.encode_ordinary(s)) if s else 0
                for j in range(0, max(1, size), capacity):
                    m = min(capacity, size - j)
                    at.append(i)
                    piece.append(j // capacity)
                    start.append(j)
                    n.append(m)
                    bin_of.append(None if not m else next(made) if m == capacity else bins.put(m, lambda: next(made)))
            yield batch(b.column(0).take(pa.array(at, pa.int64())), piece, start, n, bin_of, None)
        open_ = bins.left()
        yield batch(pa.nulls(len(open_), key_type), [-1] * len(open_), [0] * len(open_), [f for _, f in open_], [x for x, _ in open_], part)

    def batch(keys, piece, start, n, bin_of, part) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(bin_of, pa.int64()), pa.array([part] * len(piece), pa.int32())],
            names=["key", "piece", "token_start", "n_tokens", "bin", "part"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[key].dataType)
    packed = scratch.save(named.mapInArrow(first, f"key {of}, piece INT, token_start BIGINT, n_tokens INT, bin BIGINT, part INT"))
    rows = packed.where("piece >= 0").select("key", "piece", "token_start", "n_tokens", "bin")
    merged = _merge(packed.where("piece < 0").select("bin", "n_tokens", "part"), scratch, capacity, open_bins, fan_in)
    return rows.join(merged, "bin", "left").select("key", "piece", "token_start", "n_tokens", F.coalesce("into", "bin").alias("container"))


def _merge(left: DataFrame, scratch: Scratch, capacity: int, open_bins: int, fan_in: int) -> DataFrame:
    """(bin, into): the open bins of all partitions, packed into one another level by level.

    A task of a level gets what ``fan_in`` tasks of the level below left open and leaves at most ``open_bins`` open
    itself, so no task, the last one included, holds more than their product.
    """
    into = scratch.save(left.select("bin", F.col("bin").alias("into"), F.col("n_tokens").alias("filled"), F.col("part").alias("grp")))
    groups = (into.agg(F.max("grp")).first()[0] or 0) + 1
    still_open, into = into.select("into", "filled", "grp"), into.select("bin", "into")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, group, to, rows = OpenBins(capacity, open_bins), None, {}, []

        def over() -> pa.RecordBatch:
            left_open = {b for b, _ in bins.left()}
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.int64()), pa.array([to[t] for _, t in rows], pa.int32()),
                 pa.array([t in left_open for _, t in rows], pa.bool_()), pa.array([group] * len(rows), pa.int32())],
                names=["old", "into", "filled", "open", "grp"],
            )

        for b in batches:
            for g, x, filled in zip(*(b.column(i).to_pylist() for i in range(3))):
                if g != group:
                    if rows:
                        yield over()
                    bins, group, to, rows = OpenBins(capacity, open_bins), g, {}, []
                target = bins.put(filled, lambda x=x: x)
                rows.append((x, target))
                to[target] = to.get(target, 0) + filled
        if rows:
            yield over()

    while True:
        one = still_open.select(F.floor(F.col("grp") / fan_in).cast("int").alias("grp"), "into", "filled").repartition("grp").sortWithinPartitions("grp", F.desc("filled"), "into")
        merged = scratch.save(one.mapInArrow(once, "old BIGINT, into BIGINT, filled INT, open BOOLEAN, grp INT"))
        moved = merged.where("old <> into").select(F.col("old").alias("into"), F.col("into").alias("to"))
        into = scratch.save(into.join(moved, "into", "left").select("bin", F.coalesce("to", "into").alias("into")))
        still_open = merged.where("open AND old = into").select("into", "filled", "grp")
        groups = -(-groups // fan_in)
        if groups <= 1:
            return into
