"""Work on sorted runs of rows inside Arrow batches, one bounded segment at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Index of the first row of each run of equal keys, and the length at the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, at_least: int = 1) -> Iterator[pa.Table]:
    """Regroup a stream sorted by ``key`` into tables in which no run of equal keys is cut.

    A table holds at least ``at_least`` rows (but the last one); the memory it needs is that plus one run.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key))
        last = k[-1]
        if held and rows >= at_least:
            previous = held[-1].column(held[-1].schema.get_field_index(key))[-1]
            if k[0] != previous:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if rows + b.num_rows >= at_least:
            values = k.to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(values != last.as_py())[-1]) + 1 if (values != last.as_py()).any() else 0
            if cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
                held, rows = [b.slice(cut)], b.num_rows - cut
                continue
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held)
