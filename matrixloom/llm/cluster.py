"""Records with alike profiles in clusters: grid density clustering.

Each profile is turned by a few fixed random rotations and quantised: per rotation the grid axes on which it
lies farthest out, and on which side, are its cells. All records of a cell are compared, block by block where
it is full, and are neighbours if the Pearson correlation of their profiles says so; cells are joined through the records they share, by propagating
minimum labels over the links until nothing changes. A cluster's densest cell holds its typical members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.operators.segments import run_starts, whole_runs
from matrixloom.session import Scratch

#: Rotations by the axes of a cell; a pair misses all of them with the product of the chances to miss each. Cells of
#: more axes are missed more often and get more grids, so that a pair's recall is no lower than with two axes.
GRIDS = {2: 4, 3: 8, 4: 14}
#: Grids whose cells are sent and linked in one step.
GRIDS_AT_ONCE = 2
#: Records of a cell that are compared at once; every block of a cell with more meets every other one.
CELL_ROWS = 4096
#: Distinct profiles up to which a cell has two and three axes.
FEW, MANY = 2_000_000, 120_000_000
#: Records sent in a batch.
SENT_ROWS = 100_000
MISSING = -128
#: The correlation of the 8-bit profiles is off by less than this; closer calls go back to the values.
MARGIN = 0.025
#: Rows of a cell that are compared with all its rows at a time.
AT_ONCE = 64


def axes_for(profiles: int) -> int:
    """Axes of a cell for so many different profiles, so that cells stay small."""
    return 2 if profiles <= FEW else 3 if profiles <= MANY else 4


def quantised_profiles(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(id, key, vec): the centred profile of each row in 8 bits per feature; no shuffle.

    null, NaN and infinite values are missing. A profile with fewer than three values or without variance
    is correlated with nothing: its vec is null. Rows with a null key are left out. ``id`` is a 64-bit hash
    of the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, ok = _quantise(_matrix(b, 1, b.num_columns))
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(q, ok)], names=["key", "vec"])

    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), *[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)]).where("key IS NOT NULL")
    return rows.mapInArrow(run, "key STRING, vec BINARY").select(F.xxhash64("key").alias("id"), "key", "vec")


def _matrix(b: pa.RecordBatch, first: int, last: int) -> np.ndarray:
    x = np.empty((b.num_rows, last - first))
    for i in range(first, last):
        x[:, i - first] = b.column(i).to_numpy(zero_copy_only=False)
    x[~np.isfinite(x)] = np.nan
    return x


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    there = ~np.isnan(x)
    n = there.sum(1)
    c = np.where(there, x, 0)
    c = np.where(there, c - (c.sum(1) / np.maximum(n, 1))[:, None], 0)
    top = np.abs(c).max(1, initial=0)
    ok = (n >= 3) & (top > 1e-9)
    q = np.rint(c / np.where(ok, top, 1)[:, None] * 126).astype(np.int8)
    q[~there] = MISSING
    return q, ok


def _binary(q: np.ndarray, ok: np.ndarray) -> pa.Array:
    n, p = q.shape
    a = pa.Array.from_buffers(pa.binary(p), n, [None, pa.py_buffer(np.ascontiguousarray(q).tobytes())]) if p else pa.nulls(n, pa.binary())
    a = a.cast(pa.binary())
    return a if ok.all() else pa.array([x if o else None for x, o in zip(a.to_pylist(), ok)], pa.binary())


def _vectors(a: pa.Array | pa.ChunkedArray) -> np.ndarray:
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return np.frombuffer(b"".join(a.to_pylist()), np.int8).reshape(len(a), -1) if len(a) else np.zeros((0, 1), np.int8)


def _unit(q: np.ndarray) -> np.ndarray:
    u = np.where(q == MISSING, 0, q).astype(np.float32)
    there = q != MISSING
    u = np.where(there, u - (u.sum(1) / there.sum(1))[:, None], 0)
    return u / np.maximum(np.linalg.norm(u, axis=1), 1e-9)[:, None]


def _rotation(p: int, which: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(900 + which).standard_normal((p, p)))[0].astype(np.float32)


def _cells(u: np.ndarray, which: int, axes: int) -> np.ndarray:
    """The cells of each row in one grid: all choices of ``axes`` among the ``axes + 1`` farthest axes, with their sides."""
    p = u.shape[1]
    z = u @ _rotation(p, which)
    take = min(axes + 1, p)
    far = np.argpartition(-np.abs(z), take - 1, axis=1)[:, :take] if take < p else np.tile(np.arange(p), (len(z), 1))
    code = np.sort(far * 2 + (np.take_along_axis(z, far, 1) > 0), 1).astype(np.int64) + 1
    out = []
    for chosen in itertools.combinations(range(take), min(axes, take)):
        h = np.full(len(u), which + 1, np.int64)
        for c in chosen:
            h = h * np.int64(2 * p + 1) + code[:, c]
        out.append(h)
    return np.stack(out, 1)


def _in_cells(q: np.ndarray, axes: int, grids: range) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells in the grids named."""
    u = _unit(q)
    cells = np.concatenate([_cells(u, g, axes) for g in grids], 1)
    return np.repeat(np.arange(len(u)), cells.shape[1]), cells.ravel()


def _blocks_apart(rows: DataFrame, full: DataFrame) -> DataFrame:
    """``rows`` (cell, id, vec) with each cell of ``full`` (cell, blocks) replaced by all pairs of its blocks, three blocks at least.

    The join is by the planner's choice: a short list of full cells is broadcast, a long one isn't.
    """
    own = F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")
    # rows of one block meet in its pairs with others
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != own), lambda o: F.xxhash64("cell", F.least(own, o), F.greatest(own, o))
    )
    placed = rows.join(full, "cell", "left").withColumn("cells", F.when(F.col("blocks").isNull(), F.array("cell")).otherwise(pairs))
    return placed.select(F.explode("cells").alias("cell"), "id", "vec")


def _correlations(q: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, correlations of these rows with them and all later rows of an 8-bit matrix), over the features that both have; -1 where undefined.

    A block of rows at a time, so that what is computed for it stays in the processor's cache.
    """
    there = (q != MISSING).astype(np.float32)
    x = np.where(q == MISSING, 0, q).astype(np.float32)
    complete = bool(there.all())
    if complete:
        x -= x.mean(1, keepdims=True)
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    xt, tt, xxt, xx = x.T.copy(), there.T.copy(), (x * x).T.copy(), x * x
    for s in range(0, len(q), AT_ONCE):
        rows = slice(s, min(s + AT_ONCE, len(q)))
        r = x[rows] @ xt[:, s:]
        if not complete:
            n = there[rows] @ tt[:, s:]
            np.maximum(n, 1, out=n)
            sa, sb = x[rows] @ tt[:, s:], there[rows] @ xt[:, s:]  # sums of either side over the features of the other
            va, vb = xx[rows] @ tt[:, s:], there[rows] @ xxt[:, s:]
            r -= sa * sb / n
            va -= sa * sa / n
            vb -= sb * sb / n
            va *= vb
            bad = (va <= 1e-3) | (n < 3)
            va[bad] = 1
            r /= np.sqrt(va)
            r[bad] = -1
        yield rows, r


def _components(linked: np.ndarray) -> np.ndarray:
    """The component of each row of a symmetric matrix of links, by its first row; every row's links are read once."""
    m = len(linked)
    label = np.full(m, -1)
    for start in np.flatnonzero(linked.sum(1) > 1):
        if label[start] < 0:
            seen = np.zeros(m, bool)
            seen[start] = True
            at = np.array([start])
            while len(at):
                near = linked[at].any(0) & ~seen
                seen |= near
                at = np.flatnonzero(near)
            label[seen] = start
    return np.where(label < 0, np.arange(m), label)


def cell_links(q: np.ndarray, threshold: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(label, close calls): the component of each row of a cell, by its first row, and the pairs between components that need an exact check."""
    m = len(q)
    sure = np.zeros((m, m), bool)
    near: list[tuple[np.ndarray, np.ndarray]] = []
    for rows, r in _correlations(q):
        linked = r >= threshold + MARGIN
        sure[rows, rows.start :] |= linked
        sure[rows.start :, rows] |= linked.T
        i, j = np.nonzero((r >= threshold - MARGIN) & ~linked)
        near.append((i + rows.start, j + rows.start))
    np.fill_diagonal(sure, True)
    label = _components(sure)
    i, j = (np.concatenate([x[k] for x in near]) for k in (0, 1))
    use = (i < j) & (label[i] != label[j])
    return label, (i[use], j[use])


def alike_links(points: DataFrame, threshold: float, scratch: Scratch, grids: int | None = None, axes: int | None = None) -> DataFrame:
    """(a, b, sure): links among the ids of alike records; those that aren't sure need an exact check.

    Each component of a cell is a star around its smallest id, so cells with the same members give the same links.
    """
    some = points.where("vec IS NOT NULL").select("id", "vec")
    # rows with one profile, repeated or copied, are represented by the smallest id
    copies = scratch.save(some.groupBy("vec").agg(F.min("id").alias("id")).select("id", F.xxhash64("vec").alias("h"), "vec"))
    n = copies.count()
    # cells per grid grow with the axes, so that cells stay small; the grids make up for what more axes miss
    axes = axes or axes_for(n)
    grids = grids or GRIDS[axes]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells, k = np.unique(_in_cells(_vectors(b.column(0)), axes, range(grids))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(k)], names=["cell", "n"])

    counts = copies.select("vec").mapInArrow(count, "cell BIGINT, n BIGINT").groupBy("cell").agg(F.sum("n").alias("n"))
    full = scratch.save(counts.where(F.col("n") > CELL_ROWS).select("cell", F.ceil(2 * F.col("n") / CELL_ROWS).cast("int").alias("blocks")))

    def spread(some_grids: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 2000):
                    part = b.slice(s, 2000)
                    row, cell = _in_cells(_vectors(part.column(1)), axes, some_grids)
                    for c in range(0, len(row), SENT_ROWS):
                        at = pa.array(row[c : c + SENT_ROWS])
                        yield pa.RecordBatch.from_arrays([pa.array(cell[c : c + SENT_ROWS]), part.column(0).take(at), part.column(1).take(at)], names=["cell", "id", "vec"])

        return run

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "cell", 8_000):
            t = t.combine_chunks()
            starts = run_starts(t.column("cell").combine_chunks().to_numpy())
            ids, q = t.column("id").combine_chunks().to_numpy(), _vectors(t.column("vec"))
            first, second, sure = [], [], []
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a > 1:
                    label, close = cell_links(q[a:b], threshold)
                    x = np.flatnonzero(label != np.arange(b - a))
                    first += [ids[a + label[x]], ids[a + close[0]]]
                    second += [ids[a + x], ids[a + close[1]]]
                    sure += [np.ones(len(x), bool), np.zeros(len(close[0]), bool)]
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second)), pa.array(np.concatenate(sure))], names=["a", "b", "sure"])

    out = some.select("id", F.xxhash64("vec").alias("h")).join(copies.select("h", F.col("id").alias("first")), "h").where("id <> first")
    out = scratch.save(out.select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"), F.lit(True).alias("sure")))
    for g in range(0, grids, GRIDS_AT_ONCE):  # the profiles sent for some grids are deleted before the next
        rows = copies.select("id", "vec").mapInArrow(spread(range(g, min(g + GRIDS_AT_ONCE, grids))), "cell BIGINT, id BIGINT, vec BINARY")
        found = _blocks_apart(rows, full).repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(link, "a BIGINT, b BIGINT, sure BOOLEAN")
        out = out.unionByName(scratch.save(found))
    return out


def exact_links(df: DataFrame, key: str, features: list[str], pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose Pearson correlation, over the features that both records have, reaches the threshold."""
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    values = F.array(*[F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")) for f in features])
    own = df.select(F.xxhash64(F.col(f"`{key}`").cast("string")).alias("id"), values.alias("v")).join(asked, "id", "left_semi").groupBy("id").agg(F.max("v").alias("v"))
    both = pairs.select("a", "b").join(own.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.array(x, float), np.array(y, float)
                k = np.isfinite(x) & np.isfinite(y)
                x, y = x[k], y[k]
                d = np.sqrt(((x - x.mean()) ** 2).sum() * ((y - y.mean()) ** 2).sum()) if len(x) >= 3 else 0.0
                keep.append(bool(d > 0 and ((x - x.mean()) * (y - y.mean())).sum() / d >= threshold))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a BIGINT, b BIGINT")


def minimum_labels(links: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """(id, label): the connected components of links (a, b), by the smallest id.

    Every round a node takes the smallest label among its neighbours and then the label of that label, so
    the number of rounds grows with the logarithm of a component's diameter. Messages to a node are combined
    before they are shuffled.
    """
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        sent = both.join(labels.select(F.col("id").alias("a"), "label"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(sent, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jumped = lower.join(labels.select(F.col("id").alias("via"), F.col("label").alias("far")), "via", "left")
        new = scratch.save(jumped.select("id", F.least("via", F.coalesce("far", "via")).alias("label"), "old"))
        changed = new.where("label <> old").isEmpty()
        scratch.drop(labels)
        labels = new
        if changed:
            return new.select("id", "label")
    raise RuntimeError("labels still change")


def star_labels(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label): components of links (a, b) that are stars with a < b around a few centres per node.

    Each node keeps its smallest centre and ties its other centres to that one, so what is left to label are
    the centres alone. A node has at most as many centres as it has cells, so its list is short.
    """
    own = scratch.save(links.groupBy(F.col("b").alias("id")).agg(F.array_sort(F.collect_set("a")).alias("centres")))
    between = own.select(F.col("centres")[0].alias("a"), F.explode(F.slice("centres", F.lit(2), F.size("centres"))).alias("b")).distinct()
    # a node may itself be a centre: its link to its own centre holds between centres, too
    centres = scratch.save(minimum_labels(between.unionByName(own.select(F.col("centres")[0].alias("a"), F.col("id").alias("b")).join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi")), scratch))
    first = own.select("id", F.col("centres")[0].alias("centre"))
    named = centres.select(F.col("id").alias("centre"), F.col("label").alias("far"))
    nodes = first.join(named, "centre", "left").select("id", F.coalesce("far", "centre").alias("label"))
    roots = links.select(F.col("a").alias("id")).distinct().join(own.select("id"), "id", "left_anti")
    return scratch.save(nodes.unionByName(roots.join(centres, "id", "left").select("id", F.coalesce("label", "id").alias("label"))))


def clusters(df: DataFrame, key: str, features: list[str], threshold: float, scratch: Scratch, grids: int | None = None) -> DataFrame:
    """(cluster_id, key): the records of all clusters of at least two distinct records.

    Two records are alike if the Pearson correlation of their profiles, over the features that are neither
    null nor NaN in both, is at least ``threshold``; alike records share a cluster, named by its smallest key.
    Repeated records count once, and one whose rows differ is alike to whatever any of them is alike to. An
    empty table has no clusters; other columns may have any name.
    """
    points = quantised_profiles(df, key, features)
    links = alike_links(points, threshold, scratch, grids)
    labels = star_labels(links.where("sure").select("a", "b"), scratch)
    # close calls matter only between different components
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    calls = links.where("NOT sure").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    calls = scratch.save(calls.where("la <> lb").distinct())
    if not calls.isEmpty():
        checked = scratch.save(exact_links(df, key, features, calls, threshold).join(calls, ["a", "b"]).select("a", "b", "la", "lb"))
        if not checked.isEmpty():
            joined = minimum_labels(checked.select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch).select(F.col("id").alias("label"), F.col("label").alias("to"))
            ends = checked.select(F.col("a").alias("id"), F.col("la").alias("label")).unionByName(checked.select(F.col("b").alias("id"), F.col("lb").alias("label")))
            every = labels.unionByName(ends.join(labels, "id", "left_anti")).distinct()
            labels = every.join(joined, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    keys = df.select(F.col(f"`{key}`").cast("string").alias("key")).where("key IS NOT NULL").distinct()
    members = scratch.save(keys.select(F.xxhash64("key").alias("id"), "key").join(labels, "id").select("label", "key"))
    names = members.groupBy("label").agg(F.min("key").alias("cluster_id"), F.count("*").alias("n")).where("n > 1")
    return members.join(names, "label").select("cluster_id", "key")


def cluster_report(df: DataFrame, key: str, features: list[str], members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, n_members, cell_members, typical): size and most typical members of each cluster.

    Typical are the first keys, in order, of the cell, of all cells by which the clusters are found, that holds
    most of the cluster's members. A member without a profile of its own is in no cell.
    """
    points = quantised_profiles(df, key, features).where("vec IS NOT NULL").groupBy("key").agg(F.max("vec").alias("vec"))
    axes = axes_for(points.select("vec").distinct().count())

    def own_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cell = _in_cells(_vectors(b.column(1)), axes, range(GRIDS[axes]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(cell)], names=["key", "cell"])

    cells = points.select("key", "vec").mapInArrow(own_cells, "key STRING, cell BIGINT").join(members, "key")
    counted = cells.groupBy("cluster_id", "cell").agg(F.count("*").alias("n"))
    densest = counted.groupBy("cluster_id").agg(F.max_by(F.struct("cell", "n"), F.struct("n", -F.col("cell"))).alias("d"))
    densest = densest.select("cluster_id", F.col("d.cell").alias("cell"), F.col("d.n").alias("cell_members"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("key"))
    some = cells.join(densest, ["cluster_id", "cell"]).withColumn("place", place).where(F.col("place") <= typical)
    named = some.groupBy("cluster_id", "cell_members").agg(F.array_sort(F.collect_list("key")).alias("typical"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n_members"))
    return size.join(named, "cluster_id").select("cluster_id", "n_members", "cell_members", "typical")
