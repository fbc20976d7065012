"""Size-matched random gene sets and comparisons against them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrixloom.operators.stats import empirical_p, z_against
from matrixloom.session import Scratch


#: Sets that are drawn side by side in each repeat at most.
MAX_DRAWN = 10_000


def ranked_draws(genes: DataFrame, repeats: int, seed: int = 42) -> DataFrame:
    """(repeat, gene, place): the genes in an order of their own in each repeat, that of a seeded digest.

    The first n genes of a repeat are n genes drawn without replacement; any engine draws the same ones. The
    universe of genes times the repeats is ranked, nothing larger.
    """
    draws = genes.select("gene").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col("gene")))
    return draws.withColumn("place", F.row_number().over(Window.partitionBy("repeat").orderBy(digest, "gene")))


def wanted_sizes(sizes: DataFrame) -> list[tuple[str, int]]:
    """(name, size) of the sets to draw; programs are a short list, more than MAX_DRAWN raise ValueError."""
    wanted = sorted((r["name"], r["size"]) for r in sizes.select("name", "size").limit(MAX_DRAWN + 1).collect())
    if len(wanted) > MAX_DRAWN:
        raise ValueError(f"more than {MAX_DRAWN} sets to draw")
    return wanted


def random_sets(genes: DataFrame, sizes: DataFrame, repeats: int, seed: int = 42) -> DataFrame:
    """(name, repeat, gene): for each (name, size) and repeat that many genes of :func:`ranked_draws`.

    All sets of one repeat share the draw's order: a smaller set is the beginning of a larger one.
    """
    wanted = wanted_sizes(sizes)
    ranked = ranked_draws(genes, repeats, seed).where(F.col("place") <= max((n for _, n in wanted), default=0))
    names = F.array(*[F.when(F.col("place") <= n, F.lit(name)) for name, n in wanted]) if wanted else F.array().cast("array<string>")
    return ranked.select(F.explode(F.array_compact(names)).alias("name"), "repeat", "gene")


def _sizes(bridge: DataFrame) -> list[tuple[str, int]]:
    return wanted_sizes(bridge.groupBy(F.col("program").alias("name")).agg(F.count("*").alias("size")))


def detection_null(bridge: DataFrame, universe: DataFrame, detected: DataFrame, repeats: int, seed: int = 42) -> DataFrame:
    """(condition, program, observed, random_mean, p, z): share of a program's genes detected, against random sets of its size.

    ``detected``: (condition, gene). The sets of a repeat are beginnings of one order, so each detected gene is
    counted once for all of them; a set without any detected gene counts as 0.
    """
    wanted = _sizes(bridge)
    seen = detected.select("condition", "gene").distinct()
    own = bridge.join(seen, "gene").groupBy("condition", F.col("program").alias("name")).agg(F.count("*").alias("hits"))
    size = bridge.groupBy(F.col("program").alias("name")).agg(F.count("*").alias("size"))
    every = seen.select("condition").distinct().crossJoin(size)  # every condition x every program is the result
    observed = every.join(own, ["condition", "name"], "left").select("condition", "name", (F.coalesce("hits", F.lit(0)) / F.col("size")).alias("observed"))
    draws = ranked_draws(universe, repeats, seed)
    counted = draws.join(seen, "gene").groupBy("condition", "repeat").agg(*[F.count_if(F.col("place") <= n).alias(f"h{i}") for i, (_, n) in enumerate(wanted)])
    grid = seen.select("condition").distinct().crossJoin(draws.select("repeat").distinct()).join(counted, ["condition", "repeat"], "left")
    shares = F.array(*[F.struct(F.lit(name).alias("name"), (F.coalesce(f"h{i}", F.lit(0)) / n).alias("share")) for i, (name, n) in enumerate(wanted)])
    drawn = grid.select("condition", F.explode(shares).alias("s")).select("condition", "s.*")
    j = drawn.join(observed, ["condition", "name"])
    return j.groupBy("condition", F.col("name").alias("program")).agg(
        F.max("observed").alias("observed"), F.avg("share").alias("random_mean"), empirical_p(F.round("observed", 9), F.round("share", 9)).alias("p"),
        z_against(F.col("observed"), F.col("share")).alias("z"),
    )


def abundance_metrics(values: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """Per set: mean, maximum, mean of the top three, population variance of its items' values, and the top item."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), item)
    r = values.withColumn("rn", F.row_number().over(w))
    return r.groupBy(*by).agg(
        F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.avg(F.when(F.col("rn") <= 3, F.col(value))).alias("top3_mean"),
        F.var_pop(value).alias("var_value"), F.max(F.when(F.col("rn") == 1, F.col(item))).alias("top_item"),
    )


#: Repeats and values that one task of :func:`abundance_null` holds.
TASK_REPEATS = 50
TASK_VALUES = 1_000_000
_PARTS = "name STRING, repeat INT, bucket INT, n BIGINT, total DOUBLE, squares DOUBLE, top ARRAY<DOUBLE>"


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Each row's place in the list of different values, and that list; null is a value."""
    c = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    return c.indices.to_numpy(zero_copy_only=False), c.dictionary.to_pylist()


def _first_sets(genes: list[str | None], sizes: np.ndarray, repeat: int, seed: int) -> np.ndarray:
    """For each gene (in order) the first of the ascending sizes whose set holds it in the order of :func:`ranked_draws`, else their number."""
    head = f"{seed}|{repeat}"
    digests = b"".join(md5((head if g is None else f"{head}|{g}").encode(), usedforsecurity=False).digest() for g in genes)
    halves = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
    first = np.empty(len(genes), np.int64)
    first[np.lexsort((halves[:, 1], halves[:, 0]))] = np.searchsorted(sizes, np.arange(1, len(genes) + 1))
    return first


def _even(values: np.ndarray, tissue: np.ndarray) -> np.ndarray:
    """The values as multiples of a power of two so large that a tissue's sums are exact in any order: equal sets tie."""
    most = np.bincount(tissue, np.abs(values)).max(initial=0.0)
    if not 1e-200 < most < 1e200:
        return values
    unit = 2.0 ** (np.ceil(np.log2(most)) - 51)
    return np.round(values / unit) * unit


def _over_tissues(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[float]]]:
    """Of each column (a set): tissues with a value, total, squared distances from the mean and the top three of their means."""
    with np.errstate(all="ignore"):
        has, score = counts > 0, sums / counts
        n = has.sum(0)
        total = np.where(has, score, 0.0).sum(0)
        squares = np.where(has, (score - total / n) ** 2, 0.0).sum(0)
    down = np.where(has, -score, np.inf)
    top = -np.sort(np.partition(down, 2, axis=0)[:3] if len(down) > 3 else down, axis=0)
    return n, total, squares, [top[: min(3, k), i].tolist() for i, k in enumerate(n)]


def _set_scores(wanted: list[tuple[str, int]], repeats: int, at_once: int, seed: int):
    """A ``mapInArrow`` function: the rows of one bucket of tissues and one block of repeats become a row for each set and repeat."""
    sizes = np.unique(np.array([n for _, n in wanted], np.int64))
    names = [name for name, _ in wanted]
    of = np.searchsorted(sizes, [n for _, n in wanted]).astype(np.int64)

    def told(bucket: int, repeat: int, who: list[str], at: np.ndarray, figures: tuple) -> pa.RecordBatch:
        n, total, squares, top = figures
        kept = [k for k in range(len(who)) if n[at[k]]]
        i = at[kept]
        columns = [pa.array([who[k] for k in kept], pa.string()), pa.array([repeat] * len(kept), pa.int32()), pa.array([bucket] * len(kept), pa.int32())]
        columns += [pa.array(n[i], pa.int64()), pa.array(total[i], pa.float64()), pa.array(squares[i], pa.float64()), pa.array([top[x] for x in i], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["name", "repeat", "bucket", "n", "total", "squares", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        bucket, block = (t.column(c)[0].as_py() for c in ("bucket", "block"))
        kind = t.column("kind")
        drawn, own, rows = (t.filter(pc.equal(kind, k)) for k in ("drawn", "own", "value"))
        if not rows.num_rows:
            return
        genes = sorted(drawn.column("gene").to_pylist(), key=lambda g: (g is not None, (g or "").encode()))
        place = {g: i for i, g in enumerate(genes)}
        tissue, tissues = _coded(rows.column("tissue"))
        gene, known = _coded(rows.column("gene"))
        value = _even(rows.column("value").to_numpy(), tissue)
        if block == 0:
            code = {g: i for i, g in enumerate(known)}
            members: dict[str, list[int]] = {}
            for name, g in zip(own.column("name").to_pylist(), own.column("gene").to_pylist()):
                if g in code:
                    members.setdefault(name, []).append(code[g])
            for name, codes in members.items():
                inside = np.zeros(len(known), bool)
                inside[codes] = True
                mine = inside[gene]
                sums, counts = np.bincount(tissue[mine], value[mine], len(tissues)), np.bincount(tissue[mine], minlength=len(tissues))
                yield told(bucket, -1, [name], np.array([0]), _over_tissues(sums[:, None], counts[:, None]))
        among = np.array([place.get(g, -1) for g in known], np.int64)[gene]
        tissue, value, among = tissue[among >= 0], value[among >= 0], among[among >= 0]
        at, shape = tissue * (len(sizes) + 1), (len(tissues), len(sizes) + 1)
        for repeat in range(block * at_once, min(repeats, (block + 1) * at_once)):
            cell = at + _first_sets(genes, sizes, repeat, seed)[among]
            sums, counts = (np.bincount(cell, w, shape[0] * shape[1]).reshape(shape)[:, :-1].cumsum(1) for w in (value, None))
            yield told(bucket, repeat, names, of, _over_tissues(sums, counts))

    return run


def abundance_null(bridge: DataFrame, universe: DataFrame, abundance: DataFrame, repeats: int, seed: int = 42) -> DataFrame:
    """(program, metric, observed, random_mean, p, z) for the four abundance metrics over tissues.

    ``abundance``: (tissue, gene, value). A set's value in a tissue is the mean over its genes that have one.

    The values are cut into buckets of whole tissues and go with all genes to a task for each bucket and block of
    repeats, which draws the order of the genes itself and counts each value once for all sets: no draws are exchanged.
    The inputs are read several times, so they should be stored tables.
    """
    values = abundance.where("value IS NOT NULL")
    wanted = _sizes(bridge)
    n, tissues = values.agg(F.count("*"), F.approx_count_distinct("tissue")).first()
    buckets = max(1, -(-n // TASK_VALUES), -(-tissues * len({size for _, size in wanted}) // (4 * TASK_VALUES)))
    blocks = -(-repeats // TASK_REPEATS)
    void = F.lit(None)
    row = lambda kind, bucket, gene, name, tissue, value: [F.lit(kind).alias("kind"), bucket.alias("bucket"), gene.alias("gene"), name.cast("string").alias("name"), tissue.cast("string").alias("tissue"), value.cast("double").alias("value")]
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    rows = universe.select("gene").distinct().select(*row("drawn", every, F.col("gene"), void, void, void))
    rows = rows.unionByName(bridge.select(*row("own", every, F.col("gene"), F.col("program"), void, void)))
    rows = rows.unionByName(values.select(*row("value", F.pmod(F.xxhash64("tissue"), F.lit(buckets)).cast("int"), F.col("gene"), void, F.col("tissue"), F.col("value"))))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("kind <> 'own' OR block = 0")
    parts = rows.repartitionById(buckets * blocks, F.col("bucket") * blocks + F.col("block")).mapInArrow(_set_scores(wanted, repeats, TASK_REPEATS, seed), _PARTS)
    m = Scratch(values.sparkSession, "null-sets").save(parts).groupBy("name", "repeat").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "total", "squares", "top"))).alias("b"))
    added = lambda f, zero: F.aggregate("b", zero, lambda a, x: a + f(x))
    m = m.select("name", "repeat", "b", added(lambda x: x.n, F.lit(0).cast("bigint")).alias("n"), added(lambda x: x.total, F.lit(0.0)).alias("total"))
    m = m.withColumn("mean_value", F.col("total") / F.col("n")).withColumn("top", F.slice(F.sort_array(F.flatten("b.top"), asc=False), 1, 3))
    apart = added(lambda x: x.squares + x.n * F.pow(x.total / x.n - F.col("mean_value"), F.lit(2.0)), F.lit(0.0))
    m = m.withColumns({
        "max_value": F.get("top", F.lit(0)), "top3_mean": F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.size("top"), "var_value": apart / F.col("n"),
    })
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in ("mean_value", "max_value", "top3_mean", "var_value")])).alias("k")
    long = m.select("name", "repeat", kinds).select("name", "repeat", "k.metric", "k.v")
    observed = long.where("repeat = -1").select("name", "metric", F.col("v").alias("observed"))
    j = long.where("repeat >= 0").join(observed, ["name", "metric"])
    return j.groupBy(F.col("name").alias("program"), "metric").agg(
        F.max("observed").alias("observed"), F.avg("v").alias("random_mean"), empirical_p(F.col("observed"), F.col("v")).alias("p"), z_against(F.col("observed"), F.col("v")).alias("z")
    )
