"""Freely entered values mapped to the entries of a reference list, through a BK-tree.

The tree holds the reference spellings under the unrestricted Damerau-Levenshtein distance, a true metric
(insert, delete, replace and swap of neighbours cost 1 each), so the triangle inequality prunes and a search
returns every entry within the threshold. A small reference list goes to every task; a larger one is split
into shards, each value is asked of all shards, and the shards' winners are merged to what one tree would answer.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.session import Scratch

#: Reference entries, and characters of them, that are sent to every task at most; more are sharded.
MAX_BROADCAST, MAX_CHARS = 50_000, 8 << 20
#: Words of which every order is tried; more are tried in their own and in alphabetical order.
ANY_ORDER = 3
#: Values that may be split over several tasks at most, each a share of the records greater than one in as many.
HOT_VALUES = 10_000
#: Records with one value from which they are split.
SPLIT_ROWS = 1_000_000
# Fixed value: what a value pays for each word that belongs to no entry.
DROPPED_WORD = 0.5


def damerau(a: str, b: str, most: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance; where it exceeds ``most``, some number above ``most``."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    big = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[big] * (len(b) + 2)]
    d.append([big, *range(len(b) + 1)])
    for i, x in enumerate(a, 1):
        row, above, match = [big, i], d[i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                cost, match = 0, j
            else:
                cost = 1
            row.append(min(above[j] + cost, row[j] + 1, above[j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        last[x] = i
        d.append(row)
    return d[-1][-1]


class BKTree:
    """Words by their distance to their parent."""

    def __init__(self, words: Iterable[str] = ()) -> None:
        self.root: tuple[str, dict] | None = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            d = damerau(word, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (word, {})
                return
            node = node[1][d]

    def within(self, word: str, radius: int) -> list[tuple[int, str]]:
        """(distance, entry) of every entry within ``radius``."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            w, children = todo.pop()
            d = damerau(word, w)
            if d <= radius:
                found.append((d, w))
            todo += [c for at, c in children.items() if d - radius <= at <= d + radius]
        return found


def words_of(value: str) -> tuple[list[str], list[bool]]:
    """The words of a value without case, accents and punctuation, and which are cut short by a full stop."""
    text = "".join(c for c in unicodedata.normalize("NFKD", value).casefold() if not unicodedata.combining(c))
    found = [(m[1], bool(m[2])) for m in re.finditer(r"([^\W_]+)(\.)?", text)]
    return [w for w, _ in found], [s for _, s in found]


def radius_of(length: int, whole: bool) -> int:
    """Edits allowed: 1 up to 5 letters, 2 up to 8 (1 where words were dropped), else 3 (2)."""
    return 1 if length <= 5 else (2 if whole else 1) if length <= 8 else 3 if whole else 2


class Reference:
    """The entries of one field: every spelling (canonical name and aliases) leads to its entry.

    ``max_words`` is the number of words of the longest spelling in the whole list, of which this may be a shard.
    """

    def __init__(self, entries: list[tuple[int, str, str | None]], max_words: int = 1) -> None:
        self.entry: dict[str, int] = {}
        self.in_order: dict[str, int] = {}
        self.begun: dict[tuple[int, int, str], set[tuple[str, ...]]] = defaultdict(set)
        self.max_words = max_words
        for term, name, aliases in sorted(entries, key=lambda e: (e[0], e[1], e[2] or "")):
            for spelling in spellings(name, aliases):
                words, _ = words_of(spelling)
                if words:
                    self.entry.setdefault("".join(words), term)
                    self.max_words = max(self.max_words, len(words))
                    if len(words) > ANY_ORDER:
                        self.in_order.setdefault("".join(sorted(words)), term)
                    for i, w in enumerate(words):
                        for n in range(2, len(w)):
                            self.begun[len(words), i, w[:n]].add(tuple(words))
        self.trees = {False: BKTree(self.entry), True: BKTree(self.in_order)}
        self.lengths = {d: (min(map(len, keys)), max(map(len, keys))) for d, keys in ((False, self.entry), (True, self.in_order)) if keys}
        self.sizes = sorted({len(k) for k in self.entry if len(k) >= 5}, reverse=True)
        self.known: dict[tuple[str, int, bool], list[tuple[int, str]]] = {}

    def within(self, key: str, radius: int, in_order: bool = False) -> list[tuple[int, str]]:
        """The tree's answer, kept for keys that come again."""
        least, most = self.lengths.get(in_order, (1, 0))
        if not least - radius <= len(key) <= most + radius:
            return []
        at = key, radius, in_order
        if at not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[at] = self.trees[in_order].within(key, radius)
        return self.known[at]

    def spelled_out(self, part: list[str], short: list[bool]) -> Iterator[tuple[int, str]]:
        """(distance, entry) of the entries of as many words, of which those cut short are begun and the others are off by one edit at most."""
        for words in self.begun.get((len(part), short.index(True), part[short.index(True)]), ()):
            if all(w.startswith(p) and len(w) > len(p) for p, w, s in zip(part, words, short) if s):
                d = sum(damerau(p, w, 1) for p, w, s in zip(part, words, short) if not s)
                if d <= 1:
                    yield d, "".join(words)

    def best(self, value: str) -> tuple[bool, float, int] | None:
        """(written on, cost, term) of the entry that is meant, the cheapest and then the smallest term; None if there is none.

        The value's words count as a whole or as any run of neighbouring words, runs of up to three in any order,
        with words cut short by a full stop spelled out where an entry has such a word. An entry with something
        written on counts only where no other is found.
        """
        words, short = words_of(value)
        found: tuple[float, int] = (9e9, 0)
        most = min(len(words), max(self.max_words + 1, 2))
        spans = {(a, n) for n in range(1, most + 1) for a in range(len(words) - n + 1)} | ({(0, len(words))} if words else set())
        for a, n in sorted(spans, key=lambda x: -x[1]):
            dropped = len(words) - n
            if found[0] < DROPPED_WORD * dropped:
                continue
            part = words[a : a + n]
            if sum(map(len, part)) < 3 and not dropped == 0 or sum(map(len, part)) < 2:
                continue
            whole = dropped == 0
            for order in itertools.permutations(part) if n <= ANY_ORDER else [tuple(part)]:
                key = "".join(order)
                moved = 0.1 * (order != tuple(part))
                for d, w in self.within(key, radius_of(len(key), whole)):
                    if d < len(key) - 1:
                        found = min(found, (d + DROPPED_WORD * dropped + moved, self.entry[w]))
            if n > ANY_ORDER:
                key = "".join(sorted(part))
                for d, w in self.within(key, radius_of(len(key), whole), True):
                    found = min(found, (d + DROPPED_WORD * dropped + 0.1, self.in_order[w]))
            if any(short[a : a + n]) and n > 1:
                for d, w in self.spelled_out(part, short[a : a + n]):
                    found = min(found, (d + 0.25 + DROPPED_WORD * dropped, self.entry[w]))
        if found[0] < 9e9:
            return (False, *found)
        key = "".join(words)
        on = [self.entry[part] for n in self.sizes if n < len(key) for part in (key[:n], key[-n:]) if part in self.entry]
        return (True, 2.0, min(on)) if on else None


def spellings(name: str, aliases: str | None) -> list[str]:
    """The canonical name and the aliases of an entry."""
    return [name or "", *re.split(r"\s*;\s*", aliases or "")]


def _answers(asked: list[tuple[str, str]], refs: dict[str, Reference]) -> pa.RecordBatch:
    out = []
    for field, value in asked:
        best = refs[field].best(value) if field in refs else None
        if best:
            out.append((field, value, *best))
    cols = list(zip(*out)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.int64()))], names=["field_name", "value", "written_on", "cost", "term_id"])


def _references(rows: Iterable[tuple[str, int, str, str | None]], max_words: int) -> dict[str, Reference]:
    by_field = defaultdict(list)
    for field, term, name, aliases in rows:
        by_field[field].append((term, name, aliases))
    return {f: Reference(e, max_words) for f, e in by_field.items()}


def _size(known: DataFrame) -> tuple[int, int, int]:
    """Entries, their characters, and the words of the longest spelling."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            words = [max(len(words_of(s)[0]) for s in spellings(*r)) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([len(n) + len(a or "") for n, a in rows], pa.int64()), pa.array(words, pa.int32())], names=["chars", "words"])

    n, chars, words = known.select("canonical_name", "known_aliases").mapInArrow(measured, "chars BIGINT, words INT").agg(F.count("*"), F.sum("chars"), F.max("words")).first()
    return n, chars or 0, words or 1


def match_values(values: DataFrame, terms: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(field_name, value, cost, term_id) of the distinct ``values`` (field_name, value) that an entry of the field is meant by.

    ``terms``: term_id, field_name, canonical_name, known_aliases (joined by ``;``). Values that stand for no
    entry, such as blank ones, have no row. Terms with a null id, field or name are not asked. The answers are
    the same however many shards there are.
    """
    schema = "field_name STRING, value STRING, written_on BOOLEAN, cost DOUBLE, term_id BIGINT"
    asked = values.select("field_name", "value").where("field_name IS NOT NULL AND value IS NOT NULL")
    known = terms.select("field_name", F.col("term_id").cast("bigint").alias("term_id"), "canonical_name", "known_aliases")
    known = known.where("field_name IS NOT NULL AND term_id IS NOT NULL AND canonical_name IS NOT NULL")
    n, chars, max_words = _size(known)
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    if n <= max_broadcast and chars <= MAX_CHARS:
        rows = [tuple(r) for r in known.collect()]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            refs = _references(rows, max_words)
            for b in batches:
                yield _answers(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), refs)

        return asked.repartition(tasks, "field_name", "value").mapInArrow(ask, schema).select("field_name", "value", "cost", "term_id")

    shards = max(-(-n // max_broadcast), -(-chars // MAX_CHARS))
    one = known.select(F.pmod(F.xxhash64("canonical_name"), F.lit(shards)).cast("int").alias("shard"), "field_name", "term_id", "canonical_name", "known_aliases")
    sharded = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    spread = asked.withColumn("salt", F.pmod(F.xxhash64("field_name", "value"), F.lit(tasks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1).cast("int"))))

    def shard(left: pa.Table, right: pa.Table) -> pa.Table:
        refs = _references(zip(*(right.column(c).to_pylist() for c in ("field_name", "term_id", "canonical_name", "known_aliases"))), max_words)
        return pa.Table.from_batches([_answers(list(zip(left.column("field_name").to_pylist(), left.column("value").to_pylist())), refs)])

    won = spread.groupBy("shard", "salt").cogroup(sharded.groupBy("shard", "salt")).applyInArrow(shard, schema)
    best = won.groupBy("field_name", "value").agg(F.min(F.struct("written_on", "cost", "term_id")).alias("b"))
    return best.select("field_name", "value", "b.cost", "b.term_id")


def canonical_entries(records: DataFrame, key: str, fields: list[str], terms: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(key, field_name, value, term_id) of every record and field whose value is not null and no canonical name of the field.

    term_id is -1 where no entry of the field is meant. A repeated record counts once per field, with its
    greatest value. Each different value is searched once however many records have it; a value that a third
    of all records share costs one search. Blank values are values that mean no entry. Records with a null
    key are one record. Other columns may have any name.
    """
    one = records.select(
        F.col(f"`{key}`").alias("key"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])).alias("e"),
    ).select("key", "e.field_name", "e.value").where("value IS NOT NULL")
    names = terms.select("field_name", F.col("canonical_name").alias("value")).distinct()
    free = one.join(names, ["field_name", "value"], "left_anti").groupBy("key", "field_name").agg(F.max("value").alias("value"))
    scratch = Scratch(records.sparkSession, "entries")
    free = scratch.save(free)
    per = scratch.save(free.groupBy("field_name", "value").agg(F.count("*").alias("n")))
    # a value of many records is split; those that are number HOT_VALUES at most, whatever the table
    share = max(SPLIT_ROWS, (per.agg(F.sum("n")).first()[0] or 0) // HOT_VALUES)
    hot = per.where(F.col("n") > share).select(F.xxhash64("field_name", "value").alias("h"), F.ceil(F.col("n") / F.lit(share)).cast("int").alias("salts"))
    matched = match_values(per, terms, max_broadcast).withColumn("h", F.xxhash64("field_name", "value")).join(F.broadcast(hot), "h", "left")
    matched = matched.select("field_name", "value", "term_id", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    salted = free.withColumn("h", F.xxhash64("field_name", "value")).join(F.broadcast(hot), "h", "left")
    salted = salted.select(F.col("key"), "field_name", "value", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    return salted.join(matched, ["field_name", "value", "salt"], "left").select(
        "key", "field_name", "value", F.coalesce("term_id", F.lit(-1)).cast("bigint").alias("term_id")
    )
