"""Texts that look the same but differ in their characters, brought to one form.

The vocabulary of a corpus is held in tries. A token with suspect characters runs through its trie as a
weighted edit automaton in which look-alikes, width, joined and composed forms and invisible characters
cost nothing; the words reached within the allowed cost are its spellings, of which the cheapest, then the
most frequent is canonical. Tokens that reach no word are normalised by table.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.operators.segments import run_starts, whole_runs
from matrixloom.session import Scratch

# Letters of other scripts that have the shape of a Latin letter of the same case.
CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈԌԚԜаеорсухѕіјһԁԛԝ", "ABEKMHOPCTYXSIJGQWaeopcyxsijhdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρϲϳ", "ABEZHIKMNOPTYXoivpcj"))
ARMENIAN = dict(zip("ՍՕօսհ", "UOouh"))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN
# Hyphens of the same shape as the hyphen-minus, and line ends.
HYPHENS = "\u2010\u2011\ufe63\uff0d"
LINE_ENDS = "\u0085\u2028\u2029\x0b\x0c"
# Marks that are shown nowhere though they aren't of category Cf.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10)))


def _folded_char(c: str) -> str:
    """What one character reads as, before composition."""
    if c in UNSEEN or unicodedata.category(c) == "Cf":
        return ""
    if c in HYPHENS:
        return "-"
    if c in LINE_ENDS:
        return "\n"
    if c == "\t" or unicodedata.category(c) == "Zs":
        return " "
    kind = unicodedata.decomposition(c).partition(">")[0].lstrip("<")
    if kind in ("wide", "narrow") or 0xFB00 <= ord(c) <= 0xFB06 or 0xFB13 <= ord(c) <= 0xFB17:
        return "".join(LOOKALIKE.get(x, x) for x in unicodedata.normalize("NFKD", c))
    return "".join(LOOKALIKE.get(x, x) for x in unicodedata.normalize("NFD", c))


@functools.cache
def _tables() -> tuple[dict[str, str], str]:
    """{character: its reading} where they differ, and a pattern class of all characters that need attention.

    The class also has combining marks and conjoining letters: a text with none of its characters reads as
    it is written.
    """
    fold, special = {}, []
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0x20000 <= cp < 0x2F800:
            continue
        c = chr(cp)
        to = _folded_char(c)
        if to != c:
            fold[c] = to
        if unicodedata.normalize("NFC", to) != c or unicodedata.category(c)[0] == "M" or 0x1100 <= cp < 0x1200:
            special.append(cp)
    for c in "\t\x0b\x0c":
        fold[c] = _folded_char(c)
        special.append(ord(c))
    special.sort()
    ranges, first = [], special[0]
    for a, b in zip(special, [*special[1:], 0x110000]):
        if b != a + 1:
            ranges.append((first, a))
            first = b
    return fold, ranges


@functools.cache
def _special() -> re.Pattern:
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _tables()[1]) + "]")


def fold_text(text: str) -> str:
    """The reading of a text by table alone: equal for texts that a reader cannot tell apart.

    Letter case, line breaks, accents and the number of blanks are kept; ``\\r\\n`` is one line break.
    """
    if text.isascii() and "\t" not in text and "\r" not in text and "\x0b" not in text and "\x0c" not in text:
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not _special().search(text):
        return text
    fold = _tables()[0]
    return unicodedata.normalize("NFC", _special().sub(lambda m: fold.get(m[0], m[0]), unicodedata.normalize("NFC", text)))


class VocabularyTrie:
    """Words by their decomposed characters, searched by an automaton of weighted edits."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        node[""] = (word, n)

    def search(self, token: str, max_cost: int = 0) -> str | None:
        """The word of :meth:`best`, or None."""
        found = self.best(token, max_cost)
        return found[2] if found else None

    def best(self, token: str, max_cost: int = 0) -> tuple[int, int, str] | None:
        """(cost, -count, word): the cheapest, then most frequent, then smallest word within ``max_cost`` edits that do show.

        Moving to a look-alike, through a joined form or over an invisible character is free; another
        character, one too many or one too few costs 1 each.
        """
        fold = _tables()[0]
        states: dict[int, tuple[dict, int]] = {id(self.root): (self.root, 0)}

        def reach(to: dict, node: dict, cost: int) -> None:
            if cost <= max_cost and (id(node) not in to or to[id(node)][1] > cost):
                to[id(node)] = (node, cost)

        def skipped(at: dict) -> dict:
            """With vocabulary characters that the token lacks."""
            todo = list(at.values()) if max_cost else []
            while todo:
                node, cost = todo.pop()
                for c, child in node.items():
                    if c and cost < max_cost and (id(child) not in at or at[id(child)][1] > cost + 1):
                        at[id(child)] = (child, cost + 1)
                        todo.append((child, cost + 1))
            return at

        states = skipped(states)
        for c in unicodedata.normalize("NFD", token):
            reading = fold.get(c, c)
            if not reading:
                continue
            to: dict[int, tuple[dict, int]] = {}
            for node, cost in states.values():
                for way in {reading, c}:
                    end: dict | None = node
                    for x in way:
                        end = end.get(x) if end else None
                    if end is not None:
                        reach(to, end, cost)
                if max_cost:
                    reach(to, node, cost + 1)
                    for x, child in node.items():
                        if x:
                            reach(to, child, cost + 1)
            states = skipped(to)
            if not states:
                return None
        found = [(cost, -node[""][1], node[""][0]) for node, cost in states.values() if "" in node]
        return min(found) if found else None


def meeting_keys(word: str, max_cost: int) -> list[int]:
    """Numbers of the word's reading with up to ``max_cost`` characters left out, at any place.

    Two words within ``max_cost`` edits that show have one of them in common, wherever the edits are.
    """
    readings = {unicodedata.normalize("NFD", fold_text(word))}
    level = readings
    for _ in range(max_cost):
        level = {r[:i] + r[i + 1 :] for r in level for i in range(len(r))}
        readings = readings | level
    return [int.from_bytes(hashlib.blake2b(r.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for r in sorted(readings)]


#: A task sends its word counts on when it holds this many different tokens.
WORDS_HELD = 300_000
#: Keys of a trie, about, and parts into which the documents of one word are spread.
TRIE_KEYS, SPREAD = 2000, 16
_WORD = re.compile(r"\w(?:.*\w)?", re.S)
#: White space that reads like another one.
_BLANKS = "\t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class _Suspects(dict):
    """{token that isn't ASCII: its word if it has suspect characters, "" if all of it is punctuation, else None}."""

    def __missing__(self, token: str) -> str | None:
        if len(self) >= WORDS_HELD:
            self.clear()
        self[token] = out = "".join(_token_words(token)) if _special().search(token) else None
        return out


def scanned(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """One pass over the texts: (row, key, written, text, words) of every document, ``row`` a number of its own, and (word, n, suspect) of the corpus.

    ``written`` is a digest of the text; ``text`` and its suspect ``words`` are there only where some character may
    read like another. A word is a token between blanks without the punctuation around it; invisible characters
    are part of it. Words are counted within each task first. Null texts are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        suspects, key_type = _Suspects(), None

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for token, n in seen.items():
                word = None if token.isascii() else suspects[token]
                if word is None and (m := _WORD.search(token)):
                    words[m[0], False] += n
                elif word:
                    words[word, True] += n
            seen.clear()
            m = len(words)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, key_type), pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.string())), pa.array([w for w, _ in words], pa.string()),
                 pa.array(list(words.values()), pa.int64()), pa.array([s for _, s in words], pa.bool_())], names=names)

        names = ["row", "key", "written", "text", "words", "word", "n", "suspect"]
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            key_type = b.schema.field(0).type
            written, texts, own = [], [], []
            for s in b.column(1).to_pylist():
                tokens = s.split()
                seen.update(tokens)
                odd: list[str] | None = None
                if not s.isascii():
                    found = {suspects[t] for t in set(tokens) if not t.isascii()} - {None}
                    odd = sorted(found - {""}) if found else None
                if odd is None and any(c in s for c in _BLANKS):
                    odd = []
                written.append(hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest())
                texts.append(s if odd is not None else None)
                own.append(odd)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + m)), b.column(0), pa.array(written, pa.string()), pa.array(texts, pa.string()), pa.array(own, pa.list_(pa.string())), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_())],
                names=names,
            )
            row += m
            if len(seen) > WORDS_HELD:
                yield flush()
        if seen:
            yield flush()

    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    of = docs.schema[key].dataType.simpleString()
    return scratch.save(named.mapInArrow(run, f"row BIGINT, key {of}, written STRING, text STRING, words ARRAY<STRING>, word STRING, n BIGINT, suspect BOOLEAN"))


def _token_words(token: str) -> list[str]:
    """The suspect token's word: without punctuation around it, invisible characters kept."""
    m = _edges().search(token)
    return [m[0]] if m else []


@functools.cache
def _edges() -> re.Pattern:
    inside = r"[\w" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _tables()[1]) + "]"
    return re.compile(f"{inside}(?:.*{inside})?", re.S)


def canonical_spellings(words: DataFrame, max_cost: int = 0) -> DataFrame:
    """(word, n, spelling) of every suspect word: through the tries of the vocabulary, else by table.

    ``words``: (word, n, suspect), counts to be added up. Words and suspects meet in a trie through their
    readings with up to ``max_cost`` characters left out, so no word within reach is elsewhere and no trie
    depends on a word's beginning; only words that share such a key with a suspect are in a trie at all.
    """
    total = words.groupBy("word", "suspect").agg(F.sum("n").alias("n"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [meeting_keys(w, max_cost) for w in b.column(0).to_pylist()]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.int64()), *[b.column(i).take(at) for i in range(3)]], names=["meet", "word", "n", "suspect"])

    rows = total.select("word", "n", "suspect").mapInArrow(keyed, "meet BIGINT, word STRING, n BIGINT, suspect BOOLEAN")
    asked = rows.where("suspect")
    near = rows.where("NOT suspect").join(asked.select("meet").distinct(), "meet", "left_semi")
    shards = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8
    both = asked.unionByName(near).withColumn("shard", F.pmod("meet", F.lit(shards)).cast("int")).select("shard", "suspect", "word", "n").distinct()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "shard", TRIE_KEYS):
            word, n, sus = t.column("word").to_pylist(), t.column("n").to_pylist(), np.array(t.column("suspect").to_pylist(), bool)
            starts = run_starts(t.column("shard").combine_chunks().to_numpy())
            out: list[tuple] = []
            for a, b in zip(starts[:-1], starts[1:]):
                trie = VocabularyTrie()
                for i in range(a, b):
                    if not sus[i]:
                        trie.add(word[i], n[i])
                out += [(word[i], n[i], *(trie.best(word[i], max_cost) or (None, None, None))) for i in range(a, b) if sus[i]]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, ty) for c, ty in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["word", "n", "cost", "less", "spelling"]
            )

    found = both.repartition("shard").sortWithinPartitions("shard", "suspect", "word").mapInArrow(spell, "word STRING, n BIGINT, cost INT, less BIGINT, spelling STRING")
    best = F.min(F.when(F.col("spelling").isNotNull(), F.struct("cost", "less", "spelling"))).alias("b")

    def by_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [s if s is not None else fold_text(w) for w, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(told, pa.string())], names=["word", "n", "spelling"])

    return found.groupBy("word").agg(F.max("n").alias("n"), best).select("word", "n", "b.spelling").mapInArrow(by_table, "word STRING, n BIGINT, spelling STRING")


def canonical_texts(docs: DataFrame, key: str, text: str, scratch: Scratch, max_cost: int = 0, scan: DataFrame | None = None) -> DataFrame:
    """(key, text, canonical) of the texts with suspect characters; every other text reads as it is.

    Every blank becomes a space and every line end a line feed; words are replaced by their canonical
    spelling. Two texts have equal canonical forms exactly if they read the same (with ``max_cost`` 0).
    Null texts are left out, empty ones are not suspect. Rows that repeat a key are texts of their own.
    Other columns of ``docs`` may have any name.
    """
    scan = scanned(docs, key, text, scratch) if scan is None else scan
    spelling = scratch.save(canonical_spellings(scan.where("word IS NOT NULL").select("word", "n", "suspect"), max_cost).select("word", "spelling"))
    odd = scan.where("text IS NOT NULL").select("row", "key", "text", "words")
    # a word that many documents have is spread over SPREAD parts
    asked = odd.select("row", F.pmod("row", F.lit(SPREAD)).cast("int").alias("part"), F.explode("words").alias("word"))
    told = spelling.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    pairs = asked.join(told, ["word", "part"]).groupBy("row").agg(F.collect_list(F.struct("word", "spelling")).alias("words"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, words in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                of_word = {w["word"]: w["spelling"] for w in words or ()}

                def token(m: re.Match, of_word: dict = of_word) -> str:
                    t = m[0]
                    if t.isascii():
                        return t
                    e = _edges().search(t)
                    if not e or e[0] not in of_word:
                        return fold_text(t)
                    return fold_text(t[: e.start()]) + of_word[e[0]] + fold_text(t[e.end() :])

                spelled = re.sub(r"\S+", token, s)
                out.append(fold_text(spelled))  # blanks, line ends and what composes across the seams
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["key", "text", "canonical"])

    of = docs.schema[key].dataType.simpleString()
    done = odd.select("row", "key", "text").join(pairs, "row", "left").select("key", "text", "words").mapInArrow(rewrite, f"key {of}, text STRING, canonical STRING")
    return scratch.save(done)


def readings(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """(key, written, reading): digests of each text as it is written and as it reads."""
    scan = scanned(docs, key, text, scratch)
    odd = canonical_texts(docs, key, text, scratch, scan=scan).select("key", F.md5("text").alias("written"), F.md5("canonical").alias("reading"))
    plain = scan.where("written IS NOT NULL AND text IS NULL").select("key", "written", F.col("written").alias("reading"))
    return odd.unionByName(plain)


def look_alike_classes(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """(key, reading, written) of the texts that read like a differently written one.

    Copies of one string are no look-alikes of each other; they are in the result only beside another string.
    """
    read = scratch.save(readings(docs, key, text, scratch))
    variants = read.groupBy("reading", "written").agg(F.count("*").alias("copies"))
    mixed = variants.groupBy("reading").agg(F.count("*").alias("n_variants")).where("n_variants > 1").select("reading")
    return read.join(mixed, "reading", "left_semi").select("key", "reading", "written")


def look_alike_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): keys of differently written texts of one class, a < b.

    The different strings of a class are paired first, then their copies: no pair of equal strings is
    ever made.
    """
    strings = classes.select("reading", "written").distinct()
    two = strings.join(strings.withColumnRenamed("written", "other"), "reading").where("written < other")
    left = two.join(classes.select("reading", "written", F.col("key").alias("x")), ["reading", "written"])
    both = left.join(classes.select("reading", F.col("written").alias("other"), F.col("key").alias("y")), ["reading", "other"])
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def look_alike_links(classes: DataFrame) -> DataFrame:
    """(key, class_key, n_strings, n_links): for each text of a class the class, by its smallest key, its different strings, and the texts that read the same but are written differently."""
    strings = classes.groupBy("reading", "written").agg(F.count("*").alias("copies"), F.min("key").alias("first"))
    whole = strings.groupBy("reading").agg(F.sum("copies").alias("texts"), F.count("*").alias("n_strings"), F.min("first").alias("class_key"))
    per = strings.join(whole, "reading").select("reading", "written", "class_key", "n_strings", (F.col("texts") - F.col("copies")).alias("n_links"))
    return classes.join(per, ["reading", "written"]).select("key", "class_key", "n_strings", "n_links")
