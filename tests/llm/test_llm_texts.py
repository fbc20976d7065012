"""Leaks and look-alikes against plain readers."""

from __future__ import annotations

import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from matrixloom.llm import leak, lookalike


# leaks ------------------------------------------------------------------------------------------------------
def brute_tiles(item, doc, k):
    """Greedy string tiling by comparing every position with every other."""
    im, dm, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not im[i + n] and not dm[d + n]:
                    n += 1
                if (n, -i, -d) > (best[0], -best[1], -best[2]):
                    best = (n, i, d)
        if best[0] < k:
            return tiles
        n, i, d = best
        im[i : i + n] = dm[d : d + n] = [True] * n
        tiles.append(best)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(14)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(4, 30)))) for i in range(8)] + [(50, None), (51, ""), (0, None)]
    docs = []
    for d in range(60):
        text = [rng.choice(words + ["zz", "yy"]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            part = items[rng.randrange(8)][1].split()
            a = rng.randrange(len(part))
            at = rng.randrange(len(text) + 1)
            text[at:at] = part[a : a + rng.randint(1, 20)]
        docs.append((d, ("  ,\n".join(text)).upper() if d % 2 else " ".join(text)))
    docs += [(100, None), (101, ""), (102, " ".join(["w1"] * 3000)), docs[0]]
    df = spark.createDataFrame(docs, "doc_id INT, text STRING").selectExpr("*", "'c' AS pos", "1 AS item")
    it = spark.createDataFrame(items, "item_id INT, item_text STRING").selectExpr("*", "'c' AS doc")
    got = {(r.doc, r.item): r for r in leak.leaks(df, it, min_words=5).collect()}
    expect = {}
    for d, t in docs[:-1]:
        if d == 102:
            continue
        for i, x in items[:8]:
            tiles = brute_tiles(x.split(), re.findall(r"\w+", (t or "").lower()), 5)
            if tiles:
                expect[(d, i)] = tiles
    assert {k for k in got if k[0] != 102} == set(expect)
    for k, tiles in expect.items():
        assert got[k].longest == max(n for n, _, _ in tiles) and got[k].covered == sum(n for n, _, _ in tiles)
    assert leak.leaks(df.where("false"), it).count() == 0 and leak.leaks(df, it.where("false")).count() == 0


def test_disguised_and_reordered_passages(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    w = item.split()
    docs = [(1, "One TWO, three\nfour f​ive six ｓｅｖｅｎ eight nine ten е".replace("е", "") + "leven twelve"), (2, " ".join(w[:11])), (3, " ".join(w[7:] + ["x"] + w[:7])), (4, "twо".join(["one ", " "]) + " ".join(w[2:]))]
    it = spark.createDataFrame([(5, item)], "item_id INT, item_text STRING")
    df = spark.createDataFrame(docs, "doc_id INT, text STRING")
    got = {r.doc: r for r in leak.leaks(df, it, min_words=6).collect()}
    assert got[3].reordered and got[3].n_tiles == 2 and got[3].coverage == 1.0
    assert got[4].covered == 14 and not got[4].reordered and got[2].longest == 11


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    it = spark.createDataFrame([(i, " ".join(f"a{i}b{j}" for j in range(40))) for i in range(200)], "item_id INT, item_text STRING")
    df = spark.createDataFrame([(i, "x " + " ".join(f"a{i}b{j}" for j in range(12)) + " y" * 500) for i in range(200)], "doc_id INT, text STRING")
    monkeypatch.setattr(leak, "FILTER_BITS", (1 << 10, 1 << 10))
    monkeypatch.setattr(leak, "SLICE_BITS", 1 << 8)
    assert sorted((r.doc, r.item) for r in leak.leaks(df, it).collect()) == [(i, i) for i in range(200)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=40))
def test_words_by_token_are_the_words_of_the_text(s):
    assert leak.words_of(s) == re.findall(r"[^\W_]+", lookalike.fold_text(s).casefold())


# look-alikes ------------------------------------------------------------------------------------------------
def spoil(rng, s):
    """The same reading in other characters."""
    back = {}
    for c, to in lookalike.LOOKALIKE.items():
        back.setdefault(to, []).append(c)
    out = []
    for c in s:
        r = rng.random()
        if r < 0.1 and c in back:
            c = rng.choice(back[c])
        elif r < 0.2 and "!" <= c <= "~":
            c = chr(ord(c) + 0xFEE0)
        elif r < 0.3:
            c = unicodedata.normalize("NFD", c)
        elif r < 0.4 and c == " ":
            c = rng.choice("    　 ")
        elif c == "-" and r < 0.6:
            c = rng.choice("‐‑－")
        out.append(c + (rng.choice("​‍⁠­﻿") if rng.random() < 0.05 else ""))
    return "".join(out).replace("fi", "ﬁ" if rng.random() < 0.5 else "fi")


def test_readings_pair_up(spark, scratch):
    rng = random.Random(11)
    words = ["Order", "costs", "Ñorrey", "fixed", "Brüwell", "non-party", "Θαλής", "Рудомир", "(12)", "office,", "x²", "Aé"]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + "\nEnd." for _ in range(30)]
    rows = [(i, plain[i % 30]) for i in range(50)] + [(100 + i, spoil(rng, plain[i % 30])) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "ORDER costs"), (903, "Order  costs"), (904, "​"), (905, "a\r\nb​"), (906, "a\nb")]
    df = spark.createDataFrame(rows, "k INT, t STRING").selectExpr("*", "'c' AS reading", "'d' AS word")
    got = {tuple(r) for r in lookalike.look_alike_pairs(lookalike.look_alike_classes(df, "k", "t", scratch)).collect()}
    base = {**{i: plain[i % 30] for i in range(50)}, **{100 + i: plain[i % 30] for i in range(60)}, 901: "", 904: "", 905: "a\nb", 906: "a\nb"}
    text = dict(rows)
    assert got == {(a, b) for a in base for b in base if a < b and lookalike.fold_text(base[a]) == lookalike.fold_text(base[b]) and text[a] != text[b]}
    done = {r.key: r.canonical for r in lookalike.canonical_texts(df, "k", "t", scratch).collect()}
    for k, c in done.items():
        assert c == lookalike.fold_text(text[k])
    assert lookalike.look_alike_classes(df.where("false"), "k", "t", scratch).count() == 0
    links = {r.key: (r.class_key, r.n_links) for r in lookalike.look_alike_links(lookalike.look_alike_classes(df, "k", "t", scratch)).collect()}
    assert sum(n for _, n in links.values()) == 2 * len(got) and all(c <= k for k, (c, _) in links.items())


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_spellings_equal_a_search_of_the_whole_vocabulary(spark, scratch):
    """With one edit allowed, wherever it is, and not what the table alone gives."""
    rng = random.Random(21)
    back = {to: c for c, to in lookalike.LOOKALIKE.items()}
    plain = ["judgement", "court", "courts", "appeal", "party", "1996", "1998", "a", "at", "Brüwell"]
    odd = []
    for w in ["judgment", "ourt", "xcourt", "appeal", "partly", "199", "qqqqqq", "o", "Bruwell", "courtss"] * 3:
        i = next((i for i, c in enumerate(w) if c in back), None)
        odd.append(w + "\u200b" if i is None or rng.random() < 0.3 else w[:i] + back[w[i]] + w[i + 1 :])
    rows = [(w, rng.randint(1, 9), False) for w in plain] + [(w, 1, True) for w in odd]
    words = spark.createDataFrame(rows, "word STRING, n BIGINT, suspect BOOLEAN")
    count = {w: n for w, n, s in rows if not s}
    for cost in (0, 1, 2):
        got = {r.word: r.spelling for r in lookalike.canonical_spellings(words, cost).collect()}
        assert set(got) == set(odd)
        for w in odd:
            read = unicodedata.normalize("NFD", lookalike.fold_text(w))
            best = min(((edits(read, unicodedata.normalize("NFD", p)), -n, p) for p, n in count.items()), default=None)
            assert got[w] == (best[2] if best[0] <= cost else lookalike.fold_text(w)), (w, cost)
        assert (cost > 0) == any(got[w] != lookalike.fold_text(w) for w in odd)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=30))
def test_folding_is_stable(s):
    once = lookalike.fold_text(s)
    assert lookalike.fold_text(once) == once == lookalike.fold_text(unicodedata.normalize("NFD", s)) == lookalike.fold_text(unicodedata.normalize("NFC", s))


def test_what_shows_stays_different():
    for a, b in (("Order", "order"), ("a b", "a\nb"), ("x²", "x2"), ("é", "e"), ("Рудомир", "Pyдомup"), ("a–b", "a-b"), ("0", "O"), ("№", "No")):
        assert lookalike.fold_text(a) != lookalike.fold_text(b)


def test_trie_automaton():
    trie = lookalike.VocabularyTrie()
    for w, n in (("Holdings", 5), ("office", 3), ("Brüwell", 2), ("offices", 9)):
        trie.add(w, n)
    assert trie.search("Hоldіngs") == "Holdings" and trie.search("oﬃce") == "office" and trie.search("Brüwe​ll") == "Brüwell"
    assert trie.search("holdings") is None and trie.search("offic") is None
    assert trie.search("ofice", 1) == "office" and trie.search("offce​", 1) == "office" and trie.search("Holdinks", 1) == "Holdings"
    assert trie.search("oﬃces", 1) == "offices"
