"""Similar sets, free entries, percentiles and containers against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matrixloom.llm import canon, packing, quantiles, setpairs


# all similar pairs ------------------------------------------------------------------------------------------
def brute_pairs(rows, j):
    s = [(k, g, {x for x in v if x is not None}) for k, g, v in rows if k is not None and g is not None and v and any(x is not None for x in v)]
    return {(min(a, b), max(a, b)) for i, (a, g, x) in enumerate(s) for b, h, y in s[:i] if g == h and a != b and len(x & y) >= j * len(x | y) - 1e-12}


def test_pairs_equal_brute_force(spark, scratch):
    rng = random.Random(4)
    base = [[f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(3, 25))] for _ in range(60)]
    rows = []
    for k in range(500):
        v = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            v[rng.randrange(len(v))] = f"t{rng.randrange(400)}"
        rows.append((k, "g" + str(k % 3 == 0), [*v, "hot"]))
    rows += [(1000, None, ["a"]), (1001, "gTrue", []), (1002, "gTrue", None), (1003, "gTrue", ["q", None, "q"]), (1004, "gTrue", ["q"]), (None, "gTrue", ["q"])]
    df = spark.createDataFrame(rows, "key INT, grp STRING, items ARRAY<STRING>")
    classes = scratch.save(setpairs.set_classes(df))
    pairs = scratch.save(setpairs.similar_classes(classes, 0.5, scratch, leaf=24))
    got = {(r.a, r.b) for r in setpairs.expand_pairs(classes, pairs).collect()}
    expect = brute_pairs(rows, 0.5)
    assert got <= expect and len(got) >= 0.999 * len(expect)
    links = {r.key: r.n_links for r in setpairs.link_counts(classes, pairs).collect()}
    assert sum(links.values()) == 2 * len(got) and links[1003] == 1


def test_many_alike_in_one_node(spark, scratch):
    rows = [(k, "g", [f"c{i}" for i in range(12)] + [f"u{k}"]) for k in range(300)]
    classes = setpairs.set_classes(spark.createDataFrame(rows, "key INT, grp STRING, items ARRAY<STRING>"))
    assert setpairs.similar_classes(classes, 0.5, scratch, leaf=32, max_depth=2).count() == 300 * 299 // 2


def test_short_sets_in_a_full_node(spark, scratch):
    sets = [["t"], ["t", "u"], *[["t", f"b{k}"] for k in range(200)], *[["t", "u", f"a{k}"] for k in range(200)]]
    rows = [(k, "g", v) for k, v in enumerate(sets)]
    classes = scratch.save(setpairs.set_classes(spark.createDataFrame(rows, "key INT, grp STRING, items ARRAY<STRING>")))
    got = {(r.a, r.b) for r in setpairs.expand_pairs(classes, setpairs.similar_classes(classes, 0.5, scratch, leaf=128)).collect()}
    assert got == brute_pairs(rows, 0.5)


def test_between_two_tables_and_empty(spark, scratch):
    a = spark.createDataFrame([(1, "g", ["x", "y"]), (2, "g", ["z"])], "key INT, grp STRING, items ARRAY<STRING>")
    b = spark.createDataFrame([(7, "g", ["x", "y", "w"]), (8, "h", ["z"]), (9, "g", ["z"])], "key INT, grp STRING, items ARRAY<STRING>")
    got = setpairs.similar_classes(setpairs.set_classes(a), 0.5, scratch, other=setpairs.set_classes(b)).collect()
    assert sorted(round(r.overlap, 4) for r in got) == [0.6667, 1.0]
    assert setpairs.similar_classes(setpairs.set_classes(a.where("false")), 0.5, scratch).count() == 0


# free entries -----------------------------------------------------------------------------------------------
def plain_distance(a: str, b: str) -> int:
    """Fewest inserts, deletes, replacements and swaps, by search over edit scripts of adjacent letters."""
    big = len(a) + len(b)
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    seen: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), db
            same = a[i - 1] == b[j - 1]
            if same:
                db = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + i - k - 1 + 1 + j - m - 1)
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=6), min_size=1, max_size=12), st.text("abc", max_size=6), st.integers(0, 3))
def test_tree_returns_all_within(words, asked, radius):
    tree = canon.BKTree(words)
    assert sorted(tree.within(asked, radius)) == sorted((plain_distance(asked, w), w) for w in set(words) if plain_distance(asked, w) <= radius)


@settings(max_examples=100, deadline=None)
@given(*[st.text("ab", max_size=5)] * 3)
def test_distance_is_a_metric(a, b, c):
    assert canon.damerau(a, b) == canon.damerau(b, a) and (canon.damerau(a, b) == 0) == (a == b)
    assert canon.damerau(a, c) <= canon.damerau(a, b) + canon.damerau(b, c)


TERMS = [(1, "tissue", "Blood Vessel", "arterial wall; vascular tissue"), (2, "tissue", "Skin", "dermis"), (3, "tissue", "Stomach", None), (4, "tissue", "Eye", "retina"), (9, "kind", "ulcerated tissue", None), (8, None, "x", None), (7, "kind", None, None)]
MEANT = {"blood vessel": 1, "Bolod Vesrel": 1, "Vessel, Blood": 1, "Arterial Wall": 1, "human skin": 2, "Skin [frozen]": 2, "stomcah": 3, "Eyye": 4, "BloodVessel": 1, "Blóod Vessel": 1, "stomachtissue": 3, "n/a": None, "": None, "amniotic sac": None, "-": None, "x" * 500: None}


@pytest.mark.parametrize("limit", [50_000, 2])
def test_entries(spark, limit):
    rows = [(i, v, v) for i, v in enumerate(MEANT)] + [(500, "Skin", "ulc. tissue"), (501, None, None), (501, None, None), (2, "Vessel, Blood", "Vessel, Blood")]
    df = spark.createDataFrame(rows, "rec INT, tissue STRING, kind STRING").withColumn("value", F.lit(1)).withColumn("term_id", F.lit("clash"))
    terms = spark.createDataFrame(TERMS, "term_id INT, field_name STRING, canonical_name STRING, known_aliases STRING")
    got = {(r.key, r.field_name): r.term_id for r in canon.canonical_entries(df, "rec", ["tissue", "kind"], terms, limit).collect()}
    for i, (v, t) in enumerate(MEANT.items()):
        assert got[(i, "tissue")] == (t or -1), v
    assert got[(500, "kind")] == 9 and (500, "tissue") not in got and (501, "tissue") not in got
    assert canon.canonical_entries(df.where("false"), "rec", ["tissue"], terms).count() == 0


def test_shards_answer_like_one_tree(spark):
    rng = random.Random(12)
    letters = "abcdefghi"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    names = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(60)]
    terms = [(i, "f", n, "; ".join(word() for _ in range(rng.randint(0, 2))) or None) for i, n in enumerate(names)]
    terms += [(100, "f", "abcdefghijkl", None), (101, "f", "hizzz", None), (None, "f", "x y", None), terms[3], (3, "f", names[3], "zz")]
    values = ["abcdefghizzz", " ".join([*["qq"] * 9, names[5], *["qq"] * 12]), " ".join(reversed(names[0].split()))]
    for _ in range(150):
        w = rng.choice(names).split()
        at = rng.randrange(len(w))
        w[at] = rng.choice([w[at][:-1] + "z", w[at][:2] + ".", w[at] + "q", w[at][1:], w[at]])
        rng.shuffle(w)
        values.append(" ".join([*w, *[word() for _ in range(rng.randint(0, 2))]]))
    asked = spark.createDataFrame([("f", v) for v in sorted(set(values))], "field_name STRING, value STRING")
    known = spark.createDataFrame(terms, "term_id INT, field_name STRING, canonical_name STRING, known_aliases STRING")
    one, many = ({tuple(r) for r in canon.match_values(asked, known, n).collect()} for n in (1000, 9))
    assert one == many and len(one) > 100
    got = {v: (c, t) for _, v, c, t in one}
    assert got["abcdefghizzz"] == (3.0, 100) and got[values[1]][1] == 5


def test_a_value_of_many_records_is_split(spark, monkeypatch):
    monkeypatch.setattr(canon, "SPLIT_ROWS", 10)
    df = spark.createDataFrame([(i, "stomcah" if i % 3 else f"skin {i}") for i in range(300)], "rec INT, tissue STRING")
    terms = spark.createDataFrame(TERMS, "term_id INT, field_name STRING, canonical_name STRING, known_aliases STRING")
    got = [(r.key, r.term_id) for r in canon.canonical_entries(df, "rec", ["tissue"], terms).collect()]
    assert sorted(got) == [(i, 3 if i % 3 else 2) for i in range(300)]


# percentiles ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [7, 100_000])
def test_percentiles_equal_numpy(spark, scratch, block):
    rng = np.random.default_rng(block)
    rows = [(f"g{g}", i, float(np.round(rng.normal(), 1)) if rng.random() > 0.1 else [None, float("nan")][i % 2], 1.0) for g, n in enumerate((1, 2, 3, 50, 400)) for i in range(n)]
    rows += [("same", i, 3.0, None) for i in range(100)] + [("none", 1, None, None), (None, 1, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "grp STRING, id INT, v DOUBLE, w DOUBLE")
    got = {(r.grp, r.measure): r for r in quantiles.percentiles(df, ["grp"], {"v": "v", "w": "w"}, [0.25, 0.5, 0.9], scratch, F.col("id"), block).collect()}
    for g in {r[0] for r in rows}:
        for m, at in (("v", 2), ("w", 3)):
            v = [r[at] for r in rows if r[0] == g and r[at] is not None and not np.isnan(r[at])]
            if v:
                assert (got[(g, m)].n, *[got[(g, m)][f"q{i}"] for i in range(3)]) == pytest.approx((len(v), *np.quantile(v, [0.25, 0.5, 0.9])))
            else:
                assert (g, m) not in got
    assert quantiles.percentiles(df.where("false"), ["grp"], {"v": "v"}, [0.5], scratch).count() == 0


def test_one_group_in_many_blocks(spark, scratch):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(700_001)) / 1000).alias("v"))
    blocks = quantiles.value_blocks(df, ["g"], {"v": "v"}, F.col("id"), scratch, 4096)
    assert blocks.count() > 200
    got = {r.k: (r.n, r.value) for r in quantiles.multi_select(blocks, [0.5, 0.99], scratch, fan_in=16).collect()}
    v = np.array([r.v for r in df.select("v").collect()])
    for i, p in enumerate((0.5, 0.99)):
        assert got[i] == (1_000_000, pytest.approx(np.quantile(v, p), abs=1e-9))
    with pytest.raises(RuntimeError):
        quantiles.multi_select(blocks, [0.5], scratch, max_rounds=2)


def test_summaries_merge(spark):
    rng = np.random.default_rng(0)
    rows = [(d, "ab"[i % 2], float(rng.normal(3, 2))) for d in range(5) for i in range(300)]
    df = spark.createDataFrame(rows, "day INT, g STRING, v DOUBLE")
    parts = quantiles.grid_summary(df, ["day", "g"], "v", 0.05)
    merged = quantiles.summary_percentiles(quantiles.merge_summaries(parts, ["g"]), ["g"], [0.25, 0.5, 0.75], 0.05)
    for r in merged.collect():
        v = np.sort([x for _, g, x in rows if g == r.g])
        for i, p in enumerate((0.25, 0.5, 0.75)):
            assert abs(r[f"q{i}"] - v[int((len(v) - 1) * p)]) <= 0.025 + 1e-9


# containers -------------------------------------------------------------------------------------------------
def test_containers(spark, scratch):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["court", "appeal", "zollern", "x1y"]) for _ in range(rng.randint(0, 120)))) for i in range(400)] + [(900, None), (901, ""), (902, "word " * 1000), (903, "<|endoftext|>")]
    df = spark.createDataFrame(docs, "id INT, body STRING").withColumn("container", F.lit("clash")).repartition(5)
    rows = packing.pack(df, "id", "body", scratch, capacity=128, open_bins=8, fan_in=2).collect()
    enc = packing.tokenizer()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.key, []).append(r)
        if r.container is not None:
            bins[r.container] = bins.get(r.container, 0) + r.n_tokens
    assert set(by_doc) == {d for d, _ in docs} and max(bins.values()) <= 128
    for i, body in docs:
        n = len(enc.encode_ordinary(body or ""))
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in parts) == n and [r.token_start for r in parts] == list(range(0, max(n, 1), 128))
        assert len(parts) == max(1, -(-n // 128)) and (n > 0) == (parts[0].container is not None)
    assert sum(bins.values()) / (128 * len(bins)) > 0.95
    assert packing.pack(df.where("false"), "id", "body", scratch).count() == 0


def test_the_merge_of_open_containers_is_bounded(spark, scratch):
    rng = random.Random(9)
    left = [(p << 40 | i, rng.randint(1, 99), p) for p in range(64) for i in range(8)]
    df = spark.createDataFrame(left, "bin BIGINT, n_tokens INT, part INT")
    into = {r.bin: r.into for r in packing._merge(df, scratch, 100, 8, 4).collect()}
    filled = {}
    for b, n, _ in left:
        filled[into[b]] = filled.get(into[b], 0) + n
    assert set(into) == {b for b, _, _ in left} and max(filled.values()) <= 100
    assert sum(filled.values()) / (100 * len(filled)) > 0.85


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(1, 6))
def test_best_fit_rule(sizes, limit):
    bins, opened = packing.OpenBins(40, limit), []
    free: dict[int, int] = {}
    for s in sizes:
        fits = [f for f in free.values() if f >= s]
        b = bins.put(s, lambda: opened.append(len(opened)) or opened[-1])
        if fits:
            assert free[b] == min(fits)
        else:
            if len(free) >= limit:
                fullest = min(free.values())
                assert b not in free
                free.pop(next(k for k in free if free[k] == fullest))
            free[b] = 40
        free[b] -= s
        if not free[b]:
            free.pop(b)
    assert sorted(f for f in free.values()) == sorted(40 - x for _, x in bins.left())
