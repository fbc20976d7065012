"""Packed fields against a character-by-character reader."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from matrixloom.operators.packed import DELIMITERS, explode_packed, one_list_per_key

BLANKS = " \t\n\r\x0b\x0c\u00a0\u2002\u2009\u200b\u202f\u3000\ufeff"


def read(text: str | None) -> list[str]:
    """Items of a list, read from left to right."""
    s = (text or "").strip(BLANKS)
    if len(s) > 1 and s[0] + s[-1] in ("[]", "{}"):
        s = s[1:-1]
    out, i = [], 0
    while i <= len(s):
        j = i
        while j < len(s) and s[j] in BLANKS and s[j] not in DELIMITERS:
            j += 1
        item = None
        if j < len(s) and s[j] in "\"'":
            q, k, body = s[j], j + 1, ""
            while k < len(s):
                if s[k] == q:
                    if s[k + 1 : k + 2] == q:
                        body, k = body + q, k + 2
                        continue
                    break
                body, k = body + s[k], k + 1
            e = k + 1
            while e < len(s) and s[e] in BLANKS and s[e] not in DELIMITERS:
                e += 1
            if k < len(s) and (e >= len(s) or s[e] in DELIMITERS):
                item, i = body, e + 1
        if item is None:
            e = i
            while e < len(s) and s[e] not in DELIMITERS:
                e += 1
            item, i = s[i:e], e + 1
        out.append(item.strip(BLANKS))
    return [x for x in out if x]


def items(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k INT, t STRING")
    out = [[] for _ in texts]
    for row in sorted(explode_packed(df, ["k"], "t").collect()):
        out[row.k].append(row.item)
        assert row.item_pos == len(out[row.k])
    return out


CASES = [
    None, "", "   ", ",;|", "a, b;c|d\te\nf", 'a, "b, c", d', "['x', 'y | z']", '["JADX14 ""short""", "k"]', "KOSX25L 5'-variant, b", '"open, a', "a；b，c",
    "'it''s', x", 'a "b, c" d', "a,a, A", "\u0001s, \"\u00010\u0002\", \u00010\u0002", "[]", "[", "{a,b}", '""', '"""", x', "' a ' , b",
]


def test_cases(spark):
    assert items(spark, CASES) == [read(t) for t in CASES]


def test_long_texts_do_not_overflow(spark):
    long = '"' + '""' * 100_000 + '", z'
    got = items(spark, [long, ",".join(["ab"] * 50_000)])
    assert [len(x) for x in got[0]] == [100_000, 1]
    assert len(got[1]) == 50_000


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab\"' ,;|\t[]，\u0001s0", max_size=14), min_size=20, max_size=60))
def test_any_text(spark, texts):
    assert items(spark, texts) == [read(t) for t in texts]


def test_empty_table_extra_columns_and_clashes(spark):
    df = spark.createDataFrame([], "k INT, t STRING, item STRING, item_pos STRING")
    assert explode_packed(df, ["k"], "t").dtypes == [("k", "int"), ("item_pos", "int"), ("item", "string")]
    assert explode_packed(df, ["k"], "t").count() == 0
    with pytest.raises(ValueError):
        explode_packed(df, ["item"], "t")


def test_repeated_rows_count_once(spark):
    rows = [(1, "a,b", 1), (1, "a;b", 2), (1, None, 0), (2, "c", None), (None, "d", 5)]
    one = one_list_per_key(spark.createDataFrame(rows, "k INT, t STRING, at INT"), "k", ["t"], latest="at")
    assert sorted(map(tuple, one.collect())) == [(1, "a;b"), (2, "c")]
