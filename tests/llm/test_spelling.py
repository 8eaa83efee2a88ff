"""Spelling variants against all pairs, and on awkward rows."""

import itertools
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estate_spark.llm import spelling
from estate_spark.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(u) + 1 == len(v) and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def plain_words(rows, slip=199):
    counts = Counter()
    for key, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if slip and h % slip == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def plain_forms(words):
    by = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in by.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(by[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def rows_of(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=7), max_size=25), st.integers(0, 2))
def test_composition(words, depth):
    ordered = sorted(w for w in ("xy"[:depth] + w for w in words))
    got = [tuple(sorted((ordered[i], ordered[j]))) for i, j in spelling.composed(ordered, depth)]
    want = {p for p in itertools.combinations(ordered, 2) if near(*p)}
    assert len(got) == len(set(got)) and set(got) == want
    first = [tuple(sorted((ordered[i], ordered[j]))) for i, j in spelling.composed(ordered, depth, True)]
    assert len(first) == len(set(first)) and set(first) == {(a, b) for a, b in want if a[depth:depth + 1] != b[depth:depth + 1]}


def test_acceptor_is_minimal():
    words = sorted(p + s for p in ("ab", "cd", "e") for s in ("ing", "ed", "er"))
    states, counts, start = spelling.acceptor(words, 0)
    assert counts[start] == 9 and len(states) == 8       # start, a, c, common rest, in, i -> n, e, end


@pytest.mark.parametrize("limit", [10_000, 6, 1])
def test_partitions(spark, limit):
    """Every pair once, whatever is dealt further."""
    words = sorted({"".join(p) for p in itertools.product("ab", "ab", "aé", "ab", "a", "ab")} | {"".join(p) for p in itertools.product("ab", repeat=5)}
                   | {"a" * n for n in range(1, 9)} | {"ÿ" * 3, "abcdefghij", "abcdefghi", "bcdefghij", "abcdefgij"})
    got = [(r["word"], r["near_word"]) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), limit).collect()]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if near(*p) and min(map(len, p)) >= 2}
    assert len(got) == len(set(map(frozenset, got))) and set(map(frozenset, got)) == want


def test_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = plain_words(docs)
    got = rows_of(QUERIES["op12_spelling_variants"](spark, sf))
    assert len(got) == len(words) and set(got) == plain_forms(words)


def test_chain_and_ties(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aaaaac": 25, "xaaaaaa": 24, "zzzzzz": 9}
    got = rows_of(spelling.forms(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert set(got) == plain_forms(words)
    assert ("aaaaaa", "aaaaab", "aaabbb", 5, 3, 25) in got


def test_awkward(spark):
    long = "ab" * 40_000
    rows = [(1, "Spelling spelling SPELLING speling"), (1, "Spelling spelling SPELLING speling"), (None, None), (2, ""), (None, "spelling speling speling  ×÷×÷×÷×"),
            (3, " ".join([long, long[:-1], "日本語日本語日本語"] * 5)), (4, "speling1spelling\nSTRASSE Straße straße strassen" * 5), (5, "École écoles Écoles" * 7)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, word string")
    for slip in (None, 199, 2):
        words = spelling.vocabulary(df, slip)
        want = plain_words(rows, slip)
        assert {r["word"]: r["n"] for r in words.collect()} == want
        got = rows_of(spelling.forms(words))
        assert len(got) == len(want) and set(got) == plain_forms(want)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.forms(spelling.vocabulary(df)).collect() == []
    assert spelling.forms(spelling.vocabulary(spark.createDataFrame([(1, None)], "doc_id long, text string"))).collect() == []
