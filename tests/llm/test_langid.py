"""Language identification against exact n-gram sets, held-out rows and awkward texts."""

import re
import zlib
from collections import Counter

import numpy as np

from estate_spark.llm import langid
from estate_spark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"


def plain_grams(text):
    out = Counter()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").lower().encode()):
        w = b" " + w + b" "
        for size in langid.SIZES:
            out.update(w[i:i + size] for i in range(len(w) - size + 1))
    return out


def plain_sets(rows):
    counts = {}
    for _, text, lang in rows:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    most = {}
    for s in share.values():
        for g, v in s.items():
            most[g] = max(v, most.get(g, 0))
    return {x: {g for g, v in s.items() if v >= langid.LEAST and v >= langid.NEAR * most[g]} for x, s in share.items()}


def key(gram):
    return sum(b << (8 * i) for i, b in enumerate(gram)) | len(gram) << 56


def test_filters_and_shares(spark, sf):
    """No n-gram of a language is missed; corrected shares are those of exact sets."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    sets, model = plain_sets(rows), langid.train(docs)
    assert model.languages == sorted(sets)
    (block,) = langid.blocks(model, [0])
    for i, x in enumerate(model.languages):
        mask = block.languages_of(np.array([key(g) for g in sets[x]], np.uint64))
        assert ((mask >> i) & 1).all()
    got = block.shares(langid._lower([t for _, t, _ in rows]))
    for r, (_, text, _) in enumerate(rows):
        c = plain_grams(text)
        n = sum(c.values())
        for i, x in enumerate(model.languages):
            want = sum(v for g, v in c.items() if g in sets[x]) / n
            f, most = block.false[i], max(c.values())       # false hits: five standard deviations, and one n-gram
            assert abs(got[r, i] - want) <= (5 * (f * sum(v * v for v in c.values())) ** 0.5 + most) / n
            assert f < 0.035                               # (1 - exp(-3 / 8)) ** 3 at most


def test_held_out(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_language_id"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.99 * len(held)


TRAIN = [(1, "the cat sat on the mat and the dog was with them", "en"), (2, "le chat est sur la table avec les chiens", "fr"),
         (3, "кот сидит на столе и смотрит", "ru"), (4, "the the the the", None), (5, None, "xx"), (6, "", "yy"), (7, "一二三 四五", "zh")]


def predicted(spark, train, rows):
    model = langid.train(spark.createDataFrame(train, SCHEMA))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "'q' AS lang_pred", "'k' AS gram")
    return {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}


def test_awkward(spark):
    rows = [(1, None, None), (2, "", "en"), (3, " 12 .. ²½ “—” \U0001F600", "en"), (4, "The Cat", "fr"), (5, "la", "en"), (6, "смотрит кот", None),
            (7, "qqqq zzzz", None), (8, "the cat " * 50_000, None), (9, "一", None), (None, "x" * 300_000 + " le chat", None)]
    got = predicted(spark, TRAIN, rows)
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (4, 5, 6, 8)] == ["en", "fr", "ru", "en"]
    assert got[7][0] in ("en", "fr", "ru", "zh") and got[9][0] in ("en", "fr", "ru", "zh") and len(got) == len(rows)
    assert got[8][1] > 0.99


def test_nothing_learned(spark):
    assert predicted(spark, [(1, "abc", None), (2, None, "en")], [(1, "abc", "en")]) == {1: ("und", 0.0)}
    assert predicted(spark, TRAIN, []) == {}
    assert predicted(spark, [], [(1, "abc", "en"), (1, "abc", "en")]) == {1: ("und", 0.0)}


def test_ties_take_the_first_name(spark):
    assert predicted(spark, [(1, "same words here", "b"), (2, "same words here", "a")], [(1, "words here", None)])[1] == ("a", 1.0)


def test_many_languages(spark, monkeypatch):
    """Several tables and several passes decide as one."""
    letters = "abcdefghijklmnop"
    train = [(i, f"{x}{y}{x}{x}{y} {y}{y}{x}", f"{x}{y}") for i, (x, y) in enumerate((x, y) for x in letters for y in letters if x != y)]
    assert len(train) == 240
    one = predicted(spark, train, train)
    assert all(one[i] == (lang, 1.0) for i, _, lang in train)
    monkeypatch.setattr(langid, "BLOCK", 7)
    monkeypatch.setattr(langid, "BLOCKS", 5)
    few = predicted(spark, train, train)
    assert {i: x for i, (x, _) in few.items()} == {i: x for i, (x, _) in one.items()}
