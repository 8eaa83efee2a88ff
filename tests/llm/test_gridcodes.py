"""Vector codes against plain assignments, and on awkward rows."""

import hashlib
import math

import numpy as np

from estate_spark.llm import gridcodes
from estate_spark.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """Reference: (vec_id, code, error, label) rows and the codebooks, one distance at a time."""
    kept = [(k, [math.floor(1024 * x) for x in v], y) for k, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    step = len(kept[0][1]) // 4
    kept = [r for r in kept if len(r[1]) == 4 * step]
    part = [[r[1][p * step:(p + 1) * step] for r in kept] for p in range(4)]
    books = [[list(u) for u in part[p][:256]] for p in range(4)]

    def nearest(u, book):
        return min((sum((a - b) ** 2 for a, b in zip(u, c)), i) for i, c in enumerate(book))
    for _ in range(4):
        for p in range(4):
            by = {}
            for u in part[p]:
                by.setdefault(nearest(u, books[p])[1], []).append(u)
            for i, us in by.items():
                books[p][i] = [sum(x) // len(us) for x in zip(*us)]
    out = []
    for n, (k, _, y) in enumerate(kept):
        got = [nearest(part[p][n], books[p]) for p in range(4)]
        out.append((k, "".join(f"{i:02x}" for _, i in got), sum(d for d, _ in got), y))
    return out, books


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    books = gridcodes.train(df)
    return gridcodes.with_label_error(gridcodes.encode(df, books)).collect(), books


def held(spark, rows):
    got, books = run(spark, rows)
    want, plain_books = plain(rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["vec_id"], bytes(r["codes"]).hex(), r["error"], r["label"]) for r in got), key=key) == sorted(want, key=key)
    assert [b.tolist() for b in books] == plain_books
    total = {}
    for *_, e, y in want:
        total[y] = total.get(y, 0) + e
    assert all(r["label_error"] == total[r["label"]] for r in got)


def test_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, books = plain(rows)
    got = QUERIES["op13_vector_codes"](spark, sf).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted(w[:3] for w in want)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_awkward(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 8).round(2).tolist(), int(i) % 3) for i in range(300)]
    rows += [(7, rows[7][1], 1), (8, rows[9][1], None), (None, rows[11][1], None), (400, None, 1), (401, [0.1] * 7 + [None], 1),
             (402, [0.1] * 7 + [NAN], 1), (403, [-INF] * 8, 1), (404, [], 1), (405, [0.5] * 4, 1), (406, [0.5] * 7, 2), (-1, [None] * 8, 2)]
    held(spark, rows)


def test_ties_and_few_rows(spark):
    held(spark, [(3, [0.0, 1.0, 0.0, 1.0], 1), (1, [0.0, 1.0, 0.0, 1.0], 1), (2, [1.0, 0.0, 1.0, 0.0], None), (4, [0.5, 0.5, 0.5, 0.5], None)])


def test_empty(spark):
    assert run(spark, []) == ([], [])
    assert run(spark, [(1, None, 1), (2, [NAN] * 4, 1)]) == ([], [])


def test_extreme_numbers(spark):
    got, _ = run(spark, [(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1), (3, [0.0] * 4, 1)])
    assert len(got) == 3 and all(r["error"] == 0 for r in got)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1, "x", "y")], SCHEMA + ", codes string, part string")
    (r,) = gridcodes.encode(df, gridcodes.train(df)).collect()
    assert (bytes(r["codes"]), r["error"]) == (b"\0\0\0\0", 0)


def test_memo_changes_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    x, book = rng.integers(-400, 400, (5000, 6)), rng.integers(-400, 400, (200, 6))
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    for memo, cell in ((gridcodes.MEMO, 32), (10, 32), (100, 500), (5, 1)):
        monkeypatch.setattr(gridcodes, "MEMO", memo)
        monkeypatch.setattr(gridcodes, "CELL", cell)
        c = gridcodes.Cells(book)
        for a in range(0, 5000, 1000):
            entry, least = c.nearest(x[a:a + 1000])
            assert (entry == d[a:a + 1000].argmin(1)).all() and (least == d[a:a + 1000].min(1)).all()
            assert len(c.memo) <= max(memo, 1000)
