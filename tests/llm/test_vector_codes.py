"""Vector codes against plain Lloyd rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import Row

from gridlark.llm.scratch import Scratch
from gridlark.llm.vector_codes import Book, books_sha256, op11_vector_codes, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if v is not None and None not in v and all(map(math.isfinite, v))]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    if not kept:
        return [], []
    longest = max(len(v) for _, _, v in kept)
    width = max(1, -(-longest // parts))
    cut = [(i, lab, [(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)]) for i, lab, v in kept]
    books = [[list(v[p]) for _, _, v in cut[:entries]] for p in range(parts)]
    near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = {}
            for _, _, v in cut:
                of.setdefault(near(v[p], book)[1], []).append(v[p])
            for e, them in of.items():
                book[e] = [sum(c) // len(them) for c in zip(*them, strict=True)]
    out = []
    for i, lab, v in cut:
        got = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got)))
    return out, books


def key(r):
    return tuple((x is None, x or 0) for x in r[:2]) + r[2:]


def same(spark, rows, **options):
    df = spark.createDataFrame([Row(*r) for r in rows], SCHEMA)
    coded, values = vector_codes(df, Scratch(spark, "t11"), **options)
    want, books = plain(rows, **options)
    assert sorted(map(tuple, coded.collect()), key=key) == sorted(want, key=key)
    assert [v.tolist() for v in values] == books


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.standard_normal(32) * rng.choice([0.05, 1.0, 20.0])).tolist(), int(i) % 5) for i in range(400)]
    rows += [(1000 + k, rows[k % 7][1], None) for k in range(300)]  # copies and null labels
    same(spark, rows)
    same(spark, rows, parts=4, entries=9, rounds=3, scale=7)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float((i * 7 + j) % 3) for j in range(16)], 0) for i in range(120)]  # few distinct parts, so many entries are equal
    same(spark, rows)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan] * 16, 1), (4, [inf] * 16, None), (5, [], 2), (6, [0.0] * 16, 2), (7, [-0.001] * 20, 2), (None, [3.0], None), (6, [1.0], 3), (6, [1.0], 3)]
    same(spark, rows)
    coded, values = vector_codes(spark.createDataFrame([], SCHEMA), Scratch(spark, "t11"))
    assert coded.count() == 0 and values == [] and len(books_sha256(values)) == 64
    wide = spark.createDataFrame([(1, [1.0] * 16, 0, "x", 5)], SCHEMA + ", raw string, code int")
    assert vector_codes(wide, Scratch(spark, "t11"))[0].count() == 1
    with pytest.raises(Exception, match="do not fit 64 bits"):
        vector_codes(spark.createDataFrame([(1, [1e30], 0)], SCHEMA), Scratch(spark, "t11"))[0].count()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (16, 4))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-20, 20, (4000, 4))
    book = Book.of(centres.astype(np.int64))
    code, upper, lower = book.guess(x), np.full(4000, np.inf), np.zeros((4000, 16))
    first = book.assign(x, code, upper, lower)
    moved = Book.of(centres + rng.integers(-3, 3, centres.shape), centres)
    upper += moved.moved[code]
    lower = np.maximum(lower - moved.moved, 0)
    again = moved.assign(x, code, upper, lower)
    away = np.sqrt(((x[:, None] - moved.entries) ** 2).sum(-1))
    assert (lower <= away + 1e-6).all() and (upper >= away[np.arange(4000), code] - 1e-6).all()
    assert (code == ((x[:, None] - moved.entries) ** 2).sum(-1).argmin(1)).all()
    assert first < 4000 * 16 and again < first / 2


def test_query_reports_label_errors(spark):
    rows = op11_vector_codes(spark, "/root/testdata/sf0.001").collect()
    of = {}
    labels = {r.vec_id: r.label for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    for r in rows:
        of[labels[r.vec_id]] = of.get(labels[r.vec_id], 0) + r.error
    assert rows and all(r.label_error == of[labels[r.vec_id]] for r in rows) and len({r.codebooks_sha256 for r in rows}) == 1
