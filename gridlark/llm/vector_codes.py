"""Vector codes: each part of a vector becomes the index of its codebook's nearest entry.

The codebooks are fitted by Lloyd rounds on integers with Elkan's bounds.  For
every part a vector's row keeps an upper bound of the distance to its entry and
a lower bound of that to each entry.  When entries move, bounds shift by the
movement; an entry is passed over only where a bound says that it is strictly
farther, and all others are compared by exact integer distances, ties to the
lower index.  So the result is that of comparing everything.

The rows with their bounds are a written table between two rounds; a lower
bound takes one byte there, rounded down in steps of the codebook's diameter.
What passes the driver is the codebooks, ``entries`` times a vector's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SLACK = 1e-9  # far above the error of a square root, far below what pruning could notice
FAR = np.iinfo(np.int64).max


def _integers(parts: int, scale: int):
    """Rows that are kept, components as 32-bit integers."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = [], []
            for i, v in enumerate(batch.column(2).to_pylist()):
                if v is None or None in v:
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all():
                    continue
                whole = np.floor(x * scale)
                peak = np.abs(whole).max(initial=0)
                if peak >= 1 << 30 or 4.0 * (len(v) + parts) * peak * peak >= 1 << 62:
                    raise ValueError(f"A component times {scale} is {peak:.3g}: squared distances of such vectors do not fit 64 bits")
                at.append(i)
                raw.append(whole.astype("<i4").tobytes())
            rows = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(raw, pa.binary())], ["vec_id", "label", "raw"])

    return emit


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    x = np.frombuffer(b"".join(v.ljust(4 * dim, b"\0") for v in raw), "<i4")
    return x.reshape(len(raw), dim).astype(np.int64)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Book:
    """One part's entries, and how far each is from the others and from where it was."""

    entries: np.ndarray
    half: np.ndarray
    lone: np.ndarray
    moved: np.ndarray
    step: float

    @staticmethod
    def of(entries: np.ndarray, before: np.ndarray | None = None) -> Book:
        k = len(entries)
        apart = np.sqrt(np.stack([_squared(entries, np.broadcast_to(e, entries.shape)) for e in entries]).astype(np.float64)) * (1 - SLACK)
        half = apart / 2
        others = np.where(np.eye(k, dtype=bool), np.inf, half)
        moved = np.zeros(k) if before is None else np.sqrt(_squared(entries, before).astype(np.float64)) * (1 + SLACK)
        return Book(entries, half, others.min(axis=1), moved, max(float(apart.max()), 1.0) / 255)

    def guess(self, x: np.ndarray) -> np.ndarray:
        """An entry that is near as a rule; what it is has no effect on the result."""
        e = self.entries.astype(np.float32)
        return ((e * e).sum(axis=1) / 2 - x.astype(np.float32) @ e.T).argmin(axis=1)

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring ``code`` and the bounds up to date in place; how many distances were computed."""
        rows = np.flatnonzero(~(upper < self.lone[code]))
        if not len(rows):
            return 0
        maybe = (lower[rows] <= upper[rows, None]) & (self.half[code[rows]] <= upper[rows, None])
        maybe[np.arange(len(rows)), code[rows]] = False
        rows = rows[maybe.any(axis=1)]
        at, own = np.arange(len(rows)), code[rows]
        exact = _squared(x[rows], self.entries[own])
        root = np.sqrt(exact.astype(np.float64))
        top, low = root * (1 + SLACK), lower[rows]
        low[at, own] = root * (1 - SLACK)
        # from here on an entry is no nearer than its distance from the own entry allows
        low = np.maximum(low, 2 * self.half[own] - top[:, None])
        maybe = (low <= top[:, None]) & (self.half[own] <= top[:, None])
        maybe[at, own] = False
        i, c = np.nonzero(maybe)
        found = _squared(x[rows[i]], self.entries[c])
        low[i, c] = np.sqrt(found.astype(np.float64)) * (1 - SLACK)
        all_ = np.full(low.shape, FAR)
        all_[at, own], all_[i, c] = exact, found
        best = all_.argmin(axis=1)  # the first of equals
        code[rows], lower[rows] = best, low
        upper[rows] = np.sqrt(all_[at, best].astype(np.float64)) * (1 + SLACK)
        return len(rows) + len(i)


def _narrow(upper: np.ndarray, lower: np.ndarray, books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds as they are written: upper ones rounded up, lower ones down."""
    up = np.nextafter(upper.astype("<f4"), np.float32(np.inf))
    steps = np.array([b.step for b in books])[:, None]
    return up, np.minimum(np.floor(lower / steps), 255).astype(np.uint8)


def _round(books: list[Book], steps: list[float] | None, dim: int, final: bool):
    """One assignment; without ``steps`` there are no bounds yet."""
    k, width = len(books[0].entries), dim // len(books)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = _matrix(batch.column(2).to_pylist(), dim)
            shape = (n, len(books))
            if steps is None:
                code, upper, lower = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros((*shape, k))
            else:
                code, up, low = (b"".join(batch.column(j).to_pylist()) for j in (3, 4, 5))
                code = np.frombuffer(code, np.uint8).reshape(shape).astype(np.int64)
                upper = np.frombuffer(up, "<f4").reshape(shape).astype(np.float64)
                lower = np.frombuffer(low, np.uint8).reshape(*shape, k) * np.array(steps)[:, None]
            error = np.zeros(n, np.int64)
            for p, book in enumerate(books):
                y = x[:, p * width : (p + 1) * width]
                c, u, low = code[:, p], upper[:, p], lower[:, p]
                if steps is None:
                    c[:] = book.guess(y)
                else:
                    u += book.moved[c]
                    np.maximum(low * (1 - SLACK) - book.moved, 0, out=low)
                book.assign(y, c, u, low)
                if final:
                    error += _squared(y, book.entries[c])
            packed = code.astype(np.uint8)
            if final:
                own = [pa.array([r.tobytes().hex() for r in packed], pa.string()), pa.array(error)]
                yield pa.record_batch([batch.column(0), batch.column(1), *own], ["vec_id", "label", "code", "error"])
            else:
                up, low = _narrow(upper, lower, books)
                own = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (packed, up, low)]
                yield pa.record_batch([*batch.columns[:3], *own], ["vec_id", "label", "raw", "codes", "upper", "lower"])

    return emit


def _sums(parts: int, k: int, dim: int):
    """A task's counts (place -1) and component sums of each part's entries."""
    width = dim // parts

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column("raw").to_pylist(), dim)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(x), parts)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=k)
                np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
        part, entry = (a.ravel() for a in np.indices((parts, k)))
        used = count.ravel() > 0
        rows = [(part[used], entry[used], np.full(used.sum(), -1), count.ravel()[used])]
        rows += [(part[used], entry[used], np.full(used.sum(), j), total[:, :, j].ravel()[used]) for j in range(width)]
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*rows, strict=True)]
        yield pa.record_batch([pa.array(c) for c in cols], ["part", "entry", "place", "value"])

    return emit


def vector_codes(
    vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error)`` of each kept row, and the final codebooks.

    Components become ``floor(scale * x)``.  Rows whose vector is null or holds
    null or non-finite components are dropped; shorter vectors count as padded
    with zeros to the longest, and that to a multiple of ``parts`` (an empty one
    is all zeros).  The first entries are the rows of the smallest ids, of equal
    ids those of the smaller bytes, null ids last; fewer rows than ``entries``
    make smaller codebooks, none an empty result.  Repeated rows count each.
    Other columns are ignored.  Components so large that squared distances would
    leave 64 bits are an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("An index has one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    plain = [T.StructField(n, source.schema[n].dataType) for n in ("vec_id", "label")]
    binary = lambda *names: [T.StructField(n, T.BinaryType()) for n in names]
    state = scratch.table(source.mapInArrow(_integers(parts, scale), T.StructType([*plain, *binary("raw")])), "kept")
    first = state.orderBy(F.asc_nulls_last("vec_id"), "raw").limit(entries).select("raw").collect()
    longest = state.agg(F.max(F.length("raw"))).first()[0]
    done = T.StructType([*plain, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not first:
        return spark.createDataFrame([], done), []
    dim = max(parts, -(-longest // (4 * parts)) * parts)
    start = _matrix([bytes(r[0]) for r in first], dim)
    values = [np.ascontiguousarray(v) for v in np.split(start, parts, axis=1)]
    books, steps, held = [Book.of(v) for v in values], None, "kept"
    for turn in range(rounds):
        bounds = T.StructType([*plain, *binary("raw", "codes", "upper", "lower")])
        state = scratch.table(state.mapInArrow(_round(books, steps, dim, False), bounds), f"round-{turn}")
        scratch.drop(held)
        held, steps = f"round-{turn}", [b.step for b in books]
        found = state.select("raw", "codes").mapInArrow(_sums(parts, len(first), dim), "part long, entry long, place long, value long")
        found = found.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        sums = {(r.part, r.entry, r.place): int(r.value) for r in found.collect()}  # the codebooks' size, whatever the table's
        moved = []
        for p, v in enumerate(values):
            new = v.copy()
            for e in range(len(v)):
                if n := sums.get((p, e, -1)):
                    new[e] = [sums[p, e, j] // n for j in range(v.shape[1])]
            moved.append(new)
        books, values = [Book.of(n, v) for n, v in zip(moved, values, strict=True)], moved
    coded = scratch.table(state.mapInArrow(_round(books, steps, dim, True), done), "coded")
    scratch.drop(held)
    return coded, values


def books_sha256(values: list[np.ndarray]) -> str:
    """All entries' components by part, entry and place, as decimals."""
    return hashlib.sha256(",".join(str(x) for v in values for x in v.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes and errors of every kept vector, and its label's error; see ``vector_codes``."""
    coded, values = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op11"))
    of_label = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    out = coded.join(of_label, F.col("label").eqNullSafe(F.col("same")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(values)).alias("codebooks_sha256"))


def _sql() -> str:
    near = """near{0} AS (SELECT vec_id, p, min(struct_pack(d := dd, e := e)) AS best FROM (
    SELECT a.vec_id, a.p, b.e, (list_dot_product(a.y, a.y) - 2 * list_dot_product(a.y, b.y) + list_dot_product(b.y, b.y))::BIGINT AS dd FROM part a JOIN book{0} b ON a.p = b.p) GROUP BY vec_id, p)"""
    book = """sums{1} AS (SELECT p, e, i, sum(y[i])::BIGINT AS s, count(*) AS n FROM (SELECT a.p, best.e AS e, y, unnest(range(1, len(y) + 1)) AS i
    FROM part a JOIN near{0} n ON a.vec_id = n.vec_id AND a.p = n.p) GROUP BY p, e, i),
  new{1} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS y FROM sums{1} GROUP BY p, e),
  book{1} AS (SELECT o.p, o.e, coalesce(n.y, o.y) AS y FROM book{0} o LEFT JOIN new{1} n ON o.p = n.p AND o.e = n.e)"""
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
  part AS (SELECT vec_id, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS y FROM kept, range(16) t(p)),
  book0 AS (SELECT p, e, y FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, y FROM part) WHERE e < 64),
  {near.format(0)}, {book.format(0, 1)}, {near.format(1)}, {book.format(1, 2)}, {near.format(2)},
  hash AS (SELECT sha256(string_agg(y[i]::BIGINT, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, y, unnest(range(1, len(y) + 1)) AS i FROM book2)),
  coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY vec_id)
SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded c JOIN kept k ON c.vec_id = k.vec_id, hash"""


OP11_SQL = _sql()
