"""Quality classifier: an additive model with pairwise interactions.

Features of a text are binned; boosting goes round the features, each time
fitting one shallow tree of a single feature to the residuals and adding it,
damped, to that feature's lookup table.  The strongest pairs of features by
residual gain then get two-way tables in the same way.  A score is the sigmoid of
the intercept and one table entry per feature and pair, added for whole batches
at once.

Only the fit is bounded (``SAMPLE`` labelled rows, lowest id hashes first, and
the tables it makes); scoring reads every text whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 20_000
BINS, ROUNDS, RATE, DEPTH, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 120, 0.1, 2, 6, 8, 40

FEATURES = (
    "bytes", "words", "word_bytes", "lines", "line_words", "upper", "digit", "punctuation", "symbol", "white", "high_byte", "control",
    "distinct_words", "top_word", "repeats", "distinct_lines", "short_lines", "ended_lines", "symbol_words", "shout_words", "packed", "byte_entropy",
)


def _class(chars: bytes | range) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_UPPER, _DIGIT, _WHITE = _class(range(65, 91)), _class(range(48, 58)), _class(b" \t\n\r\x0b\x0c")
_PUNCT, _SYMBOL = _class(b".,;:?'\"()-"), _class(b"!#$%&*+/<=>@[\\]^_`{|}~")
_HIGH, _CONTROL = _class(range(128, 256)), _class([*range(9), *range(14, 32), 127])
_TAIL = b"!#$%&*+/<=>@[\\]^_`{|}~"


def features_of(text: bytes | None) -> list[float]:
    """The features of one whole text; those of an empty one are all zero."""
    text = text or b""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    k = max(1, len(words))
    seen: dict[bytes, int] = {}
    repeats = symbols = shouts = 0
    last = None
    for w in words:
        seen[w] = seen.get(w, 0) + 1
        repeats += w == last
        last = w
    for w, c in seen.items():
        symbols += c * (w[-1] in _TAIL)
        shouts += c * (len(w) > 1 and w.isupper())
    share = counts[counts > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), (n - counts[_WHITE].sum()) / k, np.log1p(len(lines)), np.log1p(len(words) / len(lines)),
        counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[_PUNCT].sum() / n, counts[_SYMBOL].sum() / n, counts[_WHITE].sum() / n,
        counts[_HIGH].sum() / n, counts[_CONTROL].sum() / n, len(seen) / k, max(seen.values(), default=0) / k, repeats / k,
        len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), sum(x[-1:] in (b".", b"?", b"!", b":") for x in lines) / len(lines),
        symbols / k, shouts / k, len(zlib.compress(text, 1)) / n, -(share * np.log2(share)).sum(),
    ]


@dataclass
class Gam:
    """Bin edges, lookup tables and pair tables."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total = np.full(len(x), self.base)
        for f, edges in enumerate(self.edges):
            total += self.tables[f][np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int) -> np.ndarray:
    """A tree of one binned feature: the step for each bin."""
    out = np.zeros(len(grad))

    def grow(a: int, b: int, left: int) -> None:
        g, h = grad[a:b].sum(), hess[a:b].sum()
        cut, gain = 0, 1e-6
        if left and b - a > 1:
            cg, ch = np.cumsum(grad[a:b])[:-1], np.cumsum(hess[a:b])[:-1]
            gains = cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g**2 / (h + 1)
            gains = np.where((ch >= 2) & (h - ch >= 2), gains, 0)
            cut = int(np.argmax(gains)) + 1
            gain = gains[cut - 1]
        if cut and gain > 1e-6:
            grow(a, a + cut, left - 1)
            grow(a + cut, b, left - 1)
        else:
            out[a:b] = g / (h + 1)

    grow(0, len(grad), depth)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Gam:
    """Boost the tables on features ``x`` and labels ``y`` (0 or 1)."""
    n, k = x.shape if len(x) else (0, len(FEATURES))
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    edges = [_cuts(x[:, f], BINS) if n else np.empty(0) for f in range(k)]
    coarse = [_cuts(x[:, f], PAIR_BINS) if n else np.empty(0) for f in range(k)]
    model = Gam(edges, coarse, base, np.zeros((k, BINS)))
    if not n or y.min() == y.max():
        return model
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(k)]
    total = np.full(n, base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p) + 1e-6

    for _ in range(rounds):
        for f in range(k):
            r, h = residual()
            step = RATE * _tree(np.bincount(bins[f], r, BINS), np.bincount(bins[f], h, BINS), DEPTH)
            model.tables[f] += step
            total += step[bins[f]]
    small = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(k)]
    r, h = residual()
    gains = []
    for f in range(k):
        for g in range(f):
            at = small[f] * PAIR_BINS + small[g]
            gr, he = np.bincount(at, r, PAIR_BINS**2), np.bincount(at, h, PAIR_BINS**2)
            gains.append(((gr**2 / (he + 1)).sum(), f, g))
    model.pairs = [(f, g) for _, f, g in sorted(gains, reverse=True)[:PAIRS]]
    model.grids = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (f, g), grid in zip(model.pairs, model.grids, strict=True):
            r, h = residual()
            at = small[f] * PAIR_BINS + small[g]
            gr, he = (np.bincount(at, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (r, h))
            rows = np.searchsorted(np.cumsum(he.sum(axis=1)), he.sum() / 2)  # split the first axis once, then the second in each half
            step = np.vstack([np.tile(_tree(a.sum(axis=0), b.sum(axis=0), DEPTH), (len(a), 1)) for a, b in ((gr[: rows + 1], he[: rows + 1]), (gr[rows + 1 :], he[rows + 1 :]))])
            grid += RATE * step
            total += RATE * step[small[f], small[g]]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features_of(x) for x in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def _scored(model: Gam, at: int, keep_text: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())  # no copy
            x = np.array([features_of(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))  # one text at a time in Python
            passed = [i for i in range(batch.num_columns) if keep_text or i != at]
            yield pa.record_batch([*[batch.column(i) for i in passed], pa.array(model.score(x))], [*[batch.schema.names[i] for i in passed], "_score"])

    return emit


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """Fit on at most ``sample`` labelled documents, lowest id hashes first.

    Rows whose crc32 of the id, as text, leaves 1 when divided by 3 are held out.
    An id that documents or labels repeat counts once for each of its labels, with the
    least features among its texts.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id"), F.col("quality").cast("double").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    measured = rows.mapInArrow(_measured, "doc_id long, label double, x array<double>")
    got = measured.groupBy("doc_id", "label").agg(F.min("x").alias("x")).toArrow()  # two rows an id at most
    y = got.column("label").to_numpy()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums do not depend on it
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: Gam, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The documents, without their text unless ``keep_text``, which comes last,
    with ``_score`` added.

    Null and empty texts have zero features and the score these get; repeated
    rows score alike; an empty table gives no rows; other columns pass through
    under any name, but a ``_score`` of the input is replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in (text_col.lower(), "_score")]
    given = docs.select(*kept, F.col(text_col).cast("string").alias(text_col))
    passed = [f for f in given.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType(passed).add("_score", T.DoubleType())
    return given.mapInArrow(_scored(model, len(kept), keep_text), schema)


def op1_quality_gam(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return score_documents(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
