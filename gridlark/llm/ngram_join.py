"""N-gram Jaccard join over a count-vector R-tree.

Each document's shingles are hashed into ``GROUPS`` groups; the group counts
are a point, and for two points the sum of coordinate minima is never below the
documents' overlap.  A packed R-tree over such points (``CountVectorRTree``)
bounds the overlap of a query with everything below a node by the query's
minima with the node's upper corner, and drops subtrees that cannot reach the
required overlap; surviving pairs are verified on the shingle sets.

One tree over a whole corpus cannot prune: documents of one length lie within
each other's radius in every coordinate.  The join therefore plants one tree in
each *cell*, where a cell holds the documents that share one shingle of their
prefixes.  Two sets with Jaccard >= 0.8 share at least one of the first
``n // 5 + 1`` shingles of either, in any order common to all documents, so
cells lose no pair.  The common order puts shingles with low counts in a
fixed-size table of counters first, so that passages which very many documents
share are hardly ever cell keys.

Exact copies (equal sets) are one class from the start, and cells with the same members count once.  Two rounds
try only each document's closest pair between components, so that groups of near
copies grow together without all of their pairs; a last round tries every pair whose
ends are in different components still.  Cells above ``BLOCK`` members are dealt out
as pairs of blocks; none is capped or dropped.  Classes are told apart by 64-bit
digests of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .words import WordHashes, shingle_set

GROUPS, FINE = 256, 2048
COUNTERS = 1 << 15
BLOCK = 1024
FEW_IDS = 500_000
LEAF = 32


def required(n: np.ndarray | int, m: np.ndarray | int):
    """The least overlap of sets of ``n`` and ``m`` with 100 * I >= 80 * U."""
    return (4 * (n + m) + 8) // 9


def count_vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group counts, 255 standing for all above; what is cut off is added back to bounds."""
    counts = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8)


def minima(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.minimum(p, q).sum(axis=-1, dtype=np.uint32).astype(np.int64)


class CountVectorRTree:
    """A packed R-tree over group counts of sets with the given sizes.

    A node keeps its upper corner, its smallest and largest set and the most
    that the counts of one of its sets leave out.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes, self.fan = points, sizes, leaf
        self.over = sizes - points.sum(axis=1, dtype=np.int64)
        self.leaves = self._split(leaf)
        level = tuple(
            np.array([f(x[rows], axis=0) for rows in self.leaves])
            for x, f in ((points, np.max), (sizes, np.min), (sizes, np.max), (self.over, np.max))
        )
        self.levels = [level]
        while len(level[0]) > leaf:
            cuts = np.arange(0, len(level[0]), leaf)
            level = tuple(f.reduceat(x, cuts, axis=0) for x, f in zip(level, (np.maximum, np.minimum, np.maximum, np.maximum), strict=True))
            self.levels.append(level)

    def _split(self, leaf: int) -> list[np.ndarray]:
        todo, done = [np.arange(len(self.points))], []
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                done.append(rows)
                continue
            here = self.points[rows]
            axis = int(np.argmax(here.max(axis=0).astype(np.int64) - here.min(axis=0)))
            rows = rows[np.argsort(here[:, axis], kind="stable")]
            todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
        return done

    def search(self, points: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For a few query sets at once: (query, row, slack) of the pairs whose
        bound reaches the required overlap; slack is what it exceeds it by."""
        over = sizes - points.sum(axis=1, dtype=np.int64)
        box, least, most, rest = points.max(axis=0), sizes.min(), sizes.max(), over.max()
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            u, lo, hi, ex = (x[nodes] for x in self.levels[depth])
            bound = minima(u, box) + np.minimum(ex, rest)
            nodes = nodes[(bound >= required(least, lo)) & (4 * lo <= 5 * most) & (4 * least <= 5 * hi)]
            if depth:
                nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        for rows in (self.leaves[i] for i in nodes):
            bound = minima(points[:, None], self.points[rows][None]) + np.minimum(over[:, None], self.over[rows][None])
            slack = bound - required(sizes[:, None], self.sizes[rows][None])
            x, y = np.nonzero(slack >= 0)
            yield x, rows[y], slack[x, y]


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _records(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(x).to_pylist() for x in names]


DIGESTS = "doc_id long, n long, high long, low long, point binary, counters binary"
FLUSH = 8 << 20


def _texts_of(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    """One text at a time in Python."""
    return (x.as_py() for x in batch.column("text"))


class _Seen(set):
    """Remembers up to ``limit`` digests; copies within a task add nothing."""

    limit = 100_000

    def new(self, x: int) -> bool:
        if x in self:
            return False
        if len(self) >= self.limit:
            self.clear()
        self.add(x)
        return True


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set size and digest, with the point where the task meets its
    set for the first time; last, this task's counters."""
    known, seen, counters = WordHashes(), _Seen(), np.zeros(COUNTERS, np.int64)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = ["doc_id", "n", "high", "low", "point", "counters"]
    held, size = [], 0

    def count() -> None:
        nonlocal size, counters
        if held:
            counters += np.bincount((np.concatenate(held) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        size = 0
        held.clear()

    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for doc, text in zip(batch.column("doc_id").to_pylist(), _texts_of(batch), strict=True):
            s = shingle_set(text, known)
            held.append(s)
            size += len(s)
            if size > 1 << 19:
                count()
            high, low = _digest(s)
            point = count_vector(s).tobytes() if len(s) and seen.new(low) else None
            for column, v in zip(rows, (doc, len(s), high, low, point, None), strict=True):
                column.append(v)
        yield pa.record_batch([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names)
    count()
    yield pa.record_batch([*[pa.nulls(1, k) for k in kinds[:-1]], pa.array([counters.tobytes()], pa.binary())], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for (x,) in zip(batch.column("counters").to_pylist(), strict=True):
            total += np.frombuffer(x, np.int64)
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counters"])


def _prefixes(counts: np.ndarray):
    bits = int(counts.max()).bit_length()
    rank = (counts >> max(0, bits - 20)).astype(np.uint64) << np.uint64(44)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), _Seen()
        for batch in batches:
            keys, lows = [], []
            for text in _texts_of(batch):
                s = shingle_set(text, known)
                if not len(s) or not seen.new(low := _digest(s)[1]):
                    continue
                p = len(s) // 5 + 1
                order = rank[(s % np.uint64(COUNTERS)).astype(np.int64)] | (s >> np.uint64(20))
                keys.append(s[order <= np.partition(order, p - 1)[p - 1]])  # with ties, so that the order is the same everywhere
                lows.append(np.full(len(keys[-1]), low, np.int64))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(lows))], ["key", "low"])

    return emit


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with the size of their set, the set and its counts of finer groups."""
    known, seen = WordHashes(), _Seen()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.record_batch([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["low", "n", "set", "fine"])

    for batch in batches:
        rows, size = [], 0
        for text in _texts_of(batch):
            s = shingle_set(text, known)
            if len(s) and seen.new(low := _digest(s)[1]):
                rows.append((low, len(s), s.tobytes(), count_vector(s, FINE).tobytes()))
                size += 8 * len(s) + FINE
                if size > FLUSH:
                    yield made(rows)
                    rows, size = [], 0
        yield made(rows)


def _points(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that the bound on finer groups allows."""
    for batch in batches:
        if batch.num_rows:
            p, q = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, FINE) for x in ("p", "q"))
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            bound = minima(p, q) + np.minimum(n - p.sum(axis=1, dtype=np.int64), m - q.sum(axis=1, dtype=np.int64))
            yield batch.select(["a", "b"]).filter(pa.array(bound >= required(n, m)))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, s, t = _records(batch, "a", "b", "s", "t")
        keep = []
        for x, y in zip(s, t, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _pairs_of_cells(nearest: bool):
    """Rows sorted by cell; a tree in each cell finds its pairs between
    components, all of them or only the closest one of each row."""

    def pairs(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        low, comp, side, n, i, j = (t.column(x).to_numpy() for x in ("low", "component", "side", "n", "i", "j"))
        points, found = _points(t.column("point")), []

        def add(x: np.ndarray, y: np.ndarray, slack: np.ndarray) -> None:
            ok = comp[x] != comp[y]
            found.append((x[ok], y[ok], slack[ok]))

        two = ends - starts == 2  # most cells; all at once
        x, y = starts[two], starts[two] + 1
        over = n - points.sum(axis=1, dtype=np.int64)
        slack = minima(points[x], points[y]) + np.minimum(over[x], over[y]) - required(n[x], n[y])
        ok = (slack >= 0) & ((i[x] == j[x]) | (side[x] != side[y]))
        add(x[ok], y[ok], slack[ok])
        for a, b in zip(starts[~two], ends[~two], strict=True):
            rows = np.arange(a, b)
            cross = i[a] != j[a]
            left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if cross else (rows, rows)
            if len(left) and len(right) and len(rows) > 1:
                tree = CountVectorRTree(points[right], n[right])
                for k in range(0, len(left), LEAF):
                    part = left[k : k + LEAF]
                    for x, y, slack in tree.search(points[part], n[part]):
                        x, y = part[x], right[y]
                        ok = slice(None) if cross or nearest else low[x] > low[y]
                        add(x[ok], y[ok], slack[ok])
        x, y, slack = (np.concatenate([f[k] for f in found]) for k in range(3))
        a, b = low[x], low[y]
        if nearest:  # each end's best
            a, b, slack = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([slack, slack])
            order = np.lexsort((b, -slack, a))
            order = order[np.append(True, a[order][1:] != a[order][:-1])] if len(order) else order
        else:
            order = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1, return_index=True)[1]
            a, b = np.maximum(a, b), np.minimum(a, b)
        return pa.record_batch([pa.array(v[order].astype(np.int64)) for v in (a, b, slack)], ["a", "b", "slack"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            t = pa.table(batch) if carry is None else pa.concat_tables([carry, pa.table(batch)])
            k = np.stack([t.column(x).to_numpy() for x in ("key", "i", "j")])
            cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield pairs(t.slice(0, cuts[-1]), np.append(0, cuts[:-1]), cuts)
                t = t.slice(cuts[-1])
            carry = t
        if carry is not None and carry.num_rows:
            yield pairs(carry, np.array([0]), np.array([carry.num_rows]))

    return emit


def _candidates(members: DataFrame, found: DataFrame | None, points: DataFrame, scratch: Scratch, name: str, nearest: bool) -> DataFrame:
    """Pairs that cells allow between components so far.

    Cells above ``BLOCK`` members never meet in one task: there are few of them, at
    most one for ``BLOCK`` rows, so the rows are told theirs and dealt out as pairs
    of blocks.  Before any component is known, each of their members is paired with
    the cell's first only, which joins most of a large group in linear work.
    """
    placed = members.withColumn("component", F.col("low"))
    if found is not None:
        placed = members.join(found, members.low == found.node, "left").select("key", "low", F.coalesce("component", "low").alias("component"))
    placed = scratch.table(placed, f"{name}-placed")
    split = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.min("low").alias("first"), F.count("*").alias("m")).where("c < d")
    split = scratch.table(split.select("key", "first", "m"), f"{name}-split")
    hot = split.where(F.col("m") > BLOCK)
    many = hot.count()
    if many <= FEW_IDS:
        hot = F.broadcast(hot)
    cold = placed.join(hot, "key", "left_anti") if many else placed
    whole = F.lit(0)
    dealt = cold.join(split.where(F.col("m") <= BLOCK).select("key"), "key").select("key", whole.alias("i"), whole.alias("j"), whole.alias("side"), "low", "component")
    if many and found is not None:
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        large = placed.join(hot, "key").withColumn("mine", F.pmod(F.xxhash64("low"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        large = large.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "low", "component")
        dealt = dealt.unionByName(large)
    cells = dealt.join(points, "low").select("key", "i", "j", "side", "low", "component", "n", "point").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = cells.mapInArrow(_pairs_of_cells(nearest), "a long, b long, slack long")
    if nearest:
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("slack", "b")).alias("b"))
    pairs = pairs.select("a", "b")
    if many and found is None:
        pairs = pairs.unionByName(placed.join(hot, "key").where("low <> first").select(F.col("low").alias("a"), F.col("first").alias("b")))
    pairs = scratch.table(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-pairs")
    scratch.drop(f"{name}-placed", f"{name}-split")
    return pairs


def _few(ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Distinct ids, broadcast where a count proves them few."""
    ids = scratch.table(ids.distinct(), name)
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Verify pairs, first by the bound on finer groups, then on their shingle sets.

    The texts of a class are those of its smallest id; where it has none, all texts
    without an id are read.
    """
    lows = pairs.select(F.explode(F.array("a", "b")).alias("low")).distinct()
    ids = _few(lows.join(classes, "low").select("rep"), scratch, f"{name}-ids")
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = scratch.table(texts.mapInArrow(_sets, "low long, n long, set binary, fine binary"), f"{name}-sets")
    # a class that several tasks met is there more than once, which repeats a link and no more
    fine = sets.select("low", "n", "fine")
    close = (
        pairs.join(fine.select(F.col("low").alias("a"), "n", F.col("fine").alias("p")), "a")
        .join(fine.select(F.col("low").alias("b"), F.col("n").alias("m"), F.col("fine").alias("q")), "b")
        .select("a", "b", "n", "m", "p", "q")
        .mapInArrow(_finer, "a long, b long")
        .distinct()
    )
    close = scratch.table(close, f"{name}-close")
    found = (
        close.join(sets.select(F.col("low").alias("a"), F.col("set").alias("s")), "a")
        .join(sets.select(F.col("low").alias("b"), F.col("set").alias("t")), "b")
        .select("a", "b", "s", "t")
        .mapInArrow(_verified, "a long, b long")
        .distinct()
    )
    found = scratch.table(found, f"{name}-links")
    scratch.drop(f"{name}-sets")
    return found


def jaccard_join(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked at shingle Jaccard >= 0.8.

    Returns ``(doc_id, n_shingles, component_id)``, one row per input row.
    Null or empty texts and texts of white space have an empty set and their own
    id as component; repeated rows fall into one class; an empty table gives no
    rows; other columns are ignored.  A row with a null id links as its text
    does, with the smallest known id of its component.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    seen = scratch.table(docs.mapInArrow(_digests, DIGESTS), "digests")
    parts = seen.where("counters is not null").select("counters")
    counted = parts.repartition(16).mapInArrow(_summed, "counters binary").coalesce(1).mapInArrow(_summed, "counters binary").collect()
    counts = np.frombuffer(counted[0][0], np.int64)
    digests = seen.where("counters is null").select("doc_id", "n", "high", "low")
    classes = scratch.table(digests.where("n > 0").groupBy("low", "high").agg(F.min("doc_id").alias("rep")), "classes")

    prefixes = scratch.table(docs.mapInArrow(_prefixes(counts), "key long, low long"), "prefixes")
    shared = prefixes.groupBy("key").agg(F.min("low").alias("first"), F.max("low").alias("last")).where("first < last").select("key")
    members = scratch.table(prefixes.join(scratch.table(shared, "shared"), "key").distinct(), "shared-members")
    scratch.drop("prefixes", "shared")
    # cells with the same members have the same pairs: one of them will do
    same = members.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("low")).alias("x"), F.bit_xor(F.xxhash64("low", F.lit(1))).alias("y"))
    members = scratch.table(members.join(same.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"), "members")
    scratch.drop("shared-members")

    points = seen.where("point is not null").select("low", "n", "point").join(_few(members.select("low"), scratch, "ids"), "low", "left_semi")
    points = scratch.table(points.dropDuplicates(["low"]), "points")

    links, final = [], None
    for turn in ("nearest-1", "nearest-2", "all"):
        pairs = _candidates(members, final, points, scratch, turn, turn != "all")
        links.append(_links(pairs, docs, classes, scratch, turn))
        if final is None or not links[-1].isEmpty():
            final = connected_components(reduce(DataFrame.unionByName, links), scratch, f"{turn}-cc")

    of_class = classes.join(final, classes.low == final.node, "left").select("low", "high", "rep", F.coalesce("component", "low").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(smallest, "component").select("low", "high", "component_id")
    out = digests.join(of_class, ["low", "high"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's set size and component; see ``jaccard_join``."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op9"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), spread AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM spread a JOIN spread b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
