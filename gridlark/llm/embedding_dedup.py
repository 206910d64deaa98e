"""Embedding near-duplicates by sorted projection passes.

Each pass hashes every vector with its own 60 random hyperplanes, orders the
vectors lexicographically by the concatenated bits and compares each, in double
precision, with those that follow it and share its first bits, ``WINDOW`` of them
at most.  How many first bits, and so how many passes, follows from the data: so
many bits that a vector meets about ``MET`` others, and so many passes that two
vectors at the wanted cosine share these bits in one of them but for one chance
in a thousand.  Passes go on in batches until one joins nothing that was apart.
The links of all passes are joined into components, and the links of a component
are then counted between all of its members, in blocks.

Equal vectors are one class from the start, so a group of copies costs one row
a pass.  Windows run across the range partitions' borders: every partition also
hands its first and last rows to a small second step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

WINDOW, BITS, BLOCK = 4096, 60, 512
#: Passes of a batch: as many as shuffle so many bytes, ``BATCH`` at least.
BATCH, BATCH_BYTES = 3, 1 << 30
#: Vectors that one meets in a pass, about; prefixes that are tried; the chance to miss a pair.
MET, PREFIXES, MISSED = 512, range(12, 41, 4), 0.001
#: Runs up to so many rows are compared place by place, longer ones by blocks.
SHORT, SQUARE = 32, 1024


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _valid(kind: str):
    """Vectors that may link, as bytes, with a digest of their direction for a class."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, digest = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                ids.append(i)
                raw.append(x.astype(kind).tobytes())
                digest.append((xxhash.xxh3_64_intdigest((x / np.abs(x).max()).tobytes())) - (1 << 63))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digest, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "node", "raw"])

    return emit


def _planes(dim: int, turn: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, turn, dim]).standard_normal((dim, BITS))


def _signed(turns: range, seed: int, kind: str):
    """A row for each pass with its concatenated hash bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            node, raw = batch.column("node"), batch.column("raw")
            lengths = np.array([len(x) for x in raw.to_pylist()])
            for size in np.unique(lengths):
                rows = np.flatnonzero(lengths == size)
                some, them = node.take(pa.array(rows)), raw.take(pa.array(rows))
                x = _unit(them.to_pylist(), kind)
                for turn in turns:
                    bits = ((x @ _planes(x.shape[1], turn, seed)) >= 0) @ weights
                    turns_ = np.full(len(rows), int(size) * 100_000 + turn, np.int64)
                    yield pa.record_batch([pa.array(turns_), pa.array(bits.astype(np.int64)), some, them], ["turn", "bits", "node", "raw"])

    return emit


class _Forest:
    """Links that join what was apart among the links seen so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def new(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                out.append((x, y))
        return out


def _links_of_run(x: np.ndarray, first: int, window: int, cosine: float) -> Iterator[tuple[int, int]]:
    """Links that hold the same together as all of a run's, from rows ``first`` on with those up to ``window`` before them."""
    n, x32, up = len(x), x.astype(np.float32), np.arange(len(x))
    for i in range(first, n, SQUARE):
        low, high = max(0, i - window), min(n, i + SQUARE)
        near = _near(x[i:high], x[low:high], x32[i:high], x32[low:high], cosine)
        gap = np.arange(i, high)[:, None] - np.arange(low, high)
        near &= (gap > 0) & (gap <= window)
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            root = up[np.append(np.flatnonzero(near[k]) + low, i + k)]
            while (up[root] != root).any():
                root = up[root]
            root = np.unique(root)
            up[root] = root[0]
            up[i + k] = root[0]
            yield from ((i + k, int(r)) for r in root if r != i + k)


def _within(node: np.ndarray, turn: np.ndarray, bits: np.ndarray, raw: list[bytes], kind: str, shift: int, window: int, cosine: float, forest: _Forest, fresh: int) -> list[tuple[int, int]]:
    """Links between rows that share their first bits; the later one at or after ``fresh``."""
    out, n = [], len(node)
    cell = bits >> shift
    cuts = np.flatnonzero((turn[1:] != turn[:-1]) | (cell[1:] != cell[:-1])) + 1
    begin, end = np.append(0, cuts), np.append(cuts, n)
    size = end - begin
    last = np.repeat(end, size)
    lengths = np.array([len(r) for r in raw])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)  # a turn belongs to one length, so its rows are neighbours
        x, own = _unit([raw[i] for i in rows], kind), last[rows]
        small = np.repeat(size, size)[rows] <= SHORT
        for k in range(1, min(SHORT, len(rows))):
            pair = (rows[:-k] + k == rows[k:]) & (rows[k:] < own[:-k]) & small[:-k] & (rows[k:] >= fresh)
            if not (small[:-k] & (rows[:-k] + k < own[:-k])).any():
                break
            i = np.flatnonzero(pair)
            near = i[np.einsum("ij,ij->i", x[i], x[i + k]) >= cosine]
            out += forest.new(node[rows[near]], node[rows[near + k]])
        for b, e in zip(begin[(size > SHORT)].tolist(), end[(size > SHORT)].tolist(), strict=True):
            if lengths[b] == length and e > fresh:
                at = int(np.searchsorted(rows, b))
                pairs = list(_links_of_run(x[at : at + e - b], max(0, fresh - b), window, cosine))
                if pairs:
                    i, j = np.array(pairs).T
                    out += forest.new(node[b + i], node[b + j])
    return out


FOUND = "a long, b long, part int, side int, pos int, turn long, bits long, node long, raw binary"
CARRIED = ["turn", "bits", "node", "raw"]


def _windows(kind: str, shift: int, window: int, cosine: float):
    """Links within a partition; its first and last rows for the borders."""

    def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        none = [pa.nulls(len(found), k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        return pa.record_batch([a, b, *none], ["a", "b", "part", "side", "pos", *CARRIED])

    def border(t: pa.Table, side: int, part: int) -> pa.RecordBatch:
        n = t.num_rows
        none, whole = pa.nulls(n, pa.int64()), [pa.array(np.full(n, x, np.int32)) for x in (part, side)]
        rest = [t.column(x).combine_chunks() for x in CARRIED]
        return pa.record_batch([none, none, *whole, pa.array(np.arange(n, dtype=np.int32)), *rest], ["a", "b", "part", "side", "pos", *CARRIED])

    def run(t: pa.Table, at_end: bool) -> pa.Table:
        """The rows that share their first bits with the last row, or with the first one, up to a window of them."""
        turn, cell = t.column("turn").to_numpy(), t.column("bits").to_numpy() >> shift
        k = -1 if at_end else 0
        other = np.flatnonzero((turn != turn[k]) | (cell != cell[k]))
        if at_end:
            return t.slice(max(int(other[-1]) + 1 if len(other) else 0, t.num_rows - window))
        return t.slice(0, min(int(other[0]) if len(other) else t.num_rows, window))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, forest, tail, head, open_ = TaskContext.get().partitionId(), _Forest(), None, None, True
        for batch in batches:
            t = pa.table(batch).select(CARRIED)
            if not t.num_rows:
                continue
            if open_:
                both = t if head is None else pa.concat_tables([head, t])
                head = run(both, False)
                open_ = head.num_rows == both.num_rows and head.num_rows < window
            fresh = 0 if tail is None else tail.num_rows
            t = t if tail is None else pa.concat_tables([tail, t])
            columns = (t.column(c).to_numpy() for c in ("node", "turn", "bits"))
            yield links(_within(*columns, t.column("raw").to_pylist(), kind, shift, window, cosine, forest, fresh))
            tail = run(t, True)
        if head is not None:
            yield border(head, 1, part)
            yield border(tail, 0, part)

    return emit


def _borders(kind: str, shift: int, window: int, cosine: float):
    """Links across each border, from rows sorted by border, side and place."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(t: pa.Table) -> pa.RecordBatch:
            side, columns = t.column("side").to_numpy(), [t.column(c).to_numpy() for c in ("node", "turn", "bits")]
            found = _within(*columns, t.column("raw").to_pylist(), kind, shift, window, cosine, _Forest(), int((side == 0).sum()))
            return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            t = pa.table(batch)
            held = t if held is None else pa.concat_tables([held, t])
            at = held.column("border").to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()] if len(at) else [0]
            for x, y in zip(cuts, cuts[1:], strict=False):
                yield flush(held.slice(x, y - x))
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield flush(held)

    return emit


def _near(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of unit vectors link; single precision decides where its error cannot matter."""
    dots, slack = x32 @ y32.T, (x.shape[1] + 8) * 1.2e-7
    near = dots >= cosine + slack
    dots[near] = -2
    i, j = np.nonzero(dots >= cosine - slack)
    for k in range(0, len(i), 1 << 14):
        p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        near[p, q] = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
    return near


def _passes(prefix: int, cosine: float) -> int:
    """Passes that two vectors at ``cosine`` need to share their first bits once, but for ``MISSED``."""
    agree = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** prefix
    return 1 if agree >= 1 else math.ceil(math.log(MISSED) / math.log(1 - agree))


def _prefix(classes: DataFrame, seed: int, kind: str) -> int:
    """The fewest first bits that about ``MET`` vectors share with one, by counts of one pass."""
    bits = classes.select("node", "raw").mapInArrow(_signed(range(1), seed, kind), "turn long, bits long, node long, raw binary").select("turn", "bits")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.shiftright("bits", BITS - p).alias("cell")) for p in PREFIXES])).alias("c")
    cells = bits.select("turn", each).select("turn", "c.*").groupBy("turn", "prefix", "cell").agg(F.count("*").cast("double").alias("n"))
    met = {r.prefix: r.met for r in cells.groupBy("prefix").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("met")).collect()}
    return next((p for p in PREFIXES if met.get(p, 0) <= MET), PREFIXES[-1])


def _pass_links(classes: DataFrame, turns: range, seed: int, kind: str, shift: int, window: int, cosine: float, scratch: Scratch) -> DataFrame:
    """Links that some passes find, written."""
    order, name = ["turn", "bits", "node"], f"windows-{turns.start}"
    signed = classes.select("node", "raw").mapInArrow(_signed(turns, seed, kind), "turn long, bits long, node long, raw binary")
    found = scratch.table(signed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_windows(kind, shift, window, cosine), FOUND), name)
    links = found.where("a is not null").select("a", "b")
    parts = sorted(x[0] for x in found.where("part is not null").select("part").distinct().collect())  # one per partition
    if len(parts) > 1:
        before = classes.sparkSession.createDataFrame(list(zip(parts[1:], parts, strict=False)), "part int, before int")
        edge = found.where("part is not null").join(F.broadcast(before), "part", "left")  # a row for each partition
        edge = edge.withColumn("border", F.when(F.col("side") == 0, F.col("part")).otherwise(F.col("before"))).where("border is not null")
        edge = edge.select("border", "side", "pos", *CARRIED).repartition("border").sortWithinPartitions("border", "side", "pos")
        links = links.unionByName(edge.mapInArrow(_borders(kind, shift, window, cosine), "a long, b long"))
    out = scratch.table(links.distinct(), f"links-{turns.start}")
    scratch.drop(name)
    return out


def _counted(kind: str, cosine: float):
    """Links of each vector within sorted blocks of one component, or between two."""

    def cell(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, side, n = (t.column(x).to_numpy() for x in ("node", "side", "n"))
        x, cross = _unit(t.column("raw").to_pylist(), kind), t.column("i")[0].as_py() != t.column("j")[0].as_py()
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(node)),) * 2
        near = (x[left] @ x[right].T) >= cosine
        if not cross:
            np.fill_diagonal(near, False)
            return node, near @ n
        return np.concatenate([node[left], node[right]]), np.concatenate([near @ n[right], n[left] @ near])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def flush(t: pa.Table, ends: list[int]) -> pa.RecordBatch:
            got = [cell(t.slice(x, y - x)) for x, y in zip(ends, ends[1:], strict=False)]
            return pa.record_batch([pa.array(np.concatenate([g[k] for g in got]).astype(np.int64)) for k in (0, 1)], ["node", "links"])

        for batch in batches:
            t = pa.table(batch) if carry is None else pa.concat_tables([carry, pa.table(batch)])
            k = np.stack([t.column(x).to_numpy() for x in ("component", "i", "j")])
            cuts = (np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist()
            if cuts:
                yield flush(t, [0, *cuts])
                t = t.slice(cuts[-1])
            carry = t
        if carry is not None and carry.num_rows:
            yield flush(carry, [0, carry.num_rows])

    return emit


def projection_dedup(
    vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, passes: int | None = None, window: int = WINDOW, seed: int = 7
) -> DataFrame:
    """Components of vectors linked at ``cosine`` or more.

    Returns ``(vec_id, n_links, component_id, kept)``, a row per input row.
    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of different lengths never link; equal vectors, repeated
    rows among them, count as linked; an empty table gives no rows; other columns
    are ignored.  ``passes`` fixes their number; without any, equal vectors are
    all that is linked.  ``n_links`` counts all links within a component.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    valid = scratch.table(source.mapInArrow(_valid(kind), "vec_id long, node long, raw binary"), "valid")
    classes = scratch.table(valid.groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("raw").alias("raw")), "classes")

    prefix = PREFIXES[0] if passes is not None else _prefix(classes, seed, kind)
    wanted = _passes(prefix, cosine) if passes is None else passes
    size = classes.agg(F.sum(F.length("raw") + 24)).first()[0] or 1
    batch = max(BATCH, BATCH_BYTES // size)
    links, turn, placed = vectors.sparkSession.createDataFrame([], "a long, b long"), 0, None
    while turn < wanted:
        more = min(batch, wanted - turn)
        links = links.unionByName(_pass_links(classes, range(turn, turn + more), seed, kind, BITS - prefix, window, cosine, scratch))
        turn += more
        if turn >= wanted:
            before, placed = placed, connected_components(links, scratch, f"cc-{turn}")
            apart = placed.count() - placed.select("component").distinct().count()  # how many joins there were
            if passes is None and (before is None or apart > joined):
                joined, wanted = apart, wanted + BATCH
    if placed is None:
        placed = connected_components(links, scratch)

    members = placed.join(classes, "node").select("component", "node", "n", "raw", "rep")
    sizes = placed.groupBy("component").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = (
        members.join(sizes, "component")
        .withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "n", "raw")
        .repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
    )
    counts = dealt.mapInArrow(_counted(kind, cosine), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = placed.join(least, "component").join(counts, "node")
    of_class = classes.join(linked, "node", "left").select("node", "n", "rep", "links", "component_id")
    of_vector = valid.select("vec_id", "node").join(of_class, "node")
    of_vector = of_vector.select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")).distinct()
    out = source.select("vec_id").join(of_vector, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector's links and component; see ``projection_dedup``."""
    return projection_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op2"))


OP2_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) WHERE e IS NOT NULL AND len(list_filter(e, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least_of AS (
  SELECT e.vec_id, least(e.vec_id, coalesce(min(r.y), e.vec_id)) AS component_id FROM embeddings e LEFT JOIN reach r ON r.x = e.vec_id GROUP BY e.vec_id
)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.x = c.vec_id) AS n_links, component_id, component_id = c.vec_id AS kept FROM least_of c
"""
