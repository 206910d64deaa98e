"""Document fingerprints: MinHash signatures, their likeness, and near duplicates by bands.

A signature holds, for each of ``PERMUTATIONS`` universal hash functions, 16 bits
of the least hash over a text's word shingles; the share of equal places is an
estimate of the Jaccard similarity of two shingle sets.

For near duplicates, signatures are cut into bands and texts that agree on a
band are joined: each with one text of the band's bucket, chosen anew by every
band, and those that turn out not to be similar to it with the next one, until
no two are left.  Every such pair is verified on the shingle sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .words import SHINGLE, WordHashes, mixed, shingle_set, windows

PERMUTATIONS, BANDS, SEED = 128, 32, 1
CHUNK, DEALT = 1024, 1024
_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_MOST = np.uint64(2**64 - 1)
_TOP = np.uint64(48)


def least(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over shingles; the greatest number where there are none."""
    out = np.full(PERMUTATIONS, _MOST)
    for k in range(0, len(shingles), CHUNK):
        part = shingles[k : k + CHUNK, None] * _A
        part += _B
        np.minimum(out, part.min(axis=0), out=out)
    return out


def _shingles(words: np.ndarray) -> np.ndarray:
    """Runs of five word hashes, repeats included, or the whole of fewer."""
    if 0 < len(words) < SHINGLE:
        return windows(words, len(words)) + np.uint64(len(words))
    return windows(words, SHINGLE) if len(words) else words


def _short(values: np.ndarray) -> bytes:
    """A signature as bytes, 16 mixed bits of each least value."""
    return (mixed(values) >> _TOP).astype(">u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")).mean())


def signature(text: str, known: WordHashes | None = None) -> bytes:
    """The signature of one text; texts without words share one."""
    known = WordHashes() if known is None else known
    return _short(least(_shingles(known.of(text.encode("utf-8", "surrogateescape").lower().split()))))


class _Text:
    """A text, cut where the edit begins: what its signature shares with that of its edit is computed once."""

    def __init__(self, key, raw: bytes | None, known: WordHashes):
        self.key, self.known = key, known
        self.text = (raw or b"").decode("utf-8", "surrogateescape")
        self.moved = len(self.text) // 4
        head = self.text[: len(self.text) - self.moved].encode("utf-8", "surrogateescape")
        cut = max(head.rfind(x) for x in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1
        self.before, self.head = known.of(head[:cut].lower().split()), head
        self.rest = head[cut:]
        self.shared = max(0, len(self.before) - SHINGLE + 1)
        self.common = least(_shingles(self.before)[: self.shared])
        self.has_words, self.sign = self._ended(self.text[len(self.text) - self.moved :])

    def _ended(self, tail: str) -> tuple[bool, bytes]:
        last = (self.rest + tail.encode("utf-8", "surrogateescape")).lower().split()
        words = np.concatenate([self.before, self.known.of(last)])
        return len(words) > 0, _short(np.minimum(self.common, least(_shingles(words)[self.shared :])))

    def row(self, other: _Text) -> tuple:
        """This text's row, edited with the text that follows it."""
        tail = other.text[: self.moved]
        edited_words, edited = self._ended(tail)

        def near(b: bytes, words: bool) -> float:
            return likeness(self.sign, b) if words and self.has_words else float(words == self.has_words)

        digest = hashlib.sha256(self.head + tail.encode("utf-8", "surrogateescape")).digest()
        return self.key, len(self.text), digest, self.sign, edited, near(edited, edited_words), near(other.sign, other.has_words)


ROWS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
ROW_TYPES = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(ROWS)]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts that follow one another; a partition's first and last text go on to the borders."""
    part, known, first, last = TaskContext.get().partitionId(), WordHashes(), None, None

    def border(text: _Text, side: int) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for _, t in ROWS[1:]]
        raw = text.text.encode("utf-8", "surrogateescape")
        return pa.record_batch([pa.array([text.key], pa.int64()), *none, pa.array([part], pa.int32()), pa.array([side], pa.int32()), pa.array([raw], pa.binary())], [*(n for n, _ in ROWS), "part", "side", "raw"])

    for batch in batches:
        rows = []
        for key, raw in zip(batch.column(0), batch.column(1), strict=True):
            text = _Text(key.as_py(), raw.as_py(), known)
            if last is not None:
                rows.append(last.row(text))
            first, last = first or text, text
        none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.int32(), pa.binary())]
        yield pa.record_batch([*_arrays(rows), *none], [*(n for n, _ in ROWS), "part", "side", "raw"])
    if last is not None:
        yield border(first, 0)
        yield border(last, 1)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        them = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
        yield pa.record_batch(_arrays([_Text(a, x, known).row(_Text(b, y, known)) for a, x, b, y in them]), [n for n, _ in ROWS])


def fingerprints(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its signature, that of its edited text, and likenesses.

    The edit replaces the last quarter of the code points, rounded down, by the
    first as many (or all) of the next document by id; null ids come last, equal
    ids go by text, and the first document follows the last.  ``near_edited`` and
    ``near_next`` are the share of equal places of two signatures; without words
    a text is like texts without words only.  Null texts are empty ones, repeated
    rows count each, an empty table gives no rows, other columns are ignored.

    Texts are shuffled once, by ranges of the id; of each range its first and
    last text meet those of the neighbouring ones in a second, small step.
    """
    order = [F.asc_nulls_last("doc_id"), F.asc("raw")]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    ordered = texts.repartitionByRange(F.asc_nulls_last("doc_id"), F.xxhash64("raw")).sortWithinPartitions(*order)
    found = scratch.table(ordered.mapInArrow(_in_order, f"{ROW_TYPES}, part int, side int, raw binary"), "ordered")
    ends = found.where("part is not null").select("part", "side", "doc_id", "raw")
    parts = sorted(r.part for r in ends.where("side = 0").select("part").collect())  # one number a partition
    rows = found.where("part is null").select(*[n for n, _ in ROWS])
    if not parts:
        return rows
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = ends.where("side = 1").join(F.broadcast(follows), "part").select("next", F.col("doc_id").alias("a"), F.col("raw").alias("x"))  # a row a partition
    first = ends.where("side = 0").select(F.col("part").alias("next"), F.col("doc_id").alias("b"), F.col("raw").alias("y"))
    return rows.unionByName(last.join(first, "next").select("a", "x", "b", "y").mapInArrow(_across, ROW_TYPES))


# near duplicates --------------------------------------------------------------------


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of texts that have words."""
    known = WordHashes()
    for batch in batches:
        at, out = [], []
        for i, raw in enumerate(batch.column(1)):
            words = known.of((raw.as_py() or b"").lower().split())
            if len(words):
                at.append(i)
                out.append(_short(least(_shingles(words))))
        yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.binary())], ["node", "sign"])


def _verified(share: int):
    """Which rows are similar to the row that comes first among those of their group."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, group, own = WordHashes(), None, None
        for batch in batches:
            a, b = [], []
            for centre, salt, side, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                them = shingle_set(raw, known)
                if (centre, salt) != group:
                    group, own = (centre, salt), them
                if side:
                    both = len(np.intersect1d(own, them, assume_unique=True))
                    if 100 * both >= share * (len(own) + len(them) - both):
                        a.append(centre)
                        b.append(node)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (a, b)], ["a", "b"])

    return emit


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, share: int = 80) -> DataFrame:
    """``(doc_id, component_id)`` of every row: the smallest id reachable by links.

    Two texts are linked where a band of their signatures joins them and at least
    ``share`` percent of their shingles are common; equal texts are one class.  A
    pair of similarity 0.8 agrees on one of 32 bands of four places but for a
    chance of 5 in 100 million.  Null and empty texts link with nothing and keep their
    id; a null id takes the smallest one of its component.  Repeated rows count
    each; other columns are ignored; an empty table gives no rows.

    A bucket's texts are compared with one of them at a time, so a large group of
    copies costs a row for each, not a pair for each two; the texts compared with
    one centre are dealt to several tasks.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).withColumn("node", F.xxhash64("raw"))
    classes = scratch.table(texts.groupBy("node").agg(F.first("raw").alias("raw")), "classes")
    signed = scratch.table(classes.select("node", "raw").mapInArrow(_signed, "node long, sign binary"), "signed")
    width = 2 * PERMUTATIONS // bands
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(F.substring(F.col("sign"), k * width + 1, F.lit(width))).alias("value"))))
    cells = signed.select("node", cut.alias("c")).select("c.*", "node")
    shared = cells.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").select("band", "value")
    waiting, turn, links = scratch.table(cells.join(shared, ["band", "value"]), "cells-0"), 0, []
    while True:
        # a bucket's centre: another of its texts for each band
        centre = waiting.groupBy("band", "value").agg(F.min_by("node", F.xxhash64("node", "band")).alias("centre"), F.count("*").alias("n")).where("n > 1").select("band", "value", "centre")
        pairs = scratch.table(waiting.join(centre, ["band", "value"]).where("node <> centre").select("band", "value", "centre", "node"), f"pairs-{turn}")
        each = pairs.select("centre", "node").distinct()
        tasks = each.groupBy("centre").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("tasks"))
        dealt = each.join(tasks, "centre").select("centre", F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int").alias("salt"), F.lit(1).alias("side"), "node")
        own = dealt.select("centre", "salt").distinct().select("centre", "salt", F.lit(0).alias("side"), F.col("centre").alias("node"))
        rows = dealt.unionByName(own).join(classes, "node").select("centre", "salt", "side", "node", "raw")
        rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "side", "node")
        found = scratch.table(rows.mapInArrow(_verified(share), "a long, b long"), f"links-{turn}")
        links.append(found)
        apart = pairs.join(found.select(F.col("a").alias("centre"), F.col("b").alias("node")), ["centre", "node"], "left_anti").select("band", "value", "node")
        more = apart.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").select("band", "value")
        turn += 1
        waiting = scratch.table(apart.join(more, ["band", "value"]), f"cells-{turn}")
        scratch.drop(f"cells-{turn - 1}", f"pairs-{turn - 1}")
        if waiting.isEmpty():
            break
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    placed = connected_components(edges, scratch)
    of_row = texts.select("doc_id", "node").join(placed, "node", "left")
    group = F.coalesce("component", "node")
    least_id = of_row.groupBy(group.alias("g")).agg(F.min("doc_id").alias("least"))
    has_words = F.col("node").isNotNull()
    words = signed.select(F.col("node").alias("w"))
    out = of_row.withColumn("g", group).join(least_id, "g").join(words, F.col("node") == F.col("w"), "left")
    return out.select("doc_id", F.when(F.col("w").isNull() & has_words, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op13_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprints and likenesses; see ``fingerprints``."""
    rows = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op13"))
    hexed = {c: F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return rows.select(*[hexed.get(n, n) for n, _ in ROWS])
