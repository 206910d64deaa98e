"""Annotation documents read in parallel, however large one of them is.

A JSON document cannot be split at line ends.  Spark's text reader can split it
at every ``}`` instead, by byte ranges of the file.  Whether a range begins
inside a string, and how deep in objects and lists, follows from sums over the
ranges before it, one row a range; with them a second pass cuts each range into
list elements.  Only the pieces of elements that lie across a border are brought
together by key, and each element is parsed by itself, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.operators.quality import ConstraintError, assert_none
from gridlark.scratch import Scratch

QUOTE, BACKSLASH, OPEN, CLOSE, LIST, END = (ord(c) for c in '"\\{}[]')
#: Which bytes matter, and what braces and brackets add to the depth of objects and lists.
MATTERS, OBJECTS, LISTS = (np.zeros(256, np.int8) for _ in range(3))
MATTERS[[QUOTE, OPEN, CLOSE, LIST, END]] = 1
OBJECTS[[OPEN, CLOSE]] = 1, -1
LISTS[[LIST, END]] = 1, -1
#: Elements of a range, as a number of bits.
PLACES = 40
TEXTS = 1 << 22


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Bytes up to each ``}``, which is left out, in the order of their range."""
    read = spark.read.option("lineSep", "}").text(path)
    meta = {"file": "file_path", "block": "file_block_start", "file_bytes": "file_size"}
    return read.select(F.col("value").cast("binary").alias("value"), *[F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], list[bytes]]]:
    """``(file, block, file_bytes)`` with some pieces of this range, in their order."""
    for batch in batches:
        blocks, files = batch.column("block").to_numpy(), batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy()
        starts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1 if len(blocks) else []
        for at, end in zip([0, *starts], [*starts, len(blocks)], strict=True):
            if end > at:
                yield (files[at].as_py(), int(blocks[at]), batch.column("file_bytes")[at].as_py()), batch.column("value").slice(at, end - at).to_pylist()


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and kinds of quotes, braces and brackets, and quotes up to each of them.

    ``text`` begins after a ``}`` or at the document's start, so never after a backslash.
    """
    a = np.frombuffer(text, np.uint8)
    places = np.flatnonzero(MATTERS[a])
    kinds = a[places]
    if BACKSLASH in text:
        slashes = a == BACKSLASH
        n = np.arange(len(a))
        plain = np.maximum.accumulate(np.where(slashes, -1, n))  # the last byte before that is none
        before = np.where(places > 0, places - 1 - plain[places - 1], 0)
        kept = (kinds != QUOTE) | (before % 2 == 0)
        places, kinds = places[kept], kinds[kept]
    return places, kinds, np.cumsum(kinds == QUOTE)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: its bytes and quotes, and what its braces and brackets add up
    to if it begins outside a string, or inside."""
    found: dict[tuple[str, int, int], np.ndarray] = {}
    for key, pieces in _ranges(batches):
        text = b"}".join(pieces) + b"}"
        _, kinds, quotes = _marks(text)
        some = [len(text), int(quotes[-1]) if len(quotes) else 0]
        held = found.setdefault(key, np.zeros(6, np.int64))
        even = (quotes + held[1]) % 2 == 0
        for part in (even, ~even):
            some += [int(OBJECTS[kinds[part]].sum()), int(LISTS[kinds[part]].sum())]
        held += some
    cols = list(zip(*[(*k, *v.tolist()) for k, v in found.items()], strict=True))
    if cols:
        yield pa.record_batch([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], SUMS)


SUMS = ["file", "block", "file_bytes", "bytes", "quotes", "objects_0", "lists_0", "objects_1", "lists_1"]


def _starts(sums: list[tuple]) -> dict[tuple[str, int], tuple[int, bool, int, int, bool]]:
    """For each range its number in its file, whether it begins in a string, how deep in
    objects and lists, and whether its last piece has no brace after it."""
    out, now, at = {}, None, (0, 0, 0, 0, 0)
    for file, block, size, length, quotes, o0, l0, o1, l1 in sorted(sums):
        number, inside, objects, lists, before = at if file == now else (0, 0, 0, 0, 0)
        # the reader does not say whether a file's last piece had its brace; the file's length does
        out[file, block] = (number, bool(inside), objects, lists, before + length > size)
        o, n = (o1, l1) if inside else (o0, l0)
        now, at = file, (number + 1, (inside + quotes) % 2, objects + o, lists + n, before + length)
    return out


class _Range:
    """The elements of one range, taken from its pieces as they come."""

    def __init__(self, file: str, start: tuple[int, bool, int, int, bool]):
        self.file, (number, self.inside, self.objects, self.lists, self.no_brace) = file, start
        self.number, self.held, self.carry = number << PLACES, None, []
        self.joins = number > 0 and (self.inside or self.objects > 1)  # begins within an element

    def take(self, pieces: list[bytes]) -> list[tuple]:
        """Rows of the elements that end in these pieces; the last piece waits for what follows."""
        some = pieces if self.held is None else [self.held, *pieces]
        self.held = some.pop()
        return self._cut(b"}".join(some) + b"}") if some else []

    def end(self) -> list[tuple]:
        rows = self._cut(self.held + (b"" if self.no_brace else b"}"))
        left = b"".join(self.carry)
        return [*rows, self._row(0, left, None)] if left else rows

    def _row(self, complete: int, text: bytes, body: bytes | None, objects: int | None = None, lists: int | None = None) -> tuple:
        whole = bool(complete) and not self.joins
        row = (self.file, self.number, whole, complete, objects, lists, body, None if body is not None else text)
        self.number, self.joins = self.number + 1, False
        return row

    def _cut(self, text: bytes) -> list[tuple]:
        places, kinds, quotes = _marks(text)
        outside = ((quotes + self.inside) % 2 == 0) & (kinds != QUOTE)
        quotes_at = places[kinds == QUOTE]
        at, kinds = places[outside], kinds[outside]
        objects, lists = self.objects + np.cumsum(OBJECTS[kinds], dtype=np.int64), self.lists + np.cumsum(LISTS[kinds], dtype=np.int64)
        last = np.flatnonzero((kinds == CLOSE) & (objects <= 1))
        ends = at[last] + 1
        begins = np.concatenate(([0], ends))[:-1].astype(np.int64)
        opens = at[kinds == OPEN]
        # an element's first brace outside strings; one that only closes has none
        first = np.append(opens, len(text))[np.searchsorted(opens, begins)]
        # one between a list's commas needs no look at what is before it; a name there has quotes
        named = np.searchsorted(quotes_at, begins) < np.searchsorted(quotes_at, first)
        plain = (objects[last] == 1) & (lists[last] == 1) & ~named & (first < ends)
        rows = []
        for b, f, e, simple, o, n in zip(begins.tolist(), first.tolist(), ends.tolist(), plain.tolist(), objects[last].tolist(), lists[last].tolist(), strict=True):
            if simple and not self.carry and not self.joins and self.number:
                rows.append(self._row(1, b"", text[f:e], o, n))
            else:
                rows.append(self._row(1, b"".join([*self.carry, text[b:e]]), None, o, n))
                self.carry = []
        rest = text[ends[-1] :] if len(ends) else text
        if rest:
            self.carry.append(rest)
        if len(places):
            self.inside = bool((quotes[-1] + self.inside) % 2)
        if len(at):
            self.objects, self.lists = int(objects[-1]), int(lists[-1])
        return rows


CUT = "file string, number long, whole boolean, complete int, objects long, lists long, body binary, text binary"
KINDS = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _cut_at(starts: dict):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, rows, size = None, None, [], 0

        def packed() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)], [c.split()[0] for c in CUT.split(", ")])

        for (file, block, _), pieces in _ranges(batches):
            if (file, block) != now:
                if one is not None:
                    rows += one.end()
                now, one = (file, block), _Range(file, starts[file, block])
            rows += one.take(pieces)
            size += sum(map(len, pieces))
            if size >= TEXTS and rows:
                yield packed()
                rows, size = [], 0
        if one is not None:
            rows += one.end()
        if rows:
            yield packed()

    return emit


def _elements(spark: SparkSession, path: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(file, number, body)`` of plain elements of a list, and ``(file, number, text,
    objects, lists, complete)`` of all others: a row for each object that a list or the
    root holds, with what stands before it; depths are those after it."""
    pieces = _pieces(spark, path)
    sums = ", ".join(f"{c} {'string' if c == 'file' else 'long'}" for c in SUMS)
    starts = _starts([tuple(r) for r in pieces.mapInArrow(_summed, sums).collect()])  # one row a range
    held = scratch.table(pieces.mapInArrow(_cut_at(starts), CUT), "cut")
    plain = held.where("body is not null").select("file", "number", F.col("body").cast("string").alias("body"))
    others = held.where("text is not null").drop("body").withColumn("text", F.col("text").cast("string"))
    # what lies across borders: few rows a range
    upto = W.partitionBy("file").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    across = others.where(~F.col("whole")).withColumn("element", F.coalesce(F.sum("complete").over(upto), F.lit(0).cast("long")))
    parts = F.sort_array(F.collect_list(F.struct("number", F.col("text").alias("v"))))
    joined = across.groupBy("file", "element").agg(F.min("number").alias("number"), parts.alias("p"), F.max("objects").alias("objects"), F.max("lists").alias("lists"), F.max("complete").alias("complete"))
    text = F.array_join(F.transform("p", lambda x: x["v"]), "").alias("text")
    cols = ["file", "number", "objects", "lists", "complete"]
    return plain, joined.select(*cols, text).unionByName(others.where("whole").select(*cols, "text"))


def documents(spark: SparkSession, path: str, schemas: dict[str, str], strict: bool) -> dict[str, DataFrame]:
    """The root lists of one or more documents, their elements parsed by ``schemas``.

    The strict form fails where a document lacks one of the lists, ends early or
    has an element that does not fit; the other leaves out what it cannot read.
    """
    scratch = Scratch(spark, "document")
    plain, found = _elements(spark, path, scratch)
    gap = F.regexp_extract("text", r'(?s)^\x{feff}?((?:"(?:[^"\\]++|\\.)*+"|[^"{]++)*+)', 0)
    first_brace = F.regexp_replace("text", r"(?s)^\x{feff}?\s*\{", "")  # of a document's first element, whose root opens before
    text = F.when(F.col("number") == 0, first_brace).otherwise(F.col("text"))
    found = found.withColumn("text", text).withColumn("gap", gap)
    names = F.regexp_extract_all("gap", F.lit(r'"([^"\\]*)"\s*:\s*\['), F.lit(1))
    body = F.substr("text", F.length("gap") + 1)
    held = scratch.table(found.select("file", "number", "objects", "lists", "complete", names.alias("names"), F.when((F.col("objects") == 1) & (F.col("lists") == 1), body).alias("body"), F.trim(F.regexp_replace("text", r"\s", "")).alias("rest")).withColumn("rest", F.when(F.col("complete") == 0, F.col("rest"))), "parsed")
    heads = held.where(F.size("names") > 0).select("file", "number", "names").collect()  # one row for each list of a root
    starts = sorted((r.file, r.number, r.names) for r in heads)
    if strict:
        assert_none(held.where("rest <> ''").select("file"), "A document ends early")
        broken = held.groupBy("file").agg(F.count_if((F.col("objects") == 0) & (F.col("lists") == 0)).alias("roots")).where("roots <> 1")
        assert_none(broken, "A document is not one object")
        files = [r.file for r in held.select("file").distinct().collect()]  # one name a document
        have = {f: {n for g, _, ns in starts if g == f for n in ns} for f in files}
        lacking = sorted({x for f in files for x in set(schemas) - have[f]}) if files else sorted(schemas)
        if lacking:
            raise ConstraintError(f"A COCO document needs images, annotations and categories; absent: {lacking}")
    spans = []
    for (f, at, ns), nxt in zip(starts, [*starts[1:], (None, None, None)], strict=True):
        spans.append((f, ns[-1], at, nxt[1] if nxt[0] == f else None))
    of = spark.createDataFrame(spans, "of_file string, list string, low long, high long") if spans else spark.createDataFrame([], "of_file string, list string, low long, high long")
    inside = (F.col("file") == F.col("of_file")) & (F.col("number") >= F.col("low")) & (F.col("high").isNull() | (F.col("number") < F.col("high")))
    rows = plain.unionByName(held.where("body is not null").select(*plain.columns)).join(F.broadcast(of), inside)  # a row for each list of a root
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return {name: rows.where(F.col("list") == name).select(F.from_json("body", ddl, mode).alias("x")).select("x.*") for name, ddl in schemas.items()}
