"""Benchmark decontamination over canonical templates.

Words become a template: numbers, units and capitalised words turn into typed
placeholders, he and she into one word, everything else is lower-cased.  A
capitalised word that begins a sentence is a name unless it is one of a fixed list of
common openers; as it may be neither, an item is also indexed with it as a word.
Windows of five template words are hash-joined with the benchmark's.  A document
holds an item when windows that agree on the slots are at least 80 % of the item's
places, or cover at least 80 % of the words that its windows cover, or cover
13 words in a row, as an excerpt does: along one alignment of document and item, one item value
must always stand for the same document value.  So a question whose numbers,
names or units were exchanged is found like a verbatim one.

Scripts without spaces have a word for each character, of which an excerpt needs twice as many.

Items that share all windows and whose values are alike in the same places are one
class, found or not found as one, so a template with thousands of items is joined and
reported once.  Windows that take a name for a word are an item's own, beside its class;
they matter only where a document holds one of them.

An item whose windows cover less than half of its words, as one dense in numbers, is
indexed by template windows of ten words instead or, where these cover too little,
by five words as they stand; one of fewer than five words by all of them.

The benchmark's windows first mark a bitmap of fixed size; only document windows
that hit it leave Python, and the join with the windows themselves is exact.  It
first looks for a class's gate alone: those of its windows that the fewest classes
share, as many as leave a rest that cannot be enough.  A window of a stock phrase
is thus joined only with items that the document may hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import mixed, windows

SIZE, LONG_SIZE, LITERALS, COVERED, RUN, MAP_BITS, FEW_WINDOWS = 5, 10, 3, 0.8, 13, 24, 200_000
NUMBER, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("<number>", "<name>", "<unit>"))

#: Words that are a unit when they follow a number, and anywhere if they have four letters.
UNITS = frozenset(
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg t ton tons lb lbs ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
    "pound pounds degree degrees mph kph hz khz mhz ghz w kw v volt volts watt watts meter meters metre metres kilometer kilometers kilometre kilometres "
    "centimeter centimeters centimetre centimetres gram grams kilogram kilograms".split()
)
#: Words of one kind whoever is meant.
PRONOUNS = frozenset("he she him her his hers himself herself".split())
#: Words that often begin a sentence and are no names.
OPENERS = frozenset(
    "a about after all also although an and another any are as at be because before both but by can compute consider could did do does each every explain few find first for from given "
    "had has have how however i if in is it its let list many more most my name next no not now of on once one or other our over read say see select show since so solve some "
    "state such suppose than that the their them then there these they this those through to under until up use was we were what when where whether which while who whom whose why will "
    "with would write yes you your".split()
)

#: Blocks of scripts that are written without spaces (Thai, Lao, Myanmar, Khmer, kana, Bopomofo, Han).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
ENDS = ".!?\n\u3002\uff01\uff1f"

_TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|[^\W\d_{UNSPACED}]+|[{UNSPACED}]|[{ENDS}]")
_CHARACTER = re.compile(f"[{UNSPACED}]")
_LIT, _NUM, _TITLE, _END, _UNIT, _LONG_UNIT, _OPENER = range(7)


class _Kinds(dict):
    """Token -> (hash of its lower case, kind), remembered up to ``limit`` tokens."""

    limit = 200_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        low = token.lower()
        title = len(token) > 1 and token[0].isupper() and token[1:].islower()
        if token in ENDS:
            kind = _END
        elif token[0].isdigit():
            kind = _NUM
        elif low in UNITS:
            kind = _LONG_UNIT if len(low) > 3 else _UNIT
        elif low in PRONOUNS:
            kind, low = _LIT, "<pronoun>"
        elif title:
            kind = _OPENER if low in OPENERS else _TITLE
        else:
            kind = _LIT
        self[token] = out = (xxhash.xxh64_intdigest(low) & ((1 << 64) - 8)) | kind
        return out


class Template:
    """A text's words: ``hashes`` of the template, which of them are placeholders
    (``slots``) and which of these begin a sentence (``unsure``), and the hashes of the words as
    they stand (``literal``)."""

    def __init__(self, text: str | None, known: _Kinds):
        raw = _TOKEN.findall(text or "")
        coded = np.fromiter(map(known.__getitem__, raw), np.uint64, len(raw))
        kind = (coded & np.uint64(7)).astype(np.int8)
        after = np.empty(len(raw), np.int8)
        after[:1], after[1:] = _END, kind[:-1]
        literal = coded | np.uint64(7)
        first = after == _END
        name, unit, number = (kind == _TITLE) | ((kind == _OPENER) & ~first), (kind == _LONG_UNIT) | ((kind == _UNIT) & (after == _NUM)), kind == _NUM
        hashes = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, literal)))
        words = kind != _END
        self._raw, self._at = raw, np.flatnonzero(words)
        self.hashes, self.slots, self.unsure, self.literal = (x[words] for x in (hashes, number | name | unit, name & first, literal))

    def windows(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of windows: of ``kind`` template words with enough literal
        ones, or of ``-kind`` words as they stand."""
        size = abs(kind)
        if len(self.hashes) < size:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if kind < 0:
            return windows(self.literal, size), np.arange(len(self.literal) - size + 1)
        literals = np.concatenate([[0], np.cumsum(~self.slots)])
        at = np.flatnonzero(literals[size:] - literals[:-size] >= LITERALS)
        return windows(self.hashes, size)[at], at

    def sure(self) -> Template:
        """With the names that begin a sentence taken for words."""
        out = copy(self)
        out.hashes, out.slots = np.where(self.unsure, self.literal, self.hashes), self.slots & ~self.unsure
        return out

    def values(self, at: int, size: int) -> list[str]:
        """What stands at the placeholders; words as they stand have none."""
        return [self._raw[k].lower() for k in self._at[at : at + size][self.slots[at : at + size]]] if size > 0 else []


def _marks(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)


#: ``kind``: as in ``Template.windows``.
ROWS = "id long, h long, at int, slots array<string>, kind int"
#: ``form``: windows that are joined as one, those of the class itself or with an item's ``own``; ``run``: words in a row that are enough.
FORMS = "item_id long, class long, form long, run int, h long, at int, slots array<string>, kind int, own boolean"


def _of_item(t: Template) -> tuple[int, dict[tuple[int, int], list[str]], dict[tuple[int, int], list[str]]]:
    """What an item is indexed by: the kind of its windows, slot values by (hash, place)
    of the template's, and of those that take a name for a word."""
    n = len(t.hashes)
    for kind in (SIZE, LONG_SIZE, -min(n, SIZE)):
        found: list[dict] = []
        for x in (t, t.sure()) if kind > 0 and t.unsure.any() else (t,):
            h, at = x.windows(kind)
            found.append({(v, k): x.values(k, kind) for v, k in zip(h.view(np.int64).tolist(), at.tolist(), strict=True)})
        template, own = found[0], {x: v for x, v in found[-1].items() if x not in found[0]}
        if 2 * len({w for _, k in (*template, *own) for w in range(k, k + abs(kind))}) >= n:
            return (kind, template, own) if template else (kind, own, {})
    raise AssertionError("words as they stand cover all of an item")


def _forms(t: Template) -> Iterator[tuple[int, int, int, int, int, list[str], int, bool]]:
    """An item's class, and rows of the class's form and of its own form if it has one:
    all in ``FORMS`` but the id.  Values are numbers in order of first use, for only their
    likeness matters."""
    kind, template, own = _of_item(t)
    unspaced = sum(1 for k in t._at.tolist() if _CHARACTER.match(t._raw[k]))
    run = RUN * (2 if 2 * unspaced > len(t.hashes) else 1)
    numbers: dict[str, str] = {}

    def canonical(rows: dict) -> list[tuple[int, int, list[str]]]:
        return [(at, h, [numbers.setdefault(v, str(len(numbers))) for v in slots]) for (h, at), slots in sorted(rows.items(), key=lambda x: x[0][::-1])]

    def digest(*rows: list) -> int:
        return xxhash.xxh64_intdigest(repr((kind, run, rows))) - (1 << 63)

    shared, mine = canonical(template), canonical(own)
    of_class = digest(shared)
    for form, rows in ((of_class, [(shared, False)]), (digest(shared, mine), [(shared, False), (mine, True)])):
        if rows[-1][0]:
            for several, is_own in rows:
                for at, h, slots in several:
                    yield of_class, form, run, h, at, slots, kind, is_own


def _of_document(t: Template, bitmap: np.ndarray, kinds: tuple[int, ...]) -> Iterator[tuple[int, int, list[str], int]]:
    """Of a document's windows of the items' kinds, what the bitmap marks."""
    for kind in kinds:
        h, at = t.windows(kind)
        hit = np.flatnonzero(bitmap[_marks(h)])
        for v, k in zip(h[hit].view(np.int64).tolist(), at[hit].tolist(), strict=True):
            yield v, k, t.values(k, kind), kind


def _emitted(of, schema: pa.Schema):
    """Rows of ``schema``, an id and what ``of`` makes of a text's template."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Kinds()
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for row in of(Template(text, known)):
                    for column, v in zip(rows, (i, *row), strict=True):
                        column.append(v)
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(rows, schema, strict=True)], schema=schema)

    return emit


_LONG, _INT, _SLOTS = pa.int64(), pa.int32(), pa.list_(pa.string())
_ROWS = pa.schema([("id", _LONG), ("h", _LONG), ("at", _INT), ("slots", _SLOTS), ("kind", _INT)])
_FORMS = pa.schema([("item_id", _LONG), ("class", _LONG), ("form", _LONG), ("run", _INT), ("h", _LONG), ("at", _INT), ("slots", _SLOTS), ("kind", _INT), ("own", pa.bool_())])


def _enough(places: np.ndarray, size: int, total: int, words: int, covered: float, run: int) -> bool:
    """Whether these places of a form's windows, sorted, show that it is held."""
    if not len(places):
        return False
    gaps = np.minimum(np.diff(places), size)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(places) > size) + 1])
    ends = np.concatenate([starts[1:] - 1, [len(places) - 1]])
    return len(places) >= covered * total or gaps.sum() + size >= covered * words or (places[ends] - places[starts]).max() + size >= run


def _gates(covered: float):
    """Of each form the hashes at so many of its places, those of the fewest forms
    first, that the others are not enough; or its own hashes, without which its class
    is found in its stead, where fewer forms share these."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, hs, kinds = [], [], []
            for form, run, rows in zip(batch.column("form").to_pylist(), batch.column("run").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                shared: dict[int, int] = {}
                for r in rows:
                    shared[r["at"]] = shared.get(r["at"], 0) + r["forms"]
                order = sorted(shared, key=lambda k: (shared[k], k))
                every = np.array(sorted(shared))
                kind = rows[0]["kind"]  # that of all its windows
                size = abs(kind)
                words = int(np.minimum(np.diff(every), size).sum()) + size
                low, high = 1, len(order)
                while low < high:
                    k = (low + high) // 2
                    low, high = (k + 1, high) if _enough(np.array(sorted(order[k:])), size, len(order), words, covered, run) else (low, k)
                own = [r for r in rows if r["own"]]
                if own and sum(r["forms"] for r in own) < sum(shared[k] for k in order[:low]):
                    gate = {r["h"] for r in own}
                else:
                    gate = {r["h"] for r in rows if r["at"] in set(order[:low])}
                forms += [form] * len(gate)
                hs += gate
                kinds += [kind] * len(gate)
            yield pa.record_batch([pa.array(forms, _LONG), pa.array(hs, _LONG), pa.array(kinds, _INT)], ["form", "h", "kind"])

    return emit


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window hashes or packed bitmaps into one packed bitmap."""
    out = np.zeros(1 << MAP_BITS, bool)
    for batch in batches:
        if "h" in batch.schema.names:
            out[_marks(batch.column("h").to_numpy().view(np.uint64))] = True
        else:
            for x in batch.column("bits").to_pylist():
                out |= np.unpackbits(np.frombuffer(x, np.uint8)).view(bool)
    yield pa.record_batch([pa.array([np.packbits(out).tobytes()], pa.binary())], ["bits"])


def _indexed(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``FORMS`` of the benchmark's items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    return scratch.table(items.mapInArrow(_emitted(lambda t: _forms(t) if len(t.hashes) else (), _FORMS), FORMS), "items")


def _classes(indexed: DataFrame) -> DataFrame:
    """``(class, first, n_items)``."""
    return indexed.groupBy("class").agg(F.min("item_id").alias("first"), F.count_distinct("item_id").alias("n_items"))


def template_classes(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``(item_id, class_item, n_items)``: of each item the smallest one of its class, and
    how many there are; ``find_leaks`` reports the smallest.

    An item that repeats an id with another text has a row for each class; items
    without words are in no class; rows with a null id are ignored; empty tables give no rows.
    """
    indexed = _indexed(benchmark, scratch)
    return indexed.select("item_id", "class").distinct().join(_classes(indexed), "class").select("item_id", F.col("first").alias("class_item"), "n_items")


def find_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, covered: float = COVERED) -> DataFrame:
    """``(doc_id, item_id, n_items, coverage)``, one row for each document and class of
    items that it holds: the class's smallest item and its number of items, which
    ``template_classes`` lists; coverage is the larger of the shares of its places and of its words.

    An item of fewer than five words is held where all of them stand in a
    row, so one of a single word by every document with that word; items without words
    match nothing; null and empty texts, and rows with a null id, hold nothing;
    rows that repeat an id count as one document; an item that is repeated in the
    benchmark is in the class of the first; empty tables give no rows; other
    columns are ignored.
    """
    indexed = _indexed(benchmark, scratch)
    known = scratch.table(indexed.select("form", "run", "h", "at", "slots", "kind", "own").distinct(), "windows")
    packed = known.select("h").mapInArrow(_mapped, "bits binary").coalesce(1).mapInArrow(_mapped, "bits binary").collect()  # one row of fixed size
    bitmap = np.unpackbits(np.frombuffer(packed[0][0], np.uint8)).view(bool) if packed else np.zeros(1 << MAP_BITS, bool)
    kinds = tuple(sorted(x[0] for x in known.select("kind").distinct().collect()))  # seven at most

    given = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))
    hits = scratch.table(given.mapInArrow(_by_bitmap(shared, kinds), ROWS).withColumnRenamed("id", "doc_id"), "hits")

    shares = known.groupBy("h", "kind").agg(F.count_distinct("form").alias("forms"))
    of_form = known.join(shares, ["h", "kind"]).groupBy("form", "run").agg(F.collect_list(F.struct("h", "at", "kind", "own", "forms")).alias("rows"))  # an item's windows
    gates = scratch.table(of_form.mapInArrow(_gates(covered), "form long, h long, kind int"), "gates")
    if gates.count() <= FEW_WINDOWS:
        gates = F.broadcast(gates)
    may = scratch.table(hits.join(gates, ["h", "kind"]).select("doc_id", "form").distinct(), "may")

    named = known.select("form", "run", "h", "kind", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    if known.count() <= FEW_WINDOWS:
        named = F.broadcast(named)
    matched = may.join(named, "form").join(hits, ["doc_id", "h", "kind"]).withColumn("shift", F.col("at") - F.col("item_at"))
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda x: F.struct(x["item_slots"].alias("a"), x["slots"].alias("b")))
    width = F.abs("kind")
    words = F.sequence("item_at", F.col("item_at") + width - 1)
    lines = matched.groupBy("doc_id", "form", "shift").agg(
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"), F.array_sort(F.collect_set("item_at")).alias("places"), F.array_distinct(F.flatten(F.collect_set(words))).alias("words"), F.max(width).alias("size")
    )  # at most an item's windows in each
    agree = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x.a)))
    none = F.struct(F.lit(0).alias("first"), F.lit(0).alias("end"), F.lit(0).alias("longest"))

    def longer(run: F.Column, at: F.Column) -> F.Column:
        first, end = F.when(at <= run.end, run.first).otherwise(at), at + F.col("size")
        return F.struct(first.alias("first"), end.alias("end"), F.greatest(run.longest, end - first).alias("longest"))

    longest = F.aggregate("places", none, longer)["longest"]
    found = lines.where(agree).groupBy("doc_id", "form").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("m"), F.max(longest).alias("longest")
    )
    own = F.sequence("at", F.col("at") + width - 1)
    sizes = known.groupBy("form", "run").agg(F.count_distinct("at").alias("total"), F.size(F.array_distinct(F.flatten(F.collect_set(own)))).alias("of_words"))
    share = F.greatest(F.col("n") / F.col("total"), F.col("m") / F.col("of_words"))
    held = found.join(sizes, "form").withColumn("coverage", share).where((F.col("coverage") >= covered) | (F.col("longest") >= F.col("run")))
    of_class = indexed.select("form", "class").distinct()
    per_class = held.join(of_class, "form").groupBy("doc_id", "class").agg(F.max("coverage").alias("coverage"))
    return per_class.join(_classes(indexed), "class").select("doc_id", F.col("first").alias("item_id"), "n_items", "coverage")


def _by_bitmap(shared, kinds: tuple[int, ...]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(shared.value).view(bool)
        yield from _emitted(lambda t: _of_document(t, bitmap, kinds), _ROWS)(batches)

    return emit


def drop_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that hold no item, columns as given."""
    bad = scratch.table(find_leaks(docs, benchmark, scratch).select("doc_id").distinct(), "leaks")
    if bad.count() <= FEW_WINDOWS:
        bad = F.broadcast(bad)
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items; see ``find_leaks``."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "op8"))


def benchmark_template_classes(spark, sf_dir: str) -> DataFrame:
    """Which benchmark items are one; see ``template_classes``."""
    return template_classes(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "op8-classes"))
