"""Conversation repair: the cheapest edits that make the roles alternate.

Rows of a conversation are kept, given another role, deleted, or joined by new
rows with an empty text, so that the roles read ``(s?(ua)+)?``.  A dynamic
program over four states (nothing yet, after system, user, assistant) runs on
time-major tensors: conversations of similar length, aligned at their ends, are
updated together turn by turn, backward costs are kept, and the edits are then
traced forward, again for all of them at each turn.

Conversations above ``long`` rows are cut into segments by ranges of their order.
A segment's costs from each state to each other one are a small matrix; the
matrices give the backward costs at every border, segments are traced from all
four states, and what enters each segment says which trace holds.  Only the
report, whose hash runs over a whole repaired text, passes over such a
conversation in one task, row by row and without keeping rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
LONG, SEGMENT = 4096, 4096
BATCH_ROWS, BATCH_CHARS = 50_000, 32 << 20
NEVER = 1 << 50
# The space characters, the ends of a sentence, and the roles' initials.
SPACE, ENDS, INITIALS = " \t\n\x0b\x0c\r", ".!?", "sua"
OTHER = len(INITIALS)
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT, NOWHERE = range(5)
#: Where a kept row's initial leads from a state, and where a new row or a new role does.
LEADS = np.array([[SYSTEM, USER, NOWHERE, NOWHERE], [NOWHERE, USER, NOWHERE, NOWHERE], [NOWHERE, NOWHERE, ASSISTANT, NOWHERE], [NOWHERE, USER, NOWHERE, NOWHERE]])
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
TRAILING = (0, 2, 1, 0)
LEGAL = frozenset(("su", "ua", "au"))


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs by state once new rows may come first."""
    user = np.minimum(cost[..., USER], INSERT + cost[..., ASSISTANT])
    assistant = np.minimum(cost[..., ASSISTANT], INSERT + cost[..., USER])
    return np.stack([np.minimum(cost[..., s], INSERT + user) for s in (START, SYSTEM)] + [user, assistant], axis=-1)


ACCEPT = _inserted(np.array([0, NEVER, NEVER, 0]))


def _options(after: np.ndarray, initial: np.ndarray, fault: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs (conversation, state) of deleting, keeping and re-roling a turn's rows."""
    wide = np.concatenate([after, np.full((len(after), 1), NEVER)], axis=1)
    stays = np.where((fault == BLANK) | (fault == DUPLICATE), NEVER, more + CUT_OFF * (fault == TRUNCATED))[:, None]
    keep = np.take_along_axis(wide, LEADS[:, initial].T, axis=1) + KEEP + stays
    return after + DELETE + more[:, None], keep, after[:, NEXT] + REROLE + stays


def backward(initial: np.ndarray, fault: np.ndarray, more: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (turn, conversation, state) from before each turn to the end.

    ``initial``, ``fault`` and ``more`` (the price of a row's further copies) are
    (turn, conversation), ``end`` is (conversation, state).
    """
    cost = np.empty((len(initial) + 1, *end.shape), np.int64)
    cost[-1] = end
    for t in range(len(initial) - 1, -1, -1):
        cost[t] = np.minimum(_inserted(np.minimum.reduce(_options(cost[t + 1], initial[t], fault[t], more[t]))), NEVER)
    return cost


def trace(cost: np.ndarray, initial: np.ndarray, fault: np.ndarray, more: np.ndarray, start: np.ndarray, state: np.ndarray):
    """Edits of the cheapest repair, of equals the ASCII-least.

    ``start`` is each conversation's first turn.  Returns (turn, conversation)
    arrays of the state on arrival, the new rows before and the edit (0 delete,
    1 keep, 2 new role), and the last state.
    """
    shape, state = initial.shape, state.copy()
    arrived, new, edit = (np.zeros(shape, np.uint8) for _ in range(3))
    each = np.arange(shape[1])
    for t in range(shape[0]):
        live = start <= t
        arrived[t] = state
        delete, keep, _ = _options(cost[t + 1], initial[t], fault[t], more[t])
        while True:  # delete, insert, keep, new role: their initials in order
            now = cost[t, each, state]
            deletes = delete[each, state] == now
            inserts = live & ~deletes & (cost[t, each, NEXT[state]] + INSERT == now)
            if not inserts.any():
                break
            new[t] += inserts
            state = np.where(inserts, NEXT[state], state)
        keeps = ~deletes & (keep[each, state] == now)
        edit[t] = np.where(deletes, 0, np.where(keeps, 1, 2))
        state = np.where(~live | deletes, state, np.where(keeps, LEADS[state, initial[t]], NEXT[state]))
    return arrived, new, edit, state


class Report:
    """What is returned of one conversation, row by row."""

    def __init__(self):
        self.first = self.last = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit, self.hash, self.empty = [], hashlib.sha256(), True

    def _write(self, role: str, text: str) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.empty = False
        self.hash.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def _new(self, state: int, n: int) -> int:
        for _ in range(n):
            state = int(NEXT[state])
            self._write(ROLE_OF[state], "")
        self.cost += INSERT * n
        return state

    def add(self, turn, role: str, text: str, copies: int, fault: int, arrived: int, new: int, edit: int) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        initial = role[:1]
        self.illegal += copies - 1 + (self.before is not None and self.before + initial not in LEGAL)
        self.before = initial
        self.blank += copies if fault == BLANK else 0
        self.truncated += fault == TRUNCATED
        self.duplicate += (copies if fault == DUPLICATE else 0) if fault in (BLANK, DUPLICATE) else copies - 1
        state = self._new(arrived, new)
        self.audit.append("I" * new + "DKR"[edit] + "D" * (copies - 1))
        self.cost += DELETE * (copies - 1) + (DELETE, KEEP, REROLE)[edit] + (CUT_OFF if edit and fault == TRUNCATED else 0)
        if edit:
            self._write(role if edit == 1 else ROLE_OF[int(NEXT[state])], text)

    def row(self, last_state: int) -> tuple:
        n = TRAILING[last_state]
        self._new(last_state, n)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit) + "I" * n, self.hash.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TYPES = ", ".join([f"{c} long" for c in COUNTS] + ["audit string", "repaired_sha256 string"])
EMPTY = Report().row(START)


def _reports(key: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(EMPTY)
    kinds = [pa.int64()] * len(COUNTS) + [pa.string()] * 2
    return pa.record_batch([pa.array(key, pa.string()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["key", *COUNTS, "audit", "repaired_sha256"])


def _aligned(sizes: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Buckets of sequences, rows one after another in ``columns``, by length.

    Yields the members, their first turns, the places of their rows in the
    (turn, member) tensors, the rows, and a tensor for each column; sequences end
    at the same turn.
    """
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    bucket = np.where(sizes > 0, np.ceil(np.log2(np.maximum(sizes, 1))), -1).astype(int)
    for b in np.unique(bucket):
        who = np.flatnonzero(bucket == b)
        long = int(sizes[who].max())
        member = np.repeat(np.arange(len(who)), sizes[who])
        within = np.arange(len(member)) - np.repeat(np.cumsum(sizes[who]) - sizes[who], sizes[who])
        rows, turn = first[who][member] + within, long - sizes[who][member] + within
        tensors = []
        for c in columns:
            x = np.zeros((long, len(who)), np.int64)
            x[turn, member] = c[rows]
            tensors.append(x)
        yield who, long - sizes[who], (turn, member), rows, tensors


def _repair(rows: list[tuple], sizes: list[int]) -> list[tuple]:
    """Reports of whole conversations from their rows (turn, role, text, initial, fault)."""
    sizes = np.array(sizes, np.int64)
    initial, fault = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
    got = np.zeros((3, len(rows)), np.uint8)
    last = np.zeros(len(sizes), np.int64)
    for who, start, places, at, (i, f) in _aligned(sizes, initial, fault):
        more = np.zeros_like(i)
        cost = backward(i, f, more, np.broadcast_to(ACCEPT, (len(who), len(ACCEPT))))
        *found, last[who] = trace(cost, i, f, more, start, np.zeros(len(who), np.int64))
        for k, x in enumerate(found):
            got[k, at] = x[places]
    out, k = [], 0
    edits = got.T.tolist()
    for n, state in zip(sizes.tolist(), last.tolist(), strict=True):
        report = Report()
        for (turn, role, text, _, fault_), edit in zip(rows[k : k + n], edits[k : k + n], strict=True):
            report.add(turn, role, text, 1, fault_, *edit)
        out.append(report.row(state))
        k += n
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that come in one after another, in batches of bounded size."""
    keys, sizes, rows, seen, chars = [], [], [], set(), 0
    for batch in batches:
        for key, turn, role, text, initial, fault, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not keys or keys[-1] != key:
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield _reports(keys, _repair(rows, sizes))
                    keys, sizes, rows, chars = [], [], [], 0
                keys.append(key)
                sizes.append(0)
                seen = set()
            for _ in range(copies):
                own = fault if fault == BLANK else DUPLICATE if (role, text) in seen else fault
                seen.add((role, text))
                rows.append((turn, role, text, initial, own))
                chars += len(text)
                sizes[-1] += 1
    if keys:
        yield _reports(keys, _repair(rows, sizes))


# conversations in segments ------------------------------------------------------


def _segments(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[tuple]:
    """Whole segments, several at once: (keys, segments), sizes, and the columns."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= rows:
            ends = _ends(held)
            if len(ends) > 1:
                yield held.slice(0, ends[-2]), ends[:-1]
                held = held.slice(ends[-2])
    if held is not None and held.num_rows:
        yield held, _ends(held)


def _ends(t: pa.Table) -> list[int]:
    key, seg = t.column("key").to_pylist(), t.column("seg").to_pylist()
    return [i for i in range(1, len(key)) if key[i] != key[i - 1] or seg[i] != seg[i - 1]] + [len(key)]


def _tensors(t: pa.Table, ends: list[int]) -> tuple:
    sizes = np.diff([0, *ends])
    return sizes, *(t.column(c).to_numpy() for c in ("initial", "fault", "more"))


def _named(t: pa.Table, ends: list[int]) -> list[pa.Array]:
    rows = pa.array([e - 1 for e in ends], pa.int64())
    return [t.column(c).combine_chunks().take(rows) for c in ("key", "seg")]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs from each state before a segment to each after it."""
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for t, ends in _segments(batches):
        sizes, *cols = _tensors(t, ends)
        out = np.empty((len(sizes), 4, 4), np.int64)
        for who, start, _, _, tensors in _aligned(sizes, *cols):
            for to in range(4):
                cost = backward(*tensors, np.broadcast_to(unit[to], (len(who), 4)))
                out[who, :, to] = cost[start, np.arange(len(who))]
        yield pa.record_batch([*_named(t, ends), pa.array(out.reshape(-1, 16).tolist(), pa.list_(pa.int64()))], ["key", "seg", "matrix"])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs after each segment, from a conversation's last one backwards."""
    now, key = ACCEPT, ()
    for batch in batches:
        ends = []
        for k, m in zip(batch.column("key").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
            now, key = (now, key) if k == key else (ACCEPT, k)
            ends.append(now.tolist())
            now = np.minimum((np.array(m).reshape(4, 4) + now).min(axis=1), NEVER)
        yield pa.record_batch([batch.column("key"), batch.column("seg"), pa.array(ends, pa.list_(pa.int64()))], ["key", "seg", "end"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's edits for the four states before its segment; the last row also has the four states after it."""
    for t, ends in _segments(batches):
        sizes, *cols = _tensors(t, ends)
        end = np.array(t.column("end").combine_chunks().take(pa.array([e - 1 for e in ends])).to_pylist(), np.int64)
        edits, exits = np.zeros((t.num_rows, 4, 3), np.uint8), np.zeros((len(sizes), 4), np.uint8)
        for who, start, places, at, tensors in _aligned(sizes, *cols):
            cost = backward(*tensors, end[who])
            for state in range(4):
                *found, exits[who, state] = trace(cost, *tensors, start, np.full(len(who), state))
                for k, x in enumerate(found):
                    edits[at, state, k] = x[places]
        last = [None] * t.num_rows
        for k, e in enumerate(ends):
            last[e - 1] = exits[k].tobytes()
        cols = [t.column(c).combine_chunks() for c in ("key", "seg", "id")]
        yield pa.record_batch([*cols, pa.array([e.tobytes() for e in edits], pa.binary()), pa.array(last, pa.binary())], ["key", "seg", "id", "edits", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each segment, from a conversation's first one on."""
    state, key = START, ()
    for batch in batches:
        into = []
        for k, x in zip(batch.column("key").to_pylist(), batch.column("exits").to_pylist(), strict=True):
            state, key = (state, key) if k == key else (START, k)
            into.append(state)
            state = x[state]
        yield pa.record_batch([batch.column("key"), batch.column("seg"), pa.array(into, pa.int32())], ["key", "seg", "enter"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of traced conversations; nothing of a row is kept."""
    key, report, state = None, None, START
    for batch in batches:
        keys, done = [], []
        for k, turn, role, text, copies, fault, enter, edits, exits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if report is None or k != key:
                if report is not None:
                    keys.append(key)
                    done.append(report.row(state))
                key, report = k, Report()
            report.add(turn, role, text, copies, fault, *edits[3 * enter : 3 * enter + 3])
            if exits is not None:
                state = exits[enter]
        yield _reports(keys, done)
    if report is not None:
        yield _reports([key], [report.row(state)])


def _in_segments(rows: DataFrame, scratch: Scratch, segment: int) -> DataFrame:
    """Reports of the conversations of ``rows``, however long."""
    order = ["key", "turn", "role", "text"]
    same = rows.where("copies > 0").withColumn("h", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    one = same.groupBy("key", "turn", "role", "h").agg(*[F.first(c).alias(c) for c in ("text", "initial", "fault")], F.sum("copies").alias("copies"))
    numbered = one.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    numbered = scratch.table(numbered, "numbered")
    first = numbered.groupBy("key", "h").agg(F.min("id").alias("id")).select("id", F.lit(1).alias("is_first"))
    fault = F.when((F.col("fault") != BLANK) & F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    features = numbered.select("key", "id", "initial", "fault", "copies").join(first, "id", "left")
    features = features.select("key", F.expr(f"id div {segment}").alias("seg"), "id", "initial", fault.cast("long").alias("fault"), (DELETE * (F.col("copies") - 1)).alias("more"))
    features = scratch.table(features, "features")  # a partition's ids start anew, far above the last one's: no segment spans two
    in_order = features.repartition("key", "seg").sortWithinPartitions("key", "seg", "id")
    matrix = in_order.mapInArrow(_matrices, "key string, seg long, matrix array<long>")
    end = matrix.repartition("key").sortWithinPartitions("key", F.desc("seg")).mapInArrow(_borders, "key string, seg long, end array<long>")
    end = scratch.table(end, "ends")
    traced = features.join(end, ["key", "seg"]).repartition("key", "seg").sortWithinPartitions("key", "seg", "id").mapInArrow(_traces, "key string, seg long, id long, edits binary, exits binary")
    traced = scratch.table(traced, "traced")
    enter = traced.where("exits is not null").select("key", "seg", "exits").repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_entries, "key string, seg long, enter int")
    texts = numbered.select("id", "turn", "role", "text", "copies").join(features.select("id", "fault"), "id").join(traced.join(enter, ["key", "seg"]), "id")
    texts = texts.repartition("key").sortWithinPartitions("key", "id").select("key", "turn", "role", "text", "copies", "fault", "enter", "edits", "exits")
    return texts.mapInArrow(_finished, f"key string, {TYPES}")


def repaired(rows: DataFrame, scratch: Scratch, long: int = LONG, segment: int = SEGMENT, copies: Column | None = None) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text): what was found
    and the cheapest repair.

    Rows go by turn, null turns first, ties by role and text; ``copies`` repeats a
    row adjacently (0: it is gone, though its conversation is reported).  Null
    roles and texts are one space; null ids are one conversation.  A role counts by
    its first character as it stands, so an empty or other role has to be changed
    or deleted.  An empty table gives no rows; other columns are ignored.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(NONE)
    first, place = F.left(role, F.lit(1)), F.lit(OTHER)
    for k, initial in enumerate(INITIALS):
        place = F.when(first == initial, k).otherwise(place)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    n = F.lit(1) if copies is None else copies
    parts = rows.select(
        "conv_id", key.alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), place.cast("long").alias("initial"), fault.cast("long").alias("fault"), n.cast("long").alias("copies")
    )
    ids = parts.select("key", "conv_id").groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.count("*").alias("n"))
    ids = scratch.table(ids, "ids")
    longs = ids.where(F.col("n") > long).select("key")
    feed = parts.select("key", "turn", "role", "text", "initial", "fault", "copies")
    order = ["key", "turn", "role", "text"]
    if longs.isEmpty():
        found = feed.repartition("key").sortWithinPartitions(*order).mapInArrow(_whole, f"key string, {TYPES}")
    else:
        short = feed.join(longs, "key", "left_anti").repartition("key").sortWithinPartitions(*order).mapInArrow(_whole, f"key string, {TYPES}")
        found = short.unionByName(_in_segments(feed.join(longs, "key", "left_semi"), scratch, segment))
    out = ids.select("key", "conv_id").join(found, "key", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(e)).alias(c) for c, e in zip((*COUNTS, "audit", "repaired_sha256"), EMPTY, strict=True)])


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with faults that follow from ``crc32(conv_id:turn) % 20``, and how often each stands."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(shown("text"), ENDS, "")).otherwise(shown("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(shown("role"))
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("_kind")).select("conv_id", "turn", role.alias("role"), text.alias("text"), "_kind")
    return out, F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired; see ``damaged`` and ``repaired``."""
    rows, copies = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repaired(rows, Scratch(spark, "op12"), copies=copies)


def _sql() -> str:
    shown = "coalesce({0}::VARCHAR, ' ')".format
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"  # Fixed value: the CRC-32 polynomial
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda q: ascii(q)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    space, bare = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)", "rtrim(text, spaces)"

    def path(s: str, cost: str, edit: str, body: str = "") -> str:
        return f"struct_pack(c := {s}.c + {cost}, a := {s}.a || '{edit}', b := " + (f"list_append({s}.b, {body})" if body else f"{s}.b") + ")"

    least = lambda *p: f"list_sort([{', '.join(p)}])[1]"
    drop = lambda s: path(s, "4", "D")
    stays = "(CASE WHEN fault IN ('b', 'd') THEN 1000000 WHEN fault = 't' THEN 3 ELSE 0 END)"
    kept = lambda s, i: path(s, f"{stays} + CASE WHEN i = '{i}' THEN 0 ELSE 1000000 END", "K", "role || ':' || text")
    other = lambda s, r: path(s, f"{stays} + 3", "R", f"'{r}:' || text")
    into = lambda s, r: path(s, "3", "I", f"'{r}:'")
    state = lambda c: f"struct_pack(c := {c}::BIGINT, a := '', b := []::VARCHAR[])"
    more = f"SELECT *, {least('u', into('r3', 'assistant'))} AS r4 FROM (SELECT *, s3 AS u, {least('s2', into('s0', 'user'), into('s1', 'user'), into('s3', 'user'))} AS r3 FROM (%s))"
    turn = more % "SELECT s.key, r.k, s0, s1, s2, s3, r.role, r.text, r.i, r.fault FROM step s JOIN faults r ON r.key = s.key AND r.k = s.k + 1"
    return f"""WITH RECURSIVE named AS (SELECT conv_id, coalesce('=' || conv_id, '') AS key, turn, {shown('role')} AS role, {shown('text')} AS text, {shown('conv_id')} || ':' || {shown('turn')} AS name FROM conversations),
  kinds AS (SELECT *, ({crc}) % 20 AS kind, {space} AS spaces FROM named),
  hurt AS (SELECT key, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
    spaces, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
  placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS k, substr(role, 1, 1) AS i FROM hurt),
  faults AS (SELECT *, CASE WHEN {bare} = '' THEN 'b' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY k) > 1 THEN 'd' WHEN right({bare}, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY key ORDER BY k) AS before FROM placed),
  counts AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM faults GROUP BY key),
  step AS (SELECT DISTINCT key, 0::BIGINT AS k, {state(0)} AS s0, {state(1000000)} AS s1, {state(1000000)} AS s2, {state(1000000)} AS s3 FROM named
    UNION ALL SELECT key, k, {drop('s0')}, {least(drop('s1'), kept('s0', 's'))},
      {least(drop('r3'), *[f(s, v) for s in ('s0', 's1', 'r4') for f, v in ((kept, 'u'), (other, 'user'))])},
      {least(drop('r4'), kept('r3', 'a'), other('r3', 'assistant'))} FROM ({turn})),
  ended AS (SELECT key, {least('s0', 'r4')} AS best FROM ({more % "SELECT s.* FROM step s LEFT JOIN counts c ON s.key = c.key WHERE s.k = coalesce(c.n, 0)"}))
SELECT ids.conv_id, {', '.join(f'coalesce(c.{x}, 0)::BIGINT AS {x}' for x in COUNTS[:-1])}, best.c AS cost, best.a AS audit, sha256(array_to_string(best.b, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM named) ids JOIN ended e ON ids.key = e.key LEFT JOIN counts c ON ids.key = c.key"""


OP12_SQL = _sql()
