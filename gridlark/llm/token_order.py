"""Training-order materialisation of token ids in fixed-stride binary shards.

Documents, in the order of their ids, become sequences of ``seq_len`` token ids,
the last one of a document padded.  Sequences are numbered 0 to N - 1 in that order
and a keyed Feistel permutation of the numbers, walked along its cycle until it
lands below N, gives each its global slot: an order that looks random and needs no
stored table.  Shard ``k`` holds the slots from ``k * per_shard`` on, in order, each
at a fixed stride, so a reader resumes at any slot by one division.

Numbers follow from the rows alone: documents are range-partitioned by id and text
hash, a task numbers its own sequences, and the tasks' counts, one row each, give
where a task starts.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the public vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQ_LEN, PER_SHARD, ROUNDS, MOST_SHARDS_PER_TASK, WAVES = 512, 16_384, 6, 64, 4
#: The pattern's engine fails on runs of white space of several times this length.
LONG_BLANK = 100_000
#: Fixed value: the characters that Unicode calls white space.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS, _BLANKS_BEFORE = regex.compile(_BLANK + "*+"), regex.compile(rf"(?r){_BLANK}*+")


def encoding(path: str = TOKENIZER):
    """The tokenizer of a vocabulary file and the id that ends a text."""
    import tiktoken

    with fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")[0].open_input_stream(path.split("://")[-1]) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def pieces(text: str) -> list[str]:
    """The text in parts that the pattern cuts as it cuts the whole, except that a
    run of ``LONG_BLANK`` or more white space is itself cut into runs of that length.

    The pattern takes such a run as one word, but for its last character where
    another word follows.
    """
    cuts, end = [0], 0
    for at in range(0, len(text), LONG_BLANK // 2):  # any long run holds one of these places
        if at < end or not (m := _BLANKS.match(text, at)).group():
            continue
        start, end = _BLANKS_BEFORE.match(text, 0, at).start(), m.end()
        if end - start >= LONG_BLANK:
            last = end if end == len(text) else end - 1
            cuts += [*range(start, last, LONG_BLANK), last]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if a < b]


def encoded(coder, text: str) -> np.ndarray:
    """Token ids of a text of any length."""
    if len(text) < LONG_BLANK:
        return coder.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([coder.encode_to_numpy(x, disallowed_special=()) for x in pieces(text)])


def id_type(end: int) -> np.dtype:
    """The little-endian type that holds all ids of a vocabulary and its end mark."""
    return np.dtype("<u2" if end < 1 << 16 else "<u4")


def feistel(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, applied to ``x``."""
    if n <= 1:
        return np.zeros(len(x), np.int64)
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, rounds, dtype=np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    while (late := out >= np.uint64(n)).any():
        out[late] = once(out[late])
    return out.astype(np.int64)


def _tokenised(path: str, seq_len: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoding(path)
        kind = id_type(end)
        part, i, stride = TaskContext.get().partitionId(), 0, seq_len * kind.itemsize
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoded(coder, text or "")
                n = len(ids) + 1
                padded = np.full(-(-n // seq_len) * seq_len, end, kind)
                padded[: n - 1] = ids
                raw = padded.tobytes()
                for k in range(-(-n // seq_len)):
                    for column, v in zip(rows, (i, doc, k, min(seq_len, n - k * seq_len), raw[k * stride : (k + 1) * stride]), strict=True):
                        column.append(v)
                    i += 1
                if len(rows[0]) >= 4096:
                    yield _sequences(part, rows)
                    rows = [[] for _ in range(5)]
            if rows[0]:
                yield _sequences(part, rows)

    return emit


def _sequences(part: int, rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array([part] * len(rows[0]), pa.int32()), *[pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]], ["part", "i", "doc_id", "seq_no", "n_tokens", "tokens"])


def _slotted(n: int, key: int, low: int, high: int):
    """Slots of the rows' numbers; rows whose slot is not in ``low`` .. ``high - 1`` stay behind."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = feistel(batch.column("index").to_numpy(), n, key)
            out = pa.record_batch([pa.array(slots), *[batch.column(x) for x in ("doc_id", "seq_no", "n_tokens", "tokens")]], ["slot", "doc_id", "seq_no", "n_tokens", "tokens"])
            yield out if low == 0 and high >= n else out.filter(pa.array((slots >= low) & (slots < high)))

    return emit


def _numbered(docs: DataFrame, scratch: Scratch, tokenizer: str, seq_len: int) -> tuple[DataFrame, int]:
    """``(index, doc_id, seq_no, n_tokens, tokens)`` of all sequences, and how many there are."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal rows may share an id, and a task should not need all of them: any order among them is the same
    order = ["doc_id", "h", "row"]
    given = given.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    given = given.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = given.mapInArrow(_tokenised(tokenizer, seq_len), "part int, i long, doc_id long, seq_no int, n_tokens int, tokens binary")
    rows = scratch.table(rows, "sequences", compression="zstd")
    parts = rows.groupBy("part").agg((F.max("i") + 1).alias("n"))  # a row for each task that wrote
    parts = parts.select("part", "n", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    parts = scratch.table(parts, "parts")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    numbered = rows.join(F.broadcast(parts.select("part", "first")), "part")
    return numbered.select((F.col("first") + F.col("i")).alias("index"), "doc_id", "seq_no", "n_tokens", "tokens"), total


def _placed(numbered: DataFrame, total: int, per_shard: int, key: int, shards: range) -> DataFrame:
    """The rows of some shards, in order; a partition holds whole shards."""
    low, high = shards.start * per_shard, min(total, shards.stop * per_shard)
    tasks = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_task = min(MOST_SHARDS_PER_TASK, -(-len(shards) // tasks))
    placed = numbered.mapInArrow(_slotted(total, key, low, high), "slot long, doc_id long, seq_no int, n_tokens int, tokens binary")
    placed = placed.repartitionById(-(-len(shards) // in_task), F.floor((F.col("slot") - low) / (per_shard * in_task)).cast("int")).sortWithinPartitions("slot")
    shard = F.floor(F.col("slot") / per_shard)
    return placed.select("slot", shard.cast("int").alias("shard"), ((F.col("slot") % per_shard) * F.length("tokens")).alias("byte_offset"), "doc_id", "seq_no", "n_tokens", "tokens")


def _shards(total: int, per_shard: int) -> int:
    return max(1, -(-total // per_shard))


def training_order(docs: DataFrame, scratch: Scratch, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = 20) -> DataFrame:
    """``(slot, shard, byte_offset, doc_id, seq_no, n_tokens, tokens)``, ordered by
    slot within a partition; a partition holds whole shards, one after another.

    ``tokens`` are ``seq_len`` little-endian ids of 16 bits (32 where the vocabulary
    needs them); after the ``n_tokens`` real ones, the last of a document being the
    end mark, comes padding with the end mark.  A null or empty text is the end mark
    alone; repeated rows are separate documents; null ids pass through, first in
    number; an empty table gives no rows; other columns are ignored.  The slots are
    the same however the rows are partitioned.
    """
    numbered, total = _numbered(docs, scratch, tokenizer, seq_len)
    return _placed(numbered, total, per_shard, key, range(_shards(total, per_shard)))


#: Hadoop's names of stores that pyarrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder of shards and the folder in it; one that pyarrow has none for is an error."""
    scheme, sep, rest = path.partition("://")
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if sep else path)
    except (pa.ArrowInvalid, NotImplementedError) as e:
        raise ValueError(f"Shards cannot be written to or read from {path}: name another folder by `to` or spark.checkpoint.dir ({e})") from None


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


INDEX = ("slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens")


def write_shards(ordered: DataFrame, to: str) -> DataFrame:
    """Write shards as files of fixed-stride rows below ``to``, a folder that all
    executors reach; returns the rows, lazily, without their tokens but with
    ``digest``, their xxHash64.

    ``ordered`` is as from ``training_order``.  A shard is written under a task's own
    name and then moved, so a retried or repeated run leaves whole files only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(to)
        system.create_dir(base, recursive=True)
        shard, out, part = None, None, f"{base}/.{uuid.uuid4().hex}"

        def done() -> None:
            if out is not None:
                out.close()
                system.move(part, f"{base}/{shard_name(shard)}")

        for batch in batches:
            digests = []
            for s, raw in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if s != shard:
                    done()
                    shard, out = s, system.open_output_stream(part)
                out.write(raw)
                digests.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
            yield pa.record_batch([*[batch.column(x) for x in INDEX], pa.array(digests, pa.int64())], [*INDEX, "digest"])
        done()

    return ordered.mapInArrow(write, "slot long, shard int, byte_offset long, doc_id long, seq_no int, n_tokens int, digest long")


def materialise(docs: DataFrame, scratch: Scratch, to: str | None = None, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = 20, waves: int = WAVES) -> DataFrame:
    """Write the documents' shards below ``to`` (a folder of ``scratch`` where none is
    named, which goes with it) and return the index of all sequences:
    ``(slot, shard, byte_offset, doc_id, seq_no, n_tokens, digest)``.

    Rows are treated as by ``training_order``; an empty table writes no shard.  A
    ``manifest.json`` beside the shards says how to read them.  Shards are written in
    ``waves``, ranges of them: each reads all sequences and shuffles its own, so that
    the disk holds the shuffle files of one wave beside the shards.  A folder on a
    store that shards cannot be written to, or one that holds further shards of
    another run, is an error before any is written.
    """
    to = to or f"{scratch.root}/shards"
    system, base = store(to)
    numbered, total = _numbered(docs, scratch, tokenizer, seq_len)
    n = _shards(total, per_shard)
    there = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    stale = [f.base_name for f in there if f.base_name.startswith("shard-") and f.base_name >= shard_name(n if total else 0)]
    if stale:
        raise ValueError(f"{to} holds shards of another run: {sorted(stale)[:3]}")
    waves = min(waves, n)
    cuts = [n * i // waves for i in range(waves + 1)]
    parts = [scratch.table(write_shards(_placed(numbered, total, per_shard, key, range(a, b)), to), f"index-{a}") for a, b in zip(cuts, cuts[1:], strict=False)]
    index = reduce(DataFrame.unionByName, parts)
    scratch.drop("sequences", "parts")
    system.create_dir(base, recursive=True)
    facts = {"sequences": total, "seq_len": seq_len, "per_shard": per_shard, "type": id_type(encoding(tokenizer)[1]).str, "key": key}
    with system.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(facts).encode())
    return index


def read_sequences(at: str, start: int, count: int) -> np.ndarray:
    """``count`` sequences, or as many as there are, from slot ``start`` on, read
    sequentially from the shards."""
    system, base = store(at)
    with system.open_input_stream(f"{base}/manifest.json") as f:
        facts = json.loads(f.read())
    seq_len, per_shard, kind = facts["seq_len"], facts["per_shard"], np.dtype(facts["type"])
    stop, stride, out = min(start + count, facts["sequences"]), seq_len * kind.itemsize, [np.empty((0, seq_len), kind)]
    while start < stop:
        shard, row = divmod(start, per_shard)
        take = min(stop - start, per_shard - row)
        with system.open_input_file(f"{base}/{shard_name(shard)}") as f:
            f.seek(row * stride)
            out.append(np.frombuffer(f.read(take * stride), kind).reshape(take, seq_len))
        start += take
    return np.concatenate(out)


def op3_token_order(spark, sf_dir: str) -> DataFrame:
    """All documents' sequences at their slots in shards that this writes; see ``materialise``."""
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op3"))
