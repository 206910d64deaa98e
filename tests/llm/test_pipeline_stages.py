"""Each pipeline stage against a brute-force version on the stage's own input."""

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from gridlark.llm import decontaminate, quality_gam, token_order
from gridlark.llm.scratch import Scratch
from test_documents import components_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and what each stage made of them."""
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(Scratch(spark, "steps").table(stage(spark, out[-1], SMALL), f"s{k}"))
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_stage(spark, steps):
    """Table look-ups one by one keep the same documents."""
    docs, kept = steps[:2]
    model = quality_gam.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))

    def score(text):
        x = quality_gam.features_of((text or "").encode())
        total = model.base + sum(t[bisect_right(e, v)] for t, e, v in zip(model.tables.tolist(), map(list, model.edges), x, strict=True))
        for (f, g), grid in zip(model.pairs, model.grids, strict=True):
            total += grid[bisect_right(list(model.coarse[f]), x[f])][bisect_right(list(model.coarse[g]), x[g])]
        return 1 / (1 + math.exp(-total))

    scored = [(tuple(r), score(r["text"])) for r in docs.collect()]
    assert not [s for _, s in scored if abs(s - 0.5) < 1e-9]
    assert rows_of(kept) == Counter(r for r, s in scored if s >= 0.5)


def test_near_duplicate_stage(steps):
    """All pairs of shingle sets keep the same documents."""
    docs, kept = steps[1:3]
    component = components_of([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows_of(kept) == Counter(tuple(r) for r in docs.collect() if component[r["doc_id"]][1] == r["doc_id"])
    assert kept.count() < docs.count()


def words_of(text):
    """(word, kind, whether it may be no name)."""
    words, last = [], "."
    for token in re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]", text or ""):
        if token not in ".!?\n":
            low, kind, unsure = token.lower(), None, False
            if token[0].isdigit():
                kind = "number"
            elif low in decontaminate.UNITS:
                kind = "unit" if last[0].isdigit() or len(low) > 3 else None
            elif low in decontaminate.PRONOUNS:
                low = "<pronoun>"
            elif len(token) > 1 and token[0].isupper() and token[1:].islower() and (last not in ".!?\n" or low not in decontaminate.OPENERS):
                kind, unsure = "name", last in ".!?\n"
            words.append((low, kind, unsure))
        last = token
    return words


def windows_of(words, size, sure=False):
    """Template windows as (words, place, slot values)."""
    if sure:
        words = [(w, None if unsure else k, False) for w, k, unsure in words]
    for at in range(len(words) - size + 1):
        part = words[at : at + size]
        if sum(k is None for _, k, _ in part) >= 3:
            yield tuple(f"<{k}>" if k else w for w, k, _ in part), at, [w for w, k, _ in part if k]


def test_benchmark_stage(spark, steps):
    """Every document with every item, one alignment after another."""
    docs, kept = steps[2:4]
    items = []
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = words_of(r["text"])
        for size in (5, 10):
            rows = [x for sure in (False, True) for x in windows_of(words, size, sure)]
            if 2 * len({k for _, at, _ in rows for k in range(at, at + size)}) >= len(words):
                items.append((size, rows))
                break
        else:
            raise AssertionError("an item that only its raw words could find")

    def holds(found, size, item):
        lines = defaultdict(lambda: (set(), set()))
        for window, at, slots in item:
            for here, mine in found.get(window, ()):
                hit, pairs = lines[here - at]
                hit.add(at)
                pairs |= set(zip(slots, mine, strict=True))
        agreeing = [hit for hit, pairs in lines.values() if len(pairs) == len({a for a, _ in pairs})]
        words = lambda at: {k for a in at for k in range(a, a + size)}
        every, here = {at for _, at, _ in item}, set().union(*agreeing)
        runs = [max((n for n in range(1, 400) if any(set(range(k, k + n)) <= words(hit) for k in hit)), default=0) for hit in agreeing]
        return len(here) >= 0.8 * len(every) or len(words(here)) >= 0.8 * len(words(every)) or max(runs, default=0) >= 13

    want = Counter()
    for r in docs.collect():
        found = {size: defaultdict(list) for size in (5, 10)}
        for size in found:
            for window, at, slots in windows_of(words_of(r["text"]), size):
                found[size][window].append((at, slots))
        want[tuple(r)] += not any(holds(found[size], size, item) for size, item in items)
    assert rows_of(kept) == +want
    assert kept.count() < docs.count()


def test_mix_stage(steps):
    """Water filling step by step and each document's own draw."""
    docs, mixed = steps[3:5]
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    full = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s, w in weight.items() if s not in full and level * w > 3 * size[s]}
        if not more:
            break
        full |= more
    rate = {s: (3 * size[s] if s in full else level * weight[s]) / size[s] if size[s] else 0 for s in size}
    bits = lambda r: int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:8], 16)

    def taken(r, seed):
        x = rate[r["source"]]
        return math.floor(x) + (bits(r) * (seed * 7_985_862 + 1_640_531_527) % 2**32 / 2**32 < x - math.floor(x))

    rows, words = docs.collect(), lambda r: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))
    off = {s: [abs(sum(words(r) * taken(r, k) for r in rows if r["source"] == s) - rate[s] * size[s]) for k in range(64)] for s in size}
    want = Counter()
    for r in rows:
        mine = off[r["source"]]
        want[tuple(r)] += taken(r, mine.index(min(mine)))
    assert rows_of(mixed) == +want


def test_order_stage(steps):
    """The same sequences as from encoding each text by itself, at slots 0 to N - 1."""
    docs, ordered = steps[4:]
    coder, end = token_order.encoding()
    want = Counter()
    for r in docs.collect():
        ids = [*coder.encode(r["text"] or "", disallowed_special=()), end]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[(r["doc_id"], k // 512, len(part), xxhash.xxh64_intdigest(np.array(part + [end] * (512 - len(part)), "<u2").tobytes()) - (1 << 63))] += 1
    rows = ordered.collect()
    assert Counter((r["doc_id"], r["seq_no"], r["n_tokens"], r["digest"]) for r in rows) == want
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all((r["shard"], r["byte_offset"]) == (r["slot"] // 16_384, r["slot"] % 16_384 * 1024) for r in rows)


def test_a_wave_shuffles_a_quarter_of_the_shards(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    T = token_order
    placed, waves = T._placed, []
    monkeypatch.setattr(T, "_placed", lambda *a: waves.append(a[-1]) or placed(*a))
    docs = spark.range(16).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    index = T.materialise(docs, Scratch(spark, "waves"), to=str(tmp_path / "shards"), per_shard=2)
    assert [len(w) for w in waves] == [2, 2, 2, 2] and sorted(r["slot"] for r in index.collect()) == list(range(16))
    assert len(T.read_sequences(str(tmp_path / "shards"), 0, 99)) == 16
