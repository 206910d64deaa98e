"""Fingerprints against plain set similarity and a plain second version."""

import hashlib
import random

import pytest

from gridlark.llm import fingerprints as P
from gridlark.llm.scratch import Scratch

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def check(rows, docs, loose=0.17):
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    got = sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    want, off = [], 0.0
    for (i, text), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        text, other = text or "", other or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + other[:k]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), P.signature(text).hex(), P.signature(edited).hex(), text, edited, other))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        for k, other in ((5, w[6]), (6, w[7])):
            assert abs(g[k] - jaccard(w[5], other)) <= loose
            off += g[k] - jaccard(w[5], other)
    return off / max(1, len(got))


def written(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "Gamma", "dé", "e", "zeta-1", "eta", "θ", "iota", "κ")) + str(rng.randrange(50)) for _ in range(n))


def run(spark, docs):
    return P.fingerprints(spark.createDataFrame(docs, SCHEMA), Scratch(spark, "t13")).selectExpr(
        "doc_id", "n_chars", "lower(hex(edited_sha256))", "lower(hex(fingerprint))", "lower(hex(edited_fingerprint))", "near_edited", "near_next"
    ).collect()


def test_equal_to_a_plain_version(spark):
    rng = random.Random(4)
    docs = [(i, written(rng, rng.choice((1, 3, 6, 40, 200, 900)))) for i in range(120)]
    docs += [(200 + k, docs[k][1] + " tail") for k in range(40)]
    assert abs(check(run(spark, docs), docs)) < 0.02


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "x"), (5, "ab cd"), (5, "ab cd"), (5, "other text"), (None, "none"), (6, "word " * 100_000), (7, "é" * 1_000_000)]
    check(run(spark, docs), docs)
    check(run(spark, docs[5:6]), docs[5:6])
    assert run(spark, []) == []
    wide = spark.createDataFrame([(1, "a b", 2, b"z", 3)], SCHEMA + ", part int, raw binary, node int")
    assert P.fingerprints(wide, Scratch(spark, "t13")).count() == 1
    assert P.near_duplicates(wide, Scratch(spark, "t13")).first() == (1, 1)


def test_query_on_whole_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    rows = P.op13_document_fingerprints(spark, d).collect()
    check(rows, docs)
    text, by_text = dict(docs), {}
    for r in rows:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


def test_near_duplicates_by_bands(spark):
    rng = random.Random(8)
    docs = [(i, written(rng, 60)) for i in range(150)]
    for k in range(60):  # one word of 60 changes five shingles of 56
        words = docs[k][1].split()
        words[rng.randrange(60)] = "changed"
        docs.append((1000 + k, " ".join(words)))
    base = written(rng, 80).split()
    for k in range(400):  # a group of near copies, each other pair of them may be too far apart
        words = list(base)
        words[rng.randrange(80)] = f"own{k}"
        docs.append((2000 + k, " ".join(words)))
    docs += [(3000 + k, docs[0][1]) for k in range(50)] + [(4000, None), (4001, ""), (None, docs[1][1]), (4002, "two words"), (4003, "two  WORDS")]
    got = {}
    for r in P.near_duplicates(spark.createDataFrame(docs, SCHEMA), Scratch(spark, "t13")).collect():
        got.setdefault(r.doc_id, r.component_id)
    up = {i: i for i, _ in docs if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t or "")) for i, t in docs if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    want = {i: root(i) for i in up}
    assert got.pop(None) == want[1]
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 4, 5, 5000])
def test_signature_is_of_the_set(n):
    words = " ".join(f"w{i}" for i in range(n))
    assert len(P.signature(words)) == 2 * P.PERMUTATIONS
    if n >= 5:
        assert P.signature(f"{words} {words}") != P.signature(words[: len(words) // 2])
