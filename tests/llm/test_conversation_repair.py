"""Conversation repair against a plain search over edits, one conversation at a time."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridlark.llm import conversation_repair as C
from gridlark.llm.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FRESH = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def hurt(rows):
    out = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = out.setdefault(c, [])
        if kind == 1:
            x = ""
        if kind == 2:
            x = x.replace(".", "").replace("!", "").replace("?", "")
        if kind == 4:
            r = "user"
        mine += [(t, r, x)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows):
    """One conversation's report; the best (cost, audit, lines) of each state, row by row."""
    rows = sorted(rows, key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2]))
    turns = {t for t, _, _ in rows if t is not None}
    n = dict.fromkeys(("blank", "duplicate", "truncated", ""), 0)
    seen, best = set(), {0: (0, "", ())}

    def widened(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                role, to = FRESH[s]
                best[to] = min(best.get(to, (1 << 60,)), (cost + 3, audit + "I", (*lines, f"{role}:")))
        return best

    for _, r, x in rows:
        bare = x.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((r, x))
        n[fault] += 1
        new = {}

        def put(s, *path):
            new[s] = min(new.get(s, (1 << 60,)), path)

        for s, (cost, audit, lines) in widened(best).items():
            put(s, cost + 4, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                if (s, r[:1]) in STEPS:
                    put(STEPS[s, r[:1]], cost + extra, audit + "K", (*lines, f"{r}:{x}"))
                role, to = FRESH[s]
                put(to, cost + 3 + extra, audit + "R", (*lines, f"{role}:{x}"))
        best = new
    ends = widened(best)
    cost, audit, lines = min(ends[s] for s in (0, 3) if s in ends)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got, copies = C.damaged(df)
    got = {r.conv_id: tuple(r)[1:] for r in C.repaired(got, Scratch(spark, "t12"), copies=copies, **options).collect()}
    want = {c: plain(x) for c, x in hurt(rows).items()}
    assert got == want


def some(seed, n, longest):
    rng, rows = random.Random(seed), []
    texts = ["", " ", "\t\n", "Yes.", "No?", "and so", "Well! ", "1.5", "x" * 30, None, "Éa. "]
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t, t + 5, None, 0])
            rows.append((c, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ua"]), rng.choice(texts)))
    return rows


def test_equal_to_a_plain_search(spark):
    same(spark, some(1, 150, 12))


@pytest.mark.parametrize("segment", [3, 16])
def test_long_conversations_in_segments(spark, segment):
    rows = some(2, 12, 60) + [(500, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(700)] + [(500, None, "user", "again")] * 300
    same(spark, rows, long=20, segment=segment)


def test_odd_rows(spark):
    same(spark, [(None, None, None, None), (None, 1, "user", "Hi."), (7, 3, "assistant", "word " * 200_000), (8, -5, "system", "S."), (8, 9, "user", "U.")] + [(9, 1, "user", "same.")] * 50)
    empty, copies = C.damaged(spark.createDataFrame([], SCHEMA))
    assert C.repaired(empty, Scratch(spark, "t12"), copies=copies).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    same(spark, [(gone, 0, "user", "Hi.")])
    same(spark, [(gone, 0, "user", "Hi.")] * 5, long=2)
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", "k", 3)], SCHEMA + ", key string, copies int")
    assert C.repaired(wide, Scratch(spark, "t12")).first().audit == "KI"


def test_undamaged_rows_are_kept(spark):
    rows = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "user", "U."), (1, 2, "assistant", "A."), (2, 0, "user", "U."), (2, 1, "tool", "A.")], SCHEMA)
    got = {r.conv_id: (r.audit, r.cost) for r in C.repaired(rows, Scratch(spark, "t12")).collect()}
    assert got == {1: ("KKK", 0), 2: ("KR", 3)}


def test_all_conversations_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(*[F.col(c) for c in ("conv_id", "turn", "role", "text")]).collect()]
    got = {r.conv_id: tuple(r)[1:] for r in C.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    assert got == {c: plain(x) for c, x in hurt(rows).items()}
