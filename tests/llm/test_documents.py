"""Document operators against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlark.llm import decontaminate, language_id, license_scan, line_dedup, ngram_join, quality_gam, source_mix, token_order
from gridlark.llm.scratch import Scratch

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, low long, key string, component long, h1 long, id long, label string, n long, target string"
LOREM = [f"w{i}x{i * 7 % 13}" for i in range(400)]


def prose(a, b):
    return " ".join(LOREM[a:b])


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (6, prose(0, 60)), (7, prose(0, 60)), (8, prose(0, 60).upper()), (9, prose(0, 57)), (10, prose(100, 160)),
    (11, prose(0, 40) + "\n" + prose(200, 260)), (12, "éèê 中文 \U0001f600 \x00 x"), (13, "MIT License\nmit-license, APACHE LICENSE"), (14, " ".join(LOREM * 30)),
    (15, "1 2 3 4 5 6 7 8 9 10"), (15, "1 2 3 4 5 6 7 8 9 10"), (None, "no id here at all"), (16, "\n\n\n"), (17, "a shared line of more than twenty\nx"), (18, "  A Shared line of more than twenty \ny"),
    (19, "a shared line of more than twenty\na shared line of more than twenty"), (20, "one TWO three"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None if (i or 0) % 5 == 0 else "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", None, 0, "k", 1, 2, 3, "l", 4, "t") for i, t in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def scratch(spark):
    s = Scratch(spark, "test")
    yield s
    s.clear()


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def components_of(rows):
    sets, up = sets_of(rows), {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and (n := len(sets[a] & sets[b])) * 100 >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_awkward(spark, awkward, nothing, scratch):
    got = ngram_join.jaccard_join(awkward, scratch).collect()
    assert len(got) == len(AWKWARD)
    known = [(i, t) for i, t in AWKWARD if i is not None]
    want = components_of(known)
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == want
    assert ngram_join.jaccard_join(nothing, Scratch(spark, "t")).count() == 0


def test_jaccard_near_groups_equal_brute_force(spark, scratch):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = [f"g{g}t{rng.integers(60)}" for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(int(rng.integers(0, 7))):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(5)}"
            rows.append((len(rows), " ".join(w[: int(rng.integers(90, 121))])))
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == components_of(rows)


def test_jaccard_blocks_of_hot_cells(spark, scratch, monkeypatch):
    """Cells above the block size give the same components."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(6)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(60))] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == components_of(rows)


def test_jaccard_links_rows_without_an_id(spark, scratch):
    """A row with a null id has its text's links, whoever else has none."""
    rows = [(5, prose(0, 60)), (None, prose(0, 58)), (9, prose(0, 56) + " x"), (None, prose(100, 160)), (None, prose(100, 160))]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert Counter((r[0], r[2]) for r in got) == Counter([(5, 5), (None, 5), (9, 5), (None, None), (None, None)])


def test_tree_finds_all_points_in_reach():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(np.append(base[rng.random(400) < 0.9], rng.integers(0, 1 << 62, int(rng.integers(0, 60)), dtype=np.uint64))) for _ in range(150)]
    points, sizes = np.array([ngram_join.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    tree = ngram_join.CountVectorRTree(points, sizes, leaf=4)
    found = {(x, y) for k in range(0, 150, 7) for a, b, _ in tree.search(points[k : k + 7], sizes[k : k + 7]) for x, y in zip((a + k).tolist(), b.tolist(), strict=True)}
    linked = {(i, j) for i in range(150) for j in range(150) if (n := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - n)}
    assert linked <= found


def lines_of(rows):
    """Brute force of line dedup."""
    blank, holders = " \t\n\x0b\f\r", defaultdict(set)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blank).translate(lower)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and i is not None:
                holders[key(x)].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def test_line_dedup(spark, awkward, nothing, scratch):
    out = line_dedup.drop_repeated_lines(awkward, scratch)
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert Counter(map(tuple, got)) == lines_of(AWKWARD) and set(awkward.columns) <= set(out.columns)
    assert line_dedup.drop_repeated_lines(nothing, Scratch(spark, "t")).count() == 0


def test_clashing_names(spark, scratch):
    names = "doc_id long, text string, source string, _text long, _score long, _gone long, _lines long, doc long, _id long, _source long, _copies long, n_lines long"
    df = spark.createDataFrame([(i, "one line that three documents hold", "s", *range(1, 10)) for i in range(3)], names)
    lines = line_dedup.drop_repeated_lines(df, scratch)
    assert lines.columns == [*df.columns[:-1], "kept_text", "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["_gone"], r["doc"], r["kept_text"], r["n_dropped"]) for r in lines.collect()) == [(0, 3, 5, "", 1), (1, 3, 5, "", 1), (2, 3, 5, df.first()["text"], 0)]
    mixed = source_mix.mix(df, Scratch(spark, "t"))
    assert mixed.columns == df.columns and sorted(map(tuple, mixed.collect())) == sorted(map(tuple, df.collect()))
    scored = quality_gam.score_documents(df, quality_gam.fit(np.empty((0, len(quality_gam.FEATURES))), np.empty(0)))
    assert [(r["_text"], r["_score"], r["doc"]) for r in scored.collect()] == [(1, 0.5, 5)] * 3


def test_line_runs_levels(spark, scratch):
    runs = line_dedup.LineRuns(spark, buckets=2, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 50 - k), (2, 2 + k, 50 - k)], "h1 long, h2 long, doc_id long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    merged = {(r.h1, r.h2): (r.n, r.last) for r in runs.merged().collect()}
    assert merged[(1, 1)] == (5, 50) and merged[(2, 6)] == (1, 46)
    runs.close()


def test_mix(spark, awkward, nothing, scratch):
    rows = [(i, f"s{i % 3}" if i % 10 else None, int(i % 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = {r["source"]: (r["source_size"], r["target"]) for r in source_mix.targets(df).collect()}
    total = sum(n for n, _ in targets.values())
    assert sum(t for _, t in targets.values()) == pytest.approx(total) and all(t <= 3 * n + 1e-6 for n, t in targets.values())
    # water filling, step by step
    weights = dict(zip(sorted((k for k in targets if k is not None)), (1, 2, 3), strict=False)) | {None: 1}
    full = {}
    while True:
        open_ = {k: w for k, w in weights.items() if k not in full}
        level = (total - sum(full.values())) / sum(open_.values())
        over = {k: 3 * targets[k][0] for k, w in open_.items() if level * w > 3 * targets[k][0]}
        if not over:
            break
        full |= over
    assert {k: pytest.approx(full.get(k, level * weights[k])) for k in targets} == {k: t for k, (_, t) in targets.items()}
    copies = source_mix.copies_of(df, scratch).collect()
    for k, (_, t) in targets.items():
        assert sum(r["size"] * r["copies"] for r in copies if r["source"] == k) == pytest.approx(t, rel=0.01)
    assert max(r["copies"] for r in copies) <= 3 and len(copies) == 3000
    out = source_mix.mix(awkward, Scratch(spark, "t1"))
    assert out.columns == awkward.columns and sorted(map(repr, out.collect())) == sorted(map(repr, source_mix.mix(awkward, Scratch(spark, "t")).collect()))
    assert source_mix.mix(nothing, Scratch(spark, "t2")).count() == 0


def licences_of(rows):
    """Brute force: every text against every phrase and clause, word by word."""
    pattern, lower = re.compile(license_scan.WORD), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [pattern.findall((t or "").translate(lower)) for _, t in rows]
    holders = Counter(x for w in words for x in set(w))

    def places(w, phrase):
        p = phrase.split()
        return [k for k in range(len(w)) if w[k : k + len(p)] == p]

    def holds(w, clause):
        c = clause.split()
        rare = sorted({x: k for k, x in reversed(list(enumerate(c)))}.items(), key=lambda x: (holders[x[0]], x[1]))[: license_scan.RARE]
        return any(sum(0 <= s + k < len(w) and w[s + k] == x for x, k in rare) >= license_scan.AGREE * len(rare) for s in range(-len(c), len(w)))

    out = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        at = sorted((k, x) for x, p in license_scan.BASE.items() for k in places(w, p))
        bases = {x for _, x in at}
        more = {x for x, several in license_scan.TEMPLATES.items() if any(holds(w, c) and all(places(w, k) for k in keys) for c, keys in several)}
        idf = sum(math.log((1 + len(rows)) / (1 + holders[x])) for p in license_scan.phrases() if places(w, p) for x in set(p.split()))
        out[(i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(bases)), ",".join(sorted(bases | more)), round(1 - math.exp(-idf / 10), 6))] += 1
    return out


def test_license_scan(spark, awkward, nothing, scratch):
    extra = ["x GNU General Public License general public license", "-MIT license-", "license mit license license", "Émit license", "mozilla public license apache  license", "general public", "MIT license " * 3000]
    for several in license_scan.TEMPLATES.values():
        for clause, _ in several:
            c = clause.split()
            extra += [clause.title().replace(" ", ", "), " ".join(["so:", *c[: len(c) // 2], "other", *c[len(c) // 2 :]]), " ".join(c[1:]), " ".join(c[:-1]), " ".join(sorted(c))]
    rows = AWKWARD + [(30 + i, t) for i, t in enumerate(extra)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = Counter(map(tuple, license_scan.scan(docs, scratch).collect()))
    want = licences_of(rows)
    assert (sorted(map(repr, got - want)), sorted(map(repr, want - got))) == ([], [])
    assert len({r[6] for r in got}) > 14
    assert {r[6:] for r in got if r[0] == 2} == {("", 0.0)}
    assert license_scan.scan(nothing, Scratch(spark, "t2")).count() == 0


def test_license_index_has_no_common_words():
    """Only the rarest words of a clause or phrase look anything up."""
    df = Counter({w: 10_000 for w in "and the of to in is a for or this it as by under with use".split()})
    index = license_scan.postings(df)
    assert not {w for w, *_ in index} & set(df) and {i for _, i, _, _ in index} == set(range(len(license_scan.phrases() + license_scan.clauses())))


def leaks(docs, bench, scratch):
    """{(doc_id, item_id): coverage}, every item of a class that is found."""
    found = decontaminate.find_leaks(docs, bench, scratch).withColumnRenamed("item_id", "class_item").drop("n_items")
    members = decontaminate.template_classes(bench, Scratch(bench.sparkSession, "members")).drop("n_items")
    rows = found.join(members, "class_item").collect()
    assert len({(r["doc_id"], r["item_id"]) for r in rows}) == len(rows)
    return {(r["doc_id"], r["item_id"]): r["coverage"] for r in rows}


def test_decontaminate(spark, scratch):
    item = "Anna Kern buys 12 apples for 3 dollars and then walks 7 km to the market, where Anna Kern sells 4 apples."
    swapped = "We saw: Tom Wood buys 90 apples for 5 dollars and then walks 2 km to the market, where Tom Wood sells 8 apples. The end."
    mixed = "Tom Wood buys 90 apples for 5 dollars and then walks 2 km to the market, where Lisa Brown sells 8 apples."
    docs = [(1, f"Before. {item} After."), (2, swapped), (3, mixed), (4, "Nothing of the kind here, at all, not once in this text."), (5, None), (6, ""), (7, item.upper()), (None, item), (8, " ".join([item] * 3)), (9, "anna kern buys 12 apples")]
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, ""), (None, "x y z a b c d e")], "item_id long, text string")
    d = spark.createDataFrame([(i, t, 1, "h") for i, t in docs], "doc_id long, text string, id int, h string")
    got = set(leaks(d, bench, scratch))
    assert {(1, 1), (2, 1), (8, 1)} <= got and not {x for x, _ in got} & {4, 5, 6, 9, None}
    assert (3, 1) not in got  # one name of the item stands for two of the document's
    kept = decontaminate.drop_leaks(d, bench, Scratch(spark, "t"))
    assert kept.columns == d.columns and {4, 5, 6, 9, None} <= {r[0] for r in kept.collect()} and kept.where("doc_id in (1, 2, 8)").isEmpty()
    for a, b in ((d.limit(0), bench), (d, bench.limit(0))):
        assert decontaminate.find_leaks(a, b, Scratch(spark, "t3")).count() == 0


def test_edited_copies_and_excerpts(spark, scratch):
    """One edit costs one word, and thirteen words in a row are enough."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(64)]
    short, long = words[:16], words[20:]
    docs = [short[:7] + ["other"] + short[8:], long[:33], long[15:28], long[15:27], long[:12] + ["z"] * 5 + long[17:29], short[:6] + long[:6], long[:9] + ["other"] + long[9:]]
    bench = spark.createDataFrame([(0, " ".join(short)), (1, " ".join(long))], "item_id long, text string")
    d = spark.createDataFrame([(i, "before it " + " ".join(x) + " after it") for i, x in enumerate(docs)], "doc_id long, text string")
    got = leaks(d, bench, scratch)
    assert set(got) == {(0, 0), (1, 1), (2, 1), (6, 1)} and got[0, 0] == 15 / 16 and got[1, 1] == 33 / 44 and got[6, 1] == 1


def test_items_without_windows(spark, scratch):
    """Short and number-dense items are found by their words."""
    items = ["Who painted Guernica?", "What is 12 + 7 * 3 - 45 / 9 + 128 ?", "Solve 3 x 4 = 12, 5 x 6 = 30, 7 x 8 = 56", "...", "one two three four five six"]
    docs = [f"Some words before. {x} And some after." for x in items] + [items[0].upper(), "what is 12 + 7 * 3 - 45 / 9 + 129", "who painted the guernica"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(*k, v) for k, v in leaks(d, bench, scratch).items()}
    assert got == {(i, i, 1.0) for i in (0, 1, 2, 4)} | {(5, 0, 1.0), (6, 1, 7 / 8)}


TWINS = [
    "{N} has {a} apples and gives {b} of them to {M}. How many apples does {N} have left?",
    "Yesterday {N} drove {a} {u} to the lake with {M}, and the way back took {b} hours longer. How long was {N} on the road?",
    "{N} buys {a} packs of {b} cards. He sells {c} cards to {M}. How many cards does he keep for himself?",
    "A train leaves the station at {a} and travels {b} {u} before it stops for {c} minutes. When does the train arrive?",
    "If {M} paints a fence of {a} {u} in {b} hours, how many hours does {N} need for a fence of {c} {u} at the same pace?",
    "There are {a} red balls and {b} blue balls in a bag. {N} draws one ball at random. What is the probability that it is red?",
    "Compute the area of a rectangle whose sides are {a} {u} and {b} {u} long and write it down.",
    "{N} is {a} years older than {M}. In {b} years she will be twice as old as {M} is now. How old is {M} today?",
]


def test_reparameterised_items(spark, scratch):
    """Numbers, names and units exchanged: at least nine of ten items are found, and no clean document."""
    rng = np.random.default_rng(11)
    names, units = ["Anna", "Liam", "Maria", "John", "Olga", "Peter", "Nina", "Hugo"], ["km", "miles", "meters", "yards"]

    def made(k):
        n, m = rng.choice(names, 2, replace=False)
        a, b, c = rng.choice(np.arange(2, 900), 3, replace=False)
        text = TWINS[k % len(TWINS)].format(N=n, M=m, a=a, b=b, c=c, u=rng.choice(units)) + f" This is about the {LOREM[k]} of {LOREM[k + 1]} and {LOREM[k + 2]} only."
        return text if rng.random() < 0.5 else re.sub(r"\b(He|he|himself)\b", lambda x: {"He": "She", "he": "she", "himself": "herself"}[x[0]], text)

    items = [made(k) for k in range(200)]
    docs = [f"We found this somewhere. {made(k)} Nothing else was there." for k in range(200)]
    docs += [f"In {y} the town of {n} sold {k} tons of grain, and {m} wrote that there are many ways to count how many hours that took, in all." for k, (n, m, y) in enumerate(zip(names * 25, reversed(names * 25), range(1800, 2000), strict=True))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = set(leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench, scratch))
    recall, clean = sum((k, k) in got for k in range(200)) / 200, {d for d, _ in got if d >= 200}
    assert recall >= 0.9 and not clean, (recall, len(clean))


def test_items_of_one_template_are_one_class(spark, scratch):
    """One row a document and class however many items have the template; likeness of values is part of it."""
    n = 3000
    names = [f"{chr(65 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}en" for k in range(n)]
    items = [f"What is {k + 2} plus {k + 3}?" for k in range(n)] + [f"What is {k} plus {k}?" for k in range(2, 12)]
    items += [f"{x} has {k + 5} apples and gives {k + 3} of them to a friend. How many are left now?" for k, x in enumerate(names)]
    docs = [f"Before it. What is {k + 900} plus {k + 77}? After it." for k in range(n)] + ["Say what is 8 plus 8?", "Nothing is here at all."]
    docs += [f"Once more. {names[k]} has {k + 9} apples and gives {k} of them to a friend. How many are left now?" for k in range(200)]
    docs += [f"and then {names[5].lower()} has 6 apples and gives 3 of them to a friend. How many are left now?"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_items"] for r in decontaminate.find_leaks(d, bench, scratch).collect()}
    # equal values may stand for different ones of the item, not the other way round
    want = {(k, 0): n for k in range(n)} | {(n, 0): n, (n, n): 10} | {(n + 2 + k, n + 10): n for k in range(201)}
    assert got == want
    members = decontaminate.template_classes(bench, Scratch(spark, "t")).collect()
    assert sorted(r["item_id"] for r in members) == list(range(len(items)))
    assert Counter((r["class_item"], r["n_items"]) for r in members) == {(0, n): n, (n, 10): 10, (n + 10, n): n}


def test_scripts_without_spaces(spark, scratch):
    """An item is found inside a sentence, and a common phrase of it is no leak."""
    items = ["\u65e5\u672c\u306e\u9996\u90fd\u306f\u3069\u3053\u3067\u3059\u304b\u3001\u305d\u306e\u4eba\u53e3\u306f\u4f55\u4eba\u3067\u3059\u304b", "\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e\u0e40\u0e1b\u0e47\u0e19\u0e40\u0e21\u0e37\u0e2d\u0e07\u0e2b\u0e25\u0e27\u0e07"]
    around = "\u4eca\u65e5\u306f{}\u3068\u805e\u304b\u308c\u307e\u3057\u305f"
    docs = [around.format(items[0]), f"\u0e02\u0e2d{items[1]}\u0e19\u0e30", around.format(items[0][:10]), "plain words of no such script", around.format(items[0] * 2)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = set(leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench, scratch))
    assert got == {(0, 0), (1, 1), (4, 0)}


def test_a_very_long_text_and_item(spark, scratch):
    rng = np.random.default_rng(4)
    words = [f"{chr(97 + a)}{chr(97 + b)}w" for a in range(26) for b in range(26)]
    long = " ".join(rng.choice(words, 300_000))
    bench = spark.createDataFrame([(1, long[4000:4400]), (2, long[8000:90_000])], "item_id long, text string")
    d = spark.createDataFrame([(1, long), (2, long[4000:4400]), (3, " ".join(rng.choice(words, 20_000)))], "doc_id long, text string")
    got = set(leaks(d, bench, scratch))
    assert {(1, 1), (1, 2), (2, 1)} <= got and not {x for x in got if x[0] == 3}


def test_gates_lose_nothing():
    """Places beyond the gate are never enough, those of the gate and one less may be."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        rows = [{"h": int(k), "at": int(k), "kind": 5, "own": False, "forms": int(rng.integers(1, 9))} for k in np.sort(rng.choice(60, n, replace=False))]
        batch = pa.RecordBatch.from_pylist([{"form": 1, "run": 13, "rows": rows}])
        gate = set(pa.Table.from_batches(decontaminate._gates(0.8)([batch])).column("h").to_pylist())
        places = [r["at"] for r in rows]
        covered = lambda x: len({w for p in x for w in range(p, p + 5)})
        rest = [p for p in places if p not in gate]
        runs, longest = [], 0
        for p in rest:
            runs = [runs[0], p + 5] if runs and p <= runs[1] else [p, p + 5]
            longest = max(longest, runs[1] - runs[0])
        assert gate and (not rest or (len(rest) < 0.8 * n and covered(rest) < 0.8 * covered(places) and longest < 13))


def test_token_order(spark, awkward, nothing, scratch, tmp_path):
    for n in (1, 2, 3, 7, 64, 1000):
        slots = token_order.feistel(np.arange(n), n, 9)
        assert sorted(slots.tolist()) == list(range(n))
    assert token_order.feistel(np.arange(1000), 1000, 9).tolist() != token_order.feistel(np.arange(1000), 1000, 10).tolist()
    out = token_order.training_order(awkward, scratch, seq_len=16, per_shard=50).cache()
    rows = out.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    assert all(r["shard"] == r["slot"] // 50 and r["byte_offset"] == r["slot"] % 50 * 32 and len(r["tokens"]) == 32 for r in rows)
    coder, end = token_order.encoding()
    docs = defaultdict(dict)
    for r in rows:
        docs[r["doc_id"]].setdefault(r["seq_no"], []).append(np.frombuffer(r["tokens"], np.uint16)[: r["n_tokens"]])
    for i, t in AWKWARD:
        ids = np.concatenate([docs[i][k][0] for k in sorted(docs[i])]).tolist()
        assert ids[-1] == end and coder.decode(ids[:-1]) == (t or "")
    to = f"file://{tmp_path}/shards"
    index = token_order.materialise(awkward, Scratch(spark, "t1"), to, seq_len=16, per_shard=50)
    assert sorted(tuple(r)[:6] for r in index.collect()) == [tuple(r)[:6] for r in rows]
    want = np.array([np.frombuffer(r["tokens"], np.uint16) for r in rows])
    for start, count in ((0, len(rows)), (47, 9), (120, 3), (len(rows) - 1, 9), (len(rows), 1)):
        assert (token_order.read_sequences(to, start, count) == want[start : start + count]).all()
    assert token_order.training_order(nothing, Scratch(spark, "t")).count() == 0
    assert token_order.materialise(nothing, Scratch(spark, "t2"), f"{to}-none").count() == 0 and not len(token_order.read_sequences(f"{to}-none", 0, 5))


def test_token_order_is_that_of_the_rows(spark, awkward, tmp_path):
    """Partitions of the input change no slot, and tasks with several shards write each."""
    got = []
    for parts, most in ((1, 64), (7, 2)):
        token_order.MOST_SHARDS_PER_TASK, old = most, token_order.MOST_SHARDS_PER_TASK
        to = f"file://{tmp_path}/{parts}"
        try:
            got.append(sorted(map(tuple, token_order.materialise(awkward.repartition(parts), Scratch(spark, "t"), to, seq_len=8, per_shard=3).collect())))
        finally:
            token_order.MOST_SHARDS_PER_TASK = old
        got[-1].append(token_order.read_sequences(to, 0, 10_000).tolist())
    assert got[0] == got[1] and len({x[1] for x in got[0][:-1]}) > 50


def test_tokens_of_very_long_texts(spark, monkeypatch):
    coder, end = token_order.encoding()
    for text in (" " * 10_000_000, "x" * 1_000_000, "a" + "\n" * 1_000_001 + "b", "1" * 1_000_000):
        assert coder.decode(token_order.encoded(coder, text).tolist()) == text
    monkeypatch.setattr(token_order, "LONG_BLANK", 8)
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "9", "!", "\xa0", "'s"]) if rng.random() < 0.5 else rng.choice([" ", "\n", "\t", "\u2003"]) * int(rng.integers(1, 20)) for _ in range(12))
        assert "".join(token_order.pieces(text)) == text
        if not any(len(x) >= 8 for x in re.findall(r"\s+", text)):
            assert token_order.encoded(coder, text).tolist() == coder.encode(text, disallowed_special=())
    monkeypatch.setattr(token_order, "LONG_BLANK", 8)
    for text in ("ab" + " " * 9 + "cd  e", "ab" + " " * 30, " " * 20 + "\nx"):  # runs of spaces have no tokens that cross a cut
        assert token_order.encoded(coder, text).tolist() == coder.encode(text, disallowed_special=())
    assert token_order.id_type(65_535).itemsize == 2 and token_order.id_type(65_536).itemsize == 4


def test_quality_on_awkward_rows(spark, awkward, nothing):
    x, y = np.random.default_rng(0).random((400, len(quality_gam.FEATURES))), np.arange(400) % 2
    x[:, 3] += y
    model = quality_gam.fit(x, y.astype(float))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
    out = quality_gam.score_documents(awkward, model)
    got = out.collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["_score"] <= 1 for r in got) and set(out.columns) == set(awkward.columns) - {"text"} | {"_score"}
    assert quality_gam.score_documents(nothing, model).count() == 0
    empty = quality_gam.train(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_gam.score_documents(awkward, empty).where("_score <> 0.5").isEmpty()


def test_quality_fit_counts_an_id_once(spark, monkeypatch):
    """However often documents and labels repeat an id, the fit sees no more rows than it may."""
    seen = []
    monkeypatch.setattr(quality_gam, "fit", lambda x, y: seen.append((x.tolist(), y.tolist())))
    docs = [(i, f"Some text of number {i}, with {'more ' * i}words.") for i in range(30)]
    labels = [(i, i % 2) for i in range(30)]
    schema = "doc_id long, text string", "doc_id long, quality int"
    for d, s in ((docs, labels), (docs + docs[:9] * 50, labels + labels[:5] * 4)):
        quality_gam.train(spark.createDataFrame(d, schema[0]), spark.createDataFrame(s, schema[1]))
    assert seen[0] == seen[1] and 10 < len(seen[0][1]) < 30
    quality_gam.train(spark.createDataFrame(docs + docs[:9] * 50, schema[0]), spark.createDataFrame(labels, schema[1]), sample=7)
    assert len(seen[2][1]) == 7


def test_quality_interaction_is_learned():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality_gam.FEATURES)))
    y = ((x[:, 1] > 0.5) ^ (x[:, 4] > 0.5)).astype(float)
    model = quality_gam.fit(x[:2000], y[:2000])
    assert (4, 1) in model.pairs and ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    q = quality_gam.op1_quality_gam(spark, f"{SMALL}/../sf0.01").join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    named = language_id.op10_language_id(spark, f"{SMALL}/../sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert q > 0.95 and named > 0.95


def test_mix_comes_near_its_targets(spark):
    """Sources of some fifty documents of very different length."""
    out = source_mix.op7_source_mix(spark, f"{SMALL}/../sf0.01").join(spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    got = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("most")).collect()
    assert max(r["most"] for r in got) <= 3 and sorted(abs(r["taken"] / r["target"] - 1) for r in got)[-1] < 0.02


def test_line_dedup_of_long_texts_and_large_ids(spark, scratch):
    """Time in proportion to the lines dropped, and the largest id there is."""
    text = "\n".join(f"a line that several documents share, {i}" for i in range(20_000))
    rows = [(2**63 - 1, "short"), (-(2**63), text), (1, text), (2**62, text), (2, None), (1, "a line that several documents share, 7")]
    start = time.perf_counter()
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), scratch)
    got = Counter(map(tuple, out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()))
    assert got == lines_of(rows) and time.perf_counter() - start < 60


def test_languages_by_brute_force(spark):
    """Every text with every dictionary anew, one piece after another."""
    import zstandard

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    samples = language_id.learn(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    assert all(len(x) <= language_id.BYTES_PER_LANGUAGE for x in samples.values())
    want = {}
    for r in docs.collect():
        low = "".join(c if c == "'" or unicodedata.category(c)[0] in "LM" else " " for c in (r["text"] or "").lower())
        raw, best = " ".join(low.split()), {}
        raw = (" " * low.startswith(" ") + raw + " " * (low.endswith(" ") and bool(raw))).encode()
        for lang, known in samples.items():
            d = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            best[lang] = sum(len(zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[i : i + 400])) for i in range(0, len(raw), 400))
        want[r["doc_id"]] = min(sorted(best), key=best.get) if raw.strip() else "und"
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.op10_language_id(spark, SMALL).collect()} == want


def test_language_learning_is_bounded(spark):
    """Marks stay, long texts are learned from all over, every language is."""
    assert language_id.plain("हिन्दी, été 3_x!") == "हिन्दी été x "
    rows = [(i, f"a{i} " * 5 + "start " * 20_000 + "late " * 20_000, "xx") for i in range(3)] + [(10 + i, "kurz", "yy") for i in range(2)] + [(20, "seldom", "zz"), (21, None, "zz"), (22, "1 2", "qq"), (23, "1", "qq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.learn(docs)
    assert set(got) == {"xx", "yy", "zz"} and got["xx"].count(b"late") > 1000 < got["xx"].count(b"start") and got["yy"] == b"kurz kurz"
    with pytest.raises(ValueError, match="More than 3 languages"):
        language_id.learn(docs, languages=3)


def test_a_language_is_learned_however_rare(spark):
    """131 languages of own words each; the rarest has one document."""
    rng = random.Random(1)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for k in range(131)}
    text = lambda k: " ".join(rng.choice(words[k]) for _ in range(120))
    rows = [(200 * k + i, text(k), f"l{k:03d}") for k in range(130) for i in range(2)] + [(90_000, text(130), "rare")]
    samples = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(samples) == 131 and all(len(x) <= language_id.BYTES_PER_LANGUAGE * 128 // 131 for x in samples.values())
    fresh = spark.createDataFrame([(1, text(130)), (2, text(7)), (3, text(129))], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(fresh, samples).collect()} == {1: "rare", 2: "l007", 3: "l129"}


def test_language_on_awkward_rows(spark, awkward, nothing):
    samples = {"en": language_id.plain("the cat and the dog are in the house of the king " * 30).encode(), "de": language_id.plain("der hund und die katze sind in dem haus des alten mannes " * 30).encode()}
    rows = {(r["doc_id"]): r for r in language_id.identify(awkward, samples).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 15, 16)) and rows[4]["lang_pred"] in samples
    two = spark.createDataFrame([(1, "the king and the dog"), (2, "der mann und die katze")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.identify(two, samples).orderBy("doc_id").collect()] == ["en", "de"]
    assert {r["lang_pred"] for r in language_id.identify(two, samples, min_margin=9.0).collect()} == {"und"}
    assert language_id.identify(nothing, samples).count() == 0 and language_id.learn(nothing) == {}
    assert {r["lang_pred"] for r in language_id.identify(two, {}).collect()} == {"und"}


def test_shards_go_where_they_can_be_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some text of document {i} " * 40) for i in range(40)], "doc_id long, text string")
    with pytest.raises(ValueError, match="cannot be written"):
        token_order.materialise(docs, Scratch(spark, "t"), to="nowhere://bucket/shards")
    assert token_order.store("s3a://bucket/shards?region=us-east-1")[1] == "bucket/shards"  # a region, so that none is looked up
    to = f"file://{tmp_path}/shards"
    token_order.materialise(docs, Scratch(spark, "t"), to=to, seq_len=16, per_shard=20)
    token_order.materialise(docs, Scratch(spark, "t"), to=to, seq_len=16, per_shard=20)
    assert len(list((tmp_path / "shards").glob("shard-*"))) > 2
    with pytest.raises(ValueError, match="another run"):
        token_order.materialise(docs.limit(3), Scratch(spark, "t"), to=to, seq_len=16, per_shard=20)
