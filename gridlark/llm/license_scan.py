"""License scan by a positional index of rare licence words, in SQL functions only.

The templates are clauses of licences, each with key phrases that must occur.
An index holds, for the rarest words of each clause and phrase, at which place
of it they stand; how rare a word is follows from all documents.  Of a
file's words those in the index look up their postings.  A posting and the word's
place in the file propose where a clause or phrase starts; the proposals of a
clause's words are intersected, and a phrase is verified word by word where its
rarest word proposes it.  Every place of a phrase holds its rarest word, so none is
lost; words that are not the rarest of anything, as stop words, look up nothing.

Texts are split twice, once for the frequencies and once for the places.  What leaves
the second pass are the proposals that hold, keyed by row, clause and start, so a
text with very many of them is spread over tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER
from .scratch import Scratch

#: Each base label and the one phrase that stands for it.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Clauses of public licences and statements of them, with the
#: phrases that must occur, too.  A label needs one of its clauses.
TEMPLATES: dict[str, list[tuple[str, list[str]]]] = {
    "agpl": [
        ("you should have received a copy of the gnu affero general public license along with this program", ["gnu affero general public license"]),
        ("licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ],
    "apache-2.0": [
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "in compliance with the license"]),
        ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ],
    "bsd": [
        (
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            ["redistribution and use in source and binary forms"],
        ),
        ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["must retain the above copyright notice"]),
    ],
    "cc-by": [
        ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
        ("licensed under cc by 4 0", ["licensed under cc by 4 0"]),
    ],
    "cc-by-nc": [
        ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
        ("licensed under cc by nc 4 0", ["licensed under cc by nc"]),
    ],
    "cc-by-sa": [
        ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
        ("licensed under cc by sa 4 0", ["licensed under cc by sa"]),
    ],
    "cc0": [
        ("cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
        ("waived all copyright and related or neighboring rights to this work", ["related or neighboring rights"]),
    ],
    "epl": [("this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"])],
    "gpl-3": [
        (
            "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
            ["general public license as published by", "version 3 of the license"],
        ),
        ("licensed under the gnu general public license version 3", ["general public license version 3"]),
    ],
    "isc": [
        (
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice",
            ["permission to use copy modify and or distribute this software"],
        )
    ],
    "lgpl": [
        ("you should have received a copy of the gnu lesser general public license along with this library", ["gnu lesser general public license"]),
        ("licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ],
    "mit-text": [
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
            ["permission is hereby granted free of charge", "to deal in the software without restriction"],
        ),
        ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["all copies or substantial portions of the software"]),
    ],
    "mpl": [("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"])],
    "unlicense": [("this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"])],
}

RARE, AGREE = 4, 0.75
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def phrases() -> list[str]:
    """Base and key phrases, each once."""
    return sorted({*BASE.values(), *(p for ts in TEMPLATES.values() for _, keys in ts for p in keys)})


def clauses() -> list[str]:
    return sorted({clause for ts in TEMPLATES.values() for clause, _ in ts})


def vocabulary() -> list[str]:
    """All words of the templates and phrases."""
    return sorted({w for p in phrases() + clauses() for w in p.split()})


def rarest(text: str, df: dict[str, int], most: int) -> list[int]:
    """The places of up to ``most`` different words that the fewest documents hold."""
    words = text.split()
    return sorted({w: k for k, w in reversed(list(enumerate(words)))}.values(), key=lambda k: (df.get(words[k], 0), k))[:most]


def postings(df: dict[str, int]) -> list[tuple[str, int, int, list[str]]]:
    """The index: (word, text, place in it, words to verify) with texts numbered
    through ``phrases()`` and then ``clauses()``; clauses verify none."""
    out = [(p.split()[k], i, k, p.split()) for i, p in enumerate(phrases()) for k in rarest(p, df, 1)]
    return out + [(c.split()[k], len(phrases()) + i, k, []) for i, c in enumerate(clauses()) for k in rarest(c, df, RARE)]


def _split(docs: DataFrame) -> DataFrame:
    """Two hashes that tell rows apart, and their words, with an empty string
    before and after where the text does not begin or end with one."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    # a generator keeps the words from being split again for every use
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(3), "text", "doc_id").alias("h2"), F.inline(F.array(F.struct(F.split(lowered, BETWEEN).alias("_w")))))


def _array(words: list[str]) -> str:
    return f"cast(array({', '.join(map(repr, words))}) as array<string>)"  # words of letters and digits


def _literal(words: list[str]) -> Column:
    return F.expr(_array(words))


def _index(spark: SparkSession, df: dict[str, int]) -> DataFrame:
    rows = ", ".join(f"('{w}', {i}, {k}, {_array(ws)})" for w, i, k, ws in postings(df))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(w, i, place, must)")


def _starts(docs: DataFrame, df: dict[str, int]) -> DataFrame:
    """``(h1, h2, i, start, place)`` of the proposals; those of phrases are verified."""
    index = _index(docs.sparkSession, df)
    looked_up = _literal(sorted({w for w, _, _, _ in postings(df)}))
    first = (F.element_at("_w", 1) == "").cast("int")
    hits = _split(docs).where(F.arrays_overlap("_w", looked_up)).select("h1", "h2", "_w", F.posexplode("_w").alias("at", "w"))
    hits = hits.join(F.broadcast(index), "w").withColumn("from", F.col("at") - F.col("place"))
    holds = (F.size("must") == 0) | ((F.col("from") >= 0) & (F.slice("_w", F.greatest(F.col("from"), F.lit(0)) + 1, F.greatest(F.size("must"), F.lit(1))) == F.col("must")))
    return hits.where(holds).select("h1", "h2", "i", (F.col("from") - first).alias("start"), "place")


def scan(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    Null and empty texts and texts without words have no places, empty labels
    and score 0.  Rows are judged one by one, so repeated rows answer alike; an
    empty table gives no rows; other columns are ignored.  A clause is found where
    ``AGREE`` of its ``RARE`` rarest words agree on its start and its key phrases
    occur.  The score is 1 - exp(-x / 10), x being the IDF of the words of all
    phrases found, to six places.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    n = F.greatest(F.lit(0), F.size("_w") - (F.element_at("_w", 1) == "").cast("int") - (F.element_at("_w", -1) == "").cast("int"))
    seen = scratch.table(_split(docs).select("doc_id", "h1", "h2", n.cast("long").alias("n_words"), F.array_intersect("_w", _literal(vocabulary())).alias("present")), "seen")
    total = seen.count()
    df = dict(map(tuple, seen.select(F.explode("present").alias("w")).groupBy("w").count().collect()))  # a row for each template word at most
    starts = scratch.table(_starts(docs, df).distinct(), "starts")

    every, all_clauses = phrases(), clauses()
    phrase_at, clause_at = {p: i for i, p in enumerate(every)}, {c: len(every) + i for i, c in enumerate(all_clauses)}
    need = [math.ceil(AGREE * len(rarest(c, df, RARE))) for c in all_clauses]
    agreed = starts.groupBy("h1", "h2", "i", "start").agg(F.count("*").alias("n"))
    agreed = agreed.where((F.col("i") < len(every)) | (F.col("n") >= F.element_at(F.array(*map(F.lit, need)), F.greatest(F.col("i") - len(every) + 1, F.lit(1)))))
    base = F.when(F.col("i").isin([phrase_at[p] for p in BASE.values()]), F.col("start"))
    found = agreed.groupBy("h1", "h2").agg(F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), F.collect_set("i").alias("texts"))

    def has(*texts: int) -> Column:
        return reduce(Column.__and__, [F.array_contains("texts", i) for i in texts])

    def joined(which: dict[str, Column]) -> Column:
        return F.coalesce(F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(x)) for x, c in sorted(which.items())])), ","), F.lit(""))

    bases = {x: has(phrase_at[p]) for x, p in BASE.items()}
    of_templates = {x: reduce(Column.__or__, [has(clause_at[c], *[phrase_at[k] for k in keys]) for c, keys in several]) for x, several in TEMPLATES.items()}
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in vocabulary()}
    weights = F.array(*[F.lit(sum(idf[w] for w in sorted(set(p.split())))) for p in every])
    weight = F.aggregate("texts", F.lit(0.0), lambda x, i: x + F.coalesce(F.get(weights, i), F.lit(0.0)))
    score = F.round(1 - F.exp(-F.coalesce(weight, F.lit(0.0)) / 10), 6)
    return seen.drop("present").join(found, ["h1", "h2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        joined(bases).alias("base_labels"), joined(bases | of_templates).alias("labels"), score.alias("score"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence places and labels of every document; see ``scan``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op5"))


def _sql() -> str:
    """SQL that compares all words of all phrases, without an index of rare ones."""
    texts = [(i, t) for i, t in enumerate(phrases() + clauses())]
    at, clause_at = {p: i for i, p in enumerate(phrases())}, {c: len(phrases()) + i for i, c in enumerate(clauses())}
    split = ", ".join(f"({i}, {len(phrases()) <= i}, {k}, '{w}')" for i, t in texts for k, w in enumerate(t.split()))
    base = ", ".join(f"({at[p]}, '{x}')" for x, p in BASE.items())
    needs = ", ".join(f"({n}, '{label}', {i})" for n, (label, clause, keys) in enumerate((x, c, ks) for x, several in TEMPLATES.items() for c, ks in several) for i in [clause_at[clause], *[at[k] for k in keys]])
    return rf"""
WITH texts(i, clause, k, w) AS (VALUES {split}),
base(i, label) AS (VALUES {base}),
needs(n, label, i) AS (VALUES {needs}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents
), words AS (
  SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM docs
), kept AS (
  SELECT r, w, pos FROM words WHERE w IN (SELECT w FROM texts)
), freq AS (
  SELECT t.w, coalesce(f.n, 0) AS n FROM (SELECT DISTINCT w FROM texts) t LEFT JOIN (SELECT w, count(DISTINCT r) AS n FROM kept GROUP BY w) f ON t.w = f.w
), phrase_at AS (
  SELECT r, i, pos - k AS start FROM kept JOIN texts USING (w) WHERE NOT clause GROUP BY r, i, pos - k HAVING count(*) = (SELECT count(*) FROM texts x WHERE x.i = any_value(texts.i))
), rare AS (
  SELECT i, w, k FROM (
    SELECT i, w, min(k) AS k, row_number() OVER (PARTITION BY i ORDER BY any_value(n), min(k)) AS place FROM texts JOIN freq USING (w) WHERE clause GROUP BY i, w
  ) WHERE place <= {RARE}
), clause_in AS (
  SELECT DISTINCT r, i FROM (
    SELECT r, i, count(*) AS n FROM kept JOIN rare USING (w) GROUP BY r, i, pos - k
  ) JOIN (SELECT i, count(*) AS total FROM rare GROUP BY i) USING (i) WHERE n >= ceil({AGREE} * total)
), text_in AS (
  SELECT DISTINCT r, i FROM phrase_at UNION ALL SELECT r, i FROM clause_in
), label_in AS (
  SELECT r, label FROM text_in JOIN base USING (i)
  UNION
  SELECT r, label FROM (SELECT r, n, any_value(label) AS label, count(*) AS c FROM text_in JOIN needs USING (i) GROUP BY r, n) JOIN (SELECT n, count(*) AS total FROM needs GROUP BY n) USING (n) WHERE c = total
), places AS (
  SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM phrase_at JOIN base USING (i) GROUP BY r
), labelled AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM label_in GROUP BY r
), weights AS (
  SELECT i, sum(ln((1 + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + n))) AS x FROM (SELECT DISTINCT i, w FROM texts WHERE NOT clause) JOIN freq USING (w) GROUP BY i
), scored AS (
  SELECT r, sum(x) AS x FROM text_in JOIN weights USING (i) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(1 - exp(-coalesce(x, 0.0::DOUBLE) / 10), 6) AS score
FROM docs LEFT JOIN places USING (r) LEFT JOIN labelled USING (r) LEFT JOIN scored USING (r)
"""


OP5_SQL = _sql()
