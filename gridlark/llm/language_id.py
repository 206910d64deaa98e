"""Language identification by compression.

A language is a zstandard raw-content dictionary made of a bounded sample of its
texts.  A text, lower-cased and cut into pieces, is compressed with every
language's dictionary; the smallest total names the language.  ``margin`` is how
much the runner-up needs beyond the winner, as a share; narrow ones can be
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UNKNOWN = "und"
DOCS_PER_LANGUAGE, BYTES_PER_LANGUAGE, PIECE, LEVEL = 128, 110_000, 400, 6
#: Up to ``SHARED`` languages each have a whole sample, more of them share as much; beyond ``LANGUAGES`` fitting is refused.
SHARED, LANGUAGES = 128, 1024
#: Of a long sampled text this many parts of this many characters, spread over all of it, may be learned.
PARTS, PART = 8, 1_000
_LETTER = regex.compile(r"\p{L}")
_SPACE = regex.compile(r"[^\p{L}\p{M}']+")


def plain(text: str) -> str:
    """Lower case, with one space for anything but letters, their marks and apostrophes."""
    return _SPACE.sub(" ", text.lower())


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


class Compressors:
    """One compressor for each language."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        self.each = []
        for x in self.names:
            d = zstandard.ZstdCompressionDict(samples[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text for each language, piece by piece."""
        raw = plain(text).encode("utf-8", "replace")
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.each], np.float64)


def learn(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Dictionaries from ``(doc_id, text, lang)`` rows, null languages aside.

    Every language is learned.  The fit is bounded: at most ``per_language``
    documents of each, lowest id hashes first, and ``BYTES_PER_LANGUAGE`` of their
    text; more than ``SHARED`` languages share what ``SHARED`` of them may have, and
    more than ``languages`` are an error, as a column of so many is no language.
    A text gives all of itself or, if long, ``PARTS`` parts from its start to its
    end; what short ones leave of the bytes goes to the others' further parts.
    Ids are chosen without their texts, so a hot language costs no more; rows that
    repeat an id give one text.
    """
    rows = docs.where("lang is not null and text is not null")
    n_languages = len(rows.select("lang").distinct().limit(languages + 1).collect())
    if n_languages > languages:
        raise ValueError(f"More than {languages} languages to learn")
    share = max(1, n_languages / SHARED)
    per_language, most_bytes = max(1, int(per_language / share)), int(BYTES_PER_LANGUAGE / share)
    ranked = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("k", ranked).where(F.col("k") <= per_language)
    n = F.char_length("text")
    spread = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.substring("text", F.floor((n - PART) * i / (PARTS - 1)).cast("int") + 1, F.lit(PART)))
    some = docs.join(F.broadcast(ids.select("doc_id", "lang", "k")), ["doc_id", "lang"]).select("lang", "k", F.when(n <= PARTS * PART, F.array("text")).otherwise(spread).alias("parts"))
    some = some.groupBy("lang", "k").agg(F.min("parts").alias("parts"))
    of: dict[str, list[list[bytes]]] = {}
    for lang, _, parts in sorted(map(tuple, some.collect())):  # at most 128 x 128 rows of 8,000 characters, or one for each of 1,024 languages
        of.setdefault(lang, []).append([plain(x).encode("utf-8", "replace") for x in parts])
    samples = {}
    for lang, texts in of.items():
        turns = [t[k] for k in range(PARTS) for t in texts if k < len(t) and t[k].strip()]  # every text's first part, then the second ones
        if turns:
            samples[lang] = b" ".join(turns)[:most_bytes]
    return samples


def _named(samples: dict[str, bytes]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Compressors(samples)
        for batch in batches:
            ids, names, margins, scores = batch.column("doc_id"), [], [], []
            for text in batch.column("text").to_pylist():
                if not known.names or not has_letter(text):
                    names.append(UNKNOWN)
                    margins.append(0.0)
                    scores.append(0.0)
                    continue
                s = known.sizes(text)
                best = int(np.argmin(s))
                rest = np.delete(s, best)
                names.append(known.names[best])
                margins.append(float(rest.min() / s[best] - 1) if len(rest) else 1.0)
                scores.append(float(1 / np.exp(-np.minimum(50, 40 * (s / s[best] - 1))).sum()))
            yield pa.record_batch([ids, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    return emit


def identify(docs: DataFrame, samples: dict[str, bytes], min_margin: float = 0.0) -> DataFrame:
    """``(doc_id, lang_pred, score, margin)`` of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, and so are
    those whose margin is below ``min_margin``; equal sizes go to the first
    language by name; repeated rows answer alike; an empty table gives no rows;
    other columns are ignored.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_named(samples), "doc_id long, lang_pred string, score double, margin double")
    if min_margin <= 0:
        return out
    return out.withColumn("lang_pred", F.when(F.col("margin") >= min_margin, F.col("lang_pred")).otherwise(UNKNOWN))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language; the query rejects no narrow margin."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return identify(docs, learn(docs.where(~held))).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "margin")
