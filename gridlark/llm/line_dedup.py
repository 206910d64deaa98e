"""Line deduplication over levelled sorted runs of line hashes.

The state is a log-structured store: each batch of documents writes one run of
``(h1, h2, n, last)`` rows, hash-bucketed and sorted by the 128-bit line hash,
with the documents that hold the line in that batch and, where the batch is the
first to show it, the largest of them.  ``FANOUT`` runs of a level are merged
into one of the next.  A new batch is merge-anti-joined with the runs to tell new
lines from known ones; runs and batch are bucketed alike, so no run is shuffled.
Batches go from large document ids to small ones, so the batch that first shows
a line also holds its largest document.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, short_shuffles

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
KEY = ["h1", "h2"]
ADDED = ("kept_text", "n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    """The line without outer ASCII white space, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(F.lit(7), key)]


def merge_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one by a merge join on their sorted buckets.

    A grouped union would do the same, but Spark 4.1 drops its exchange for
    bucketed scans that it then reads unbucketed, and leaves keys apart.
    """
    b = b.select(*KEY, F.col("n").alias("n2"), F.col("last").alias("last2"))
    zero = F.lit(0).cast("long")
    joined = a.join(b.hint("merge"), KEY, "full")
    return joined.select(*KEY, (F.coalesce("n", zero) + F.coalesce("n2", zero)).alias("n"), F.greatest("last", "last2").alias("last"))


class LineRuns:
    """Levelled runs in bucketed tables of the shared warehouse."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.made, self.levels = f"line_runs_{uuid.uuid4().hex}", 0, [[]]

    def _write(self, rows: DataFrame, level: int) -> None:
        self.made += 1
        name = f"{self.name}_{self.made}"
        with short_shuffles(self.spark):
            rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def merged(self) -> DataFrame:
        """All runs as one."""
        return reduce(merge_runs, self.runs())

    def add(self, batch: DataFrame) -> None:
        """Add ``(h1, h2, doc_id)`` rows of documents below all earlier ones."""
        own = batch.distinct().groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        fresh = own
        for run in self.runs():
            fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        if self.made:
            fresh = fresh.select(*KEY, F.lit(True).alias("fresh"))
            own = own.join(fresh, KEY, "left").select(*KEY, "n", F.when(F.col("fresh"), F.col("last")).alias("last"))
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(reduce(merge_runs, [self.spark.table(x) for x in full]), level + 1)
            self._drop(full)
            level += 1

    def _drop(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {x}")

    def close(self) -> None:
        self._drop([x for level in self.levels for x in level])


def drop_repeated_lines(docs: DataFrame, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """The documents with columns ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    Lines are what newlines separate; a null or empty text is one empty line.
    Lines whose key has ``LEAST_CHARS`` code points or more and is found in
    ``LEAST_DOCS`` documents or more go, except in the largest ``doc_id`` holding
    it, where all of its lines stay.  Rows that repeat an id count as one
    document, each keeping or losing its own lines; a row with a null id keeps its lines and counts for none.  An empty
    table gives no rows; other columns pass through under any name, but those of
    the added columns' names are replaced.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    # rows that repeat an id may differ in text, so a line's place needs the text's hash as well
    keyed = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("of"), F.posexplode(lines).alias("pos", "line"))
    keyed = keyed.select("doc_id", "of", "pos", line_key(F.col("line")).alias("key"))
    h1, h2 = hashes(F.col("key"))
    keyed = keyed.where(F.char_length("key") >= LEAST_CHARS).select("doc_id", "of", "pos", h1.alias("h1"), h2.alias("h2"))
    keyed = scratch.table(keyed, "keys")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    runs = LineRuns(spark)
    try:
        if low is not None:
            cuts = [high - (high + 1 - low) * i // batches for i in range(batches)] + [low - 1]
            for upper, below in zip(cuts, cuts[1:], strict=False):
                if upper > below:
                    runs.add(keyed.where(F.col("doc_id").between(below + 1, upper)).select("doc_id", "h1", "h2"))
            doomed = runs.merged().where(F.col("n") >= LEAST_DOCS)
        else:
            doomed = spark.createDataFrame([], "h1 long, h2 long, n long, last long")
        doomed = scratch.table(doomed.select(*KEY, "last"), "doomed")
    finally:
        runs.close()
    gone = keyed.join(doomed, KEY).where("doc_id <> last").select("doc_id", "of", "pos").distinct()
    gone = scratch.table(gone.groupBy("doc_id", "of").agg(F.collect_list("pos").alias("_gone")), "gone")  # places in one text
    scratch.drop("keys", "doomed")

    own = [c for c in docs.columns if c.lower() not in ADDED]
    whole = docs.select(F.struct(*own).alias("doc"))  # so that no column clashes with those below
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("of").alias("_of"), "_gone")
    text = F.coalesce("doc.text", F.lit(""))
    out = whole.join(gone, (F.col("doc.doc_id") == F.col("_id")) & (F.xxhash64(text) == F.col("_of")), "left")
    out = out.withColumn("_lines", F.split(text, "\n", -1))
    n = F.size("_lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "_gone"), lambda i: F.get("_lines", i))  # by a hash set, whatever the numbers
    left = F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(text)
    dropped = F.when(F.col("_gone").isNotNull(), F.size("_gone")).otherwise(F.lit(0))
    out = out.select("doc", F.struct(left.alias("kept_text"), n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped")).alias("added"))
    return out.select("doc.*", "added.*")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines dropped from each document and the digest of the rest."""
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Scratch(spark, "op6"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(str_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), doomed AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, d.key IS NOT NULL AND k.doc_id <> d.keeper AS gone FROM keyed k LEFT JOIN doomed d ON k.key = d.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
