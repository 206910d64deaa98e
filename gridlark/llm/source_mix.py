"""Mixing sources to target weights.

Words are summed per source, targets follow from the sources' weights by water
filling, and each document is emitted ``floor(rate)`` times plus one more copy
with the fraction's probability, decided by a seeded hash of its id.  Each source takes,
of ``SEEDS`` seeds, that whose copies come nearest to its target, so that a source
of few documents of very different length does not miss it by chance; one aggregate
weighs all seeds at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

MOST = 3
FEW_SOURCES = 100_000
SEEDS = 64


def words_in(text) -> F.Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating.  A source
    is full at ``MOST`` times its size.  Ordered by the level at which they fill
    up, full sources come first, so the common level follows from running sums:
    it is that of the first source that the level does not fill.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("w", ((F.row_number().over(named) - 1) % 3 + 1).cast("long"))
    order = W.orderBy((MOST * F.col("source_size") / F.col("w")).asc(), F.col("source").isNull(), "source")
    every = W.partitionBy()
    by = by.select(
        "source", "source_size", "w",
        F.row_number().over(order).alias("k"),
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum(MOST * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("rest"),
    )
    level = (F.col("total") - F.col("full")).cast("double") / F.col("rest").cast("double")
    open_ = level * F.col("w") <= (MOST * F.col("source_size")).cast("double")
    by = by.withColumn("first", F.min(F.when(open_, F.struct("k", level.alias("level")))).over(every))
    target = F.when(F.col("k") >= F.col("first.k"), F.col("first.level") * F.col("w")).otherwise((MOST * F.col("source_size")).cast("double"))
    return by.select("source", "source_size", target.alias("target"))


def drawn(doc_id) -> F.Column:
    """32 bits from the id alone."""
    hexed = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    return F.conv(hexed, 16, 10).cast("long")


def uniform(bits, seed) -> F.Column:
    """A number in [0, 1) of the drawn bits and a seed below ``SEEDS``: by an odd factor, so each is as even as the bits."""
    factor = seed * F.lit(7_985_862).cast("long") + F.lit(1_640_531_527).cast("long")
    return (bits * factor) % F.lit(4294967296) / F.lit(4294967296.0)


def rates_of(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(_source, source_size, target, rate, seed)`` of ``(source, size, doc_id)``."""
    by = scratch.table(targets(sizes).withColumnRenamed("source", "_source").withColumn("rate", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))), "targets")
    few = by.count() <= FEW_SOURCES
    near = F.broadcast(by) if few else by
    rated = sizes.select("source", "size", drawn(F.col("doc_id")).alias("bits")).join(near, F.col("source").eqNullSafe(F.col("_source")))
    part = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(uniform(F.col("bits"), F.lit(s)) < part, F.col("size")).otherwise(0)).alias(f"e{s}") for s in range(SEEDS)]
    sums = rated.groupBy("_source").agg(*extra)
    joined = by.join(sums.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    off = [F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"e{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)]
    best = joined.select("_source", "source_size", "target", "rate", F.array_min(F.array(*off))["seed"].alias("seed"))
    best = scratch.table(best, "rates")
    return F.broadcast(best) if few else best


def copies(doc_id) -> F.Column:
    extra = uniform(drawn(doc_id), F.col("seed")) < F.col("rate") - F.floor("rate")
    return F.floor("rate") + extra.cast("long")


def copies_of(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to ``(source, size, doc_id)``."""
    rates = rates_of(sizes, scratch)
    return sizes.join(rates, F.col("source").eqNullSafe(F.col("_source"))).select(*sizes.columns, "source_size", "target", copies(F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents of the mix, each as often as it is taken, columns as given.

    Texts that are null or without words have size 0 and are emitted at their
    source's rate; a null source is a source of its own; rows that repeat an id
    share its draw; an empty table gives no rows; other columns pass through under
    any name.
    """
    sizes = scratch.table(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "sizes")
    rates = rates_of(sizes, scratch)
    whole = docs.select(F.struct(*docs.columns).alias("doc"))  # so that no column clashes with those below
    out = whole.join(rates, F.col("doc.source").eqNullSafe(F.col("_source"))).withColumn("_copies", copies(F.col("doc.doc_id")).cast("int")).where("_copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("doc.*")


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; see ``copies_of``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "op7")
    out = copies_of(scratch.table(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "sizes"), scratch)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source
), run AS (
  SELECT source, source_size, w,
    row_number() OVER o AS k,
    sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM named WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w::DOUBLE, source IS NULL, source)
), levels AS (
  SELECT *, (total - filled)::DOUBLE / rest::DOUBLE AS level FROM run
), first_open AS (
  SELECT min(k) AS k1, arg_min(level, k) AS level1 FROM levels WHERE level * w <= (3 * source_size)::DOUBLE
), targets AS (
  SELECT source, source_size, CASE WHEN k >= k1 THEN level1 * w ELSE (3 * source_size)::DOUBLE END AS target FROM levels, first_open
), rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS bits
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), tried AS (
  SELECT *, ((bits * (seed * 7985862 + 1640531527)) % 4294967296) / 4294967296.0::DOUBLE < rate - floor(rate) AS extra FROM rated, range(64) r(seed)
), missed AS (
  SELECT source, seed, abs(floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN extra THEN size ELSE 0 END)::BIGINT - any_value(target)) AS off FROM tried GROUP BY source, seed
), ranked AS (
  SELECT source, seed, row_number() OVER (PARTITION BY source ORDER BY off, seed) AS place FROM missed
)
SELECT t.doc_id, t.size, t.source_size, t.target, (t.size * (floor(t.rate) + CASE WHEN t.extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM tried t JOIN ranked k ON t.seed = k.seed AND t.source IS NOT DISTINCT FROM k.source WHERE k.place = 1
"""
