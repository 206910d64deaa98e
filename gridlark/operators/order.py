"""Running sums and order statistics without a task that holds a whole group.

Rows are sorted by ranges; each range knows the sums of its own rows, and what
the ranges before it add up to is one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.scratch import Scratch


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys where null equals null; the keys appear once."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def running_sums(rows: DataFrame, by: list[str], order: list[str], values: list[str], scratch: Scratch, name: str = "ranges") -> DataFrame:
    """``rows`` with ``before_<value>``: the sum over the rows of the same ``by``
    that come earlier in ``order``; rows equal in ``order`` in any one order.

    Within a range a window runs over its rows of a group; across ranges the sums
    are one row for each range and group in it, without groups one number a range
    that the driver adds up.
    """
    sorted_ = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    held = scratch.table(sorted_.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), name)
    sums = held.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    zero = {v: F.lit(0).cast(sums.schema[f"_sum_{v}"].dataType) for v in values}
    if by:
        earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        offsets = sums.select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), zero[v]).alias(f"_off_{v}") for v in values])
    else:
        total, out = [0] * len(values), []
        for part, *own in sorted(map(tuple, sums.select("_range", *[F.coalesce(f"_sum_{v}", zero[v]) for v in values]).collect())):  # one row a range
            out.append((part, *total))
            total = [a + b for a, b in zip(total, own, strict=True)]
        types = ", ".join(f"_off_{v} {sums.schema[f'_sum_{v}'].dataType.simpleString()}" for v in values)
        offsets = rows.sparkSession.createDataFrame(out, f"_range int, {types}")
    within = W.partitionBy(*by, "_range").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    inside = held.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(within), zero[v]) for v in values})
    both = same_keys(inside, offsets, [*by, "_range"])
    return both.select(*rows.columns, *[(F.col(f"_off_{v}") + F.col(f"_in_{v}")).alias(f"before_{v}") for v in values])


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], scratch: Scratch) -> DataFrame:
    """Exact percentiles of a column by group, linear between neighbours; nulls do
    not count, a group without values has nulls.

    Equal values are counted first; running counts then tell which value has the
    wanted rank, so nothing but one row a value is sorted and no group is held.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_sums(counts, by, ["_v"], ["_n"], scratch, f"ranks-{value}")
    totals = rows.groupBy(*by).agg(F.count(value).alias("_total"))
    first, after = F.col("before__n"), F.col("before__n") + F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < after), F.col("_v")))

    position = {n: s * (F.col("_total") - 1) for n, s in shares.items()}
    picked = [x for n, p in position.items() for x in (at(F.floor(p)).alias(f"_lo_{n}"), at(F.ceil(p)).alias(f"_hi_{n}"))]
    found = same_keys(ranked, totals, by).groupBy(*by).agg(F.first("_total").alias("_total"), *picked)

    def between(name: str) -> Column:
        p, lo, hi = position[name], F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when(F.floor(p) == F.ceil(p), lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(name)

    return same_keys(totals.select(*by), found.select(*by, *map(between, shares)), by, "left")
