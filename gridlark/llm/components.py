"""Connected components by alternating large-star and small-star rounds.

Every round is joins and combinable ``min`` aggregates, so a node with very
many links is pre-aggregated before a shuffle and its join side can be split
by AQE.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _signature(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"),
            F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")),
        ).first()
    )


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``edges(a long, b long)``, any direction, repeats and self links allowed.

    Returns ``(node, component)``: the smallest node reachable, for every node
    that has a link to another one.  No edges give no rows; edges with a null
    end are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.table(e, f"{name}-0")
    seen, turn = _signature(e), 0
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        turn += 1
        out = scratch.table(out, f"{name}-{turn}")
        now = _signature(out)
        scratch.drop(f"{name}-{turn - 1}")
        e, same, seen = out, now == seen, now
        if same:
            break
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
