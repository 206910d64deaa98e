"""Profiles: counts, roll-ups, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Objects and distinct images of every class, zero included."""
    n = boxes.groupBy("class_id").agg(F.count("*").alias("objects"), F.count_distinct("image_id").alias("images"))
    zero = F.lit(0).cast("long")
    return classes.join(n, "class_id", "left").select(*classes.columns, F.coalesce("objects", zero).alias("objects"), F.coalesce("images", zero).alias("images"))


def objects_per_image(images: DataFrame, boxes: DataFrame) -> DataFrame:
    n = boxes.groupBy("image_id").agg(F.count("*").alias("objects"))
    return images.join(n, "image_id", "left").withColumn("objects", F.coalesce("objects", F.lit(0).cast("long")))


def counts_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def split_rollup(tiles: DataFrame) -> DataFrame:
    """Images, objects, empty images and source images by split and in all.

    ``tiles`` is ``(split, image_id, objects)``; the total's split is null.
    """
    return tiles.rollup("split").agg(
        F.count("*").alias("images"), F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"), F.count_if(F.col("objects") == 0).alias("negative_images"), F.count_distinct("image_id").alias("source_images")
    )


def split_class_counts(objects: DataFrame, classes: list[int]) -> DataFrame:
    return objects.groupBy("split").pivot("class_id", classes).count().fillna(0)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``(bin, low, high, n)`` over equal widths; the last bin holds its right edge.

    Two passes of partial aggregates; equal values make bins of one unit around them.
    """
    edge = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    edge = edge.select(lo.alias("lo"), hi.alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edge)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / width)))  # one row of edges
    n = placed.groupBy("bin").agg(F.count("*").alias("n"))
    all_ = edge.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), (F.col("lo")).alias("lo"), width.alias("w"))
    return all_.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def distinct_bases(groups: DataFrame) -> DataFrame:
    """The set of group bases, and whether any is unverified."""
    basis = F.coalesce("basis", F.lit("unspecified"))
    return groups.agg(F.sort_array(F.collect_set(basis)).alias("bases"), F.bool_or(basis.rlike("unverified|heuristic")).alias("unverified"))


def objects_of_representatives(boxes: DataFrame, representatives: DataFrame) -> DataFrame:
    """Objects per class on the images that stand for their copies."""
    return boxes.join(representatives.select("image_id"), "image_id", "left_semi").groupBy("class_id").agg(F.count("*").alias("objects"))


def component_counts(components: DataFrame) -> DataFrame:
    """One row: groups and the components that they fall into."""
    return components.agg(F.count("*").alias("groups"), F.count_distinct("root").alias("components"))
