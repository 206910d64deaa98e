"""Constraints on tables: violations as rows, quarantine, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.boxes import valid_bbox


class ConstraintError(ValueError):
    """A table breaks a rule that the caller asked to be held."""


def assert_none(bad: DataFrame, message: str) -> None:
    """Fail with a few of the rows, if there are any."""
    some = bad.limit(3).collect()
    if some:
        raise ConstraintError(f"{message}: {[r.asDict() for r in some]}")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key ``other`` lacks; null keys are missing."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def bad_ids(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNull() | (F.col(name) < 0))


def blank_text(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNull() | (F.trim(name) == ""))


def annotation_issues(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with ``issue``: null for good ones, and ``kept``.

    Rules apply in order, the first that is broken names the issue; a box that
    leaves its image by more than a pixel is reported and kept.
    """
    known = images.select(F.col("id").alias("image_id"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    named = categories.select(F.col("id").alias("category_id"), F.lit(True).alias("_c"))
    a = annotations.join(known, "image_id", "left").join(named, "category_id", "left")
    b = [F.get("bbox", i) for i in range(4)]
    number = F.coalesce(F.size("bbox") == 4, F.lit(False))
    for x in b:
        number = number & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    issue = (  # Fixed values: the names of the issues
        F.when(F.col("_w").isNull() | F.col("_c").isNull(), "unknown image or category")
        .when(~number, "invalid numeric bbox")
        .when((b[2] <= 0) | (b[3] <= 0) | (F.col("_w") <= 0) | (F.col("_h") <= 0), "nonpositive dimensions")
        .when((b[0] < 0) | (b[1] < 0) | (b[0] + b[2] > F.col("_w") + 1) | (b[1] + b[3] > F.col("_h") + 1), "bbox exceeds image")
    )
    return a.withColumn("issue", issue).withColumn("kept", issue.isNull() | (issue == "bbox exceeds image")).drop("_w", "_h", "_c")


def quarantine(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold the condition, and the others."""
    flag = F.coalesce(good, F.lit(False))
    return df.where(flag), df.where(~flag)


def validated(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> None:
    """The fail-fast form: unique keys, references, and boxes."""
    for df, keys, what in ((images, ["id"], "image id"), (annotations, ["id"], "annotation id"), (categories, ["id"], "category id"), (categories, ["name"], "category name")):
        assert_none(duplicate_keys(df, *keys), f"Repeated {what}")
        if keys == ["id"]:
            assert_none(bad_ids(df, "id"), f"Invalid {what}")
    assert_none(blank_text(categories, "name"), "Blank category name")
    assert_none(missing_keys(annotations, images.select(F.col("id").alias("image_id")), "image_id"), "Unknown image")
    assert_none(missing_keys(annotations, categories.select(F.col("id").alias("category_id")), "category_id"), "Unknown category")
    assert_none(annotations.where(~valid_bbox(F.col("bbox"))), "Invalid box")


def uncovered(images: DataFrame, groups: DataFrame) -> DataFrame:
    """Images without a group."""
    return missing_keys(images, groups, "image_id")


def count_mismatches(labels: DataFrame, manifest: DataFrame, key: str = "image") -> DataFrame:
    """Images whose number of labels is not the manifest's ``objects``."""
    have = labels.groupBy(key).agg(F.count("*").alias("found"))
    return manifest.join(have, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).where("found <> objects")


def unmapped_classes(used: DataFrame, mapping: DataFrame, key: str = "class_id") -> DataFrame:
    """Classes that a model uses and a class map lacks, once each."""
    return missing_keys(used, mapping, key).select(key).distinct()


def readable(images: DataFrame, status: str = "status") -> DataFrame:
    """Images that could be decoded."""
    return images.where(F.col(status) != "missing_or_corrupt")


def changed_keys(record: DataFrame, frozen: DataFrame, keys: list[str]) -> DataFrame:
    """``(key, was, now)`` of those keys of a one-row record that differ from the frozen one."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"a.{k}").cast("string").alias("was"), F.col(f"b.{k}").cast("string").alias("now")) for k in keys])
    both = frozen.alias("a").crossJoin(F.broadcast(record.limit(1)).alias("b"))  # one row each
    return both.select(F.inline(rows)).where(~F.col("was").eqNullSafe(F.col("now")))


def validation_counters(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: images, repeated ones among them, annotations, those with a valid box and on a known image."""
    n = images.agg(F.count("*").alias("images"), (F.count("*") - F.count_distinct("sha256")).alias("duplicates"))
    known = images.select(F.col("image_id"), F.lit(1).alias("_known"))
    a = annotations.join(known, "image_id", "left").agg(
        F.count("*").alias("annotations"), F.count_if(valid_bbox(F.col("bbox"))).alias("valid_boxes"), F.count("_known").alias("on_known_images")
    )
    return n.crossJoin(a)  # one row each


def enough_images(images: DataFrame, least: int = 100) -> None:
    """Refuse a selection with too few images for an experiment."""
    n = images.limit(least).count()
    if n < least:
        raise ConstraintError(f"{n} images; an experiment needs at least {least}")


def splits_lacking_classes(objects: DataFrame, classes: int) -> DataFrame:
    return objects.groupBy("split").agg(F.count_distinct("class_id").alias("n")).where(F.col("n") < classes)


def differing_columns(runs: DataFrame, columns: list[str], required: list[str] = ()) -> list[str]:
    """Columns in which runs differ, or that a run lacks where it is required."""
    one = runs.agg(*[F.count_distinct(F.to_json(F.struct(c))).alias(f"n_{i}") for i, c in enumerate(columns)], *[F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if one[f"n_{i}"] > 1 or (c in required and one[f"m_{i}"])]


def require_columns(df: DataFrame, *names: str) -> None:
    lacking = sorted(set(names) - set(df.columns))
    if lacking:
        raise ConstraintError(f"Missing columns: {lacking}")


def confidence_grid(values: list[float]) -> list[float]:
    """Distinct and sorted; every value in (0, 1]."""
    if not values or any(not 0 < v <= 1 for v in values):
        raise ConstraintError("A confidence of the grid is not above 0 and at most 1, or there is none")
    return sorted(set(values))


def inference_settings(imgsz: int, conf: float, iou: float, max_det: int) -> None:
    if isinstance(imgsz, bool) or imgsz < 32 or imgsz % 32 or not 0 < conf <= 1 or not 0 < iou <= 1 or max_det < 1:
        raise ConstraintError("imgsz must be a positive multiple of 32, conf and iou in (0, 1], max_det at least 1")
