"""Latency statistics, run comparison and model selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.scratch import Scratch

from .order import percentiles, same_keys
from .quality import ConstraintError, differing_columns

#: Metric columns of run records and their short names.
METRICS = {"metrics/precision(B)": "precision", "metrics/recall(B)": "recall", "metrics/mAP50(B)": "mAP50", "metrics/mAP50-95(B)": "mAP50_95"}


def latency_stats(samples: DataFrame, key: str = "model", value: str = "wall_ms") -> DataFrame:
    """Exact mean, median and linear 95th percentile by key."""
    return _stats(samples, [key], value)


def stage_stats(samples: DataFrame, stages: list[str], key: str = "model") -> DataFrame:
    """The same for each stage column, as rows."""
    return _stats(samples.unpivot([key], stages, "stage", "ms"), [key, "stage"], "ms")


def _stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_ms"))
    return same_keys(plain, percentiles(rows, by, value, {"median_ms": 0.5, "p95_ms": 0.95}, Scratch(rows.sparkSession, "latency")), by)


def best_model(rows: DataFrame, metric: str = "mAP50_95", name: str = "name") -> DataFrame:
    """The row with the greatest metric, first by name among equals."""
    return rows.orderBy(F.desc(metric), name).limit(1)


def worst_images(counts: DataFrame, n: int = 15) -> DataFrame:
    return counts.orderBy(F.desc("fn"), F.desc("fp"), "image_id").limit(n)


def best_examples(hits: DataFrame, truths: DataFrame) -> DataFrame:
    """For each class the correct detection of greatest confidence (then greatest
    image), else the first image that has a truth of the class."""
    right = hits.where("tj is not null").groupBy("class_id").agg(F.max(F.struct("confidence", "image_id")).alias("b"))
    any_ = truths.groupBy("class_id").agg(F.min("image_id").alias("first"))
    status = F.when(F.col("b").isNotNull(), "correct_detection").otherwise("no_correct_detection")
    return any_.join(right, "class_id", "left").select("class_id", F.coalesce("b.image_id", "first").alias("image_id"), F.col("b.confidence").alias("confidence"), status.alias("status"))


def examples_per_kind(counts: DataFrame, n: int) -> DataFrame:
    """The first ``n`` images of each kind of error; an image may show several."""
    from pyspark.sql import Window as W

    kinds = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in ("tp", "fp", "fn")]))
    long = counts.withColumn("kind", F.explode(kinds))
    return long.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy("image_id"))).where(F.col("rank") <= n)


def renamed_metrics(rows: DataFrame) -> DataFrame:
    """Stripped column names, with the long metric names shortened."""
    clean = rows.toDF(*[c.strip() for c in rows.columns])
    return clean.withColumnsRenamed({k: v for k, v in METRICS.items() if k in clean.columns})


def compare_runs(runs: DataFrame, same: list[str], required: list[str] = ()) -> DataFrame:
    """Runs side by side, if there are two or more and ``same`` columns agree."""
    if runs.limit(2).count() < 2:
        raise ConstraintError("Fewer than two runs to compare")
    off = differing_columns(runs, same, list(required))
    if off:
        raise ConstraintError(f"Runs disagree on {off}")
    return renamed_metrics(runs)


def homogeneity(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct and missing values of each column, as rows."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(F.col(c).cast("string")).alias("versions"), F.count_if(F.col(c).isNull()).alias("missing")) for c in columns])
    return runs.agg(rows.alias("r")).select(F.inline("r")).withColumn("homogeneous", (F.col("versions") <= 1) & (F.col("missing") == 0))


def frozen(best: DataFrame, conf: float, identity: str, **settings: object) -> DataFrame:
    """The selection record: the best row with what it must be tested under."""
    out = best.withColumn("conf", F.lit(float(conf))).withColumn("dataset_identity", F.lit(identity))
    for k, v in settings.items():
        out = out.withColumn(k, F.lit(v))
    digest = F.sha2(F.to_json(F.struct(*sorted(out.columns))), 256)
    return out.withColumn("selection_sha256", digest)


def held_out_gate(selection: DataFrame, identity: str) -> None:
    """Refuse a changed selection or another dataset."""
    row = selection.withColumn("_now", F.sha2(F.to_json(F.struct(*sorted(c for c in selection.columns if c != "selection_sha256"))), 256)).first()
    if row is None or row["_now"] != row["selection_sha256"]:
        raise ConstraintError("The selection was changed after it was frozen")
    if row["dataset_identity"] != identity:
        raise ConstraintError("The dataset is not the one that the selection was made on")


def richest_image(hits: DataFrame) -> DataFrame:
    """The image with most correct detections, then most classes among them, then the smallest id."""
    n = hits.where("tj is not null").groupBy("image_id").agg(F.count("*").alias("tp"), F.count_distinct("class_id").alias("classes"))
    return n.orderBy(F.desc("tp"), F.desc("classes"), "image_id").limit(1)


def with_latency(comparison: DataFrame, latency: DataFrame, name: str = "name", key: str = "model") -> DataFrame:
    """Compared models with their latency, null where it was not measured."""
    return comparison.join(latency.withColumnRenamed(key, name), name, "left")


def points_apart(metric: Column, base: Column) -> Column:
    """The difference of two shares in percentage points, to two places, half to even."""
    return F.bround((metric - base) * 100, 2)
