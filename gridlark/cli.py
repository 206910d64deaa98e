"""Command line: ``python -m gridlark.cli COMMAND ...``.

Paths are anything Spark reads; outputs must not exist.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.functions import names as N
from gridlark.operators import curate, matching, profile, quality, selection, tiling, trace
from gridlark.session import session
from gridlark.sources import readers, writers

CORNERS = ("x1", "y1", "x2", "y2")


def audit(spark: SparkSession, annotations: str, output: str) -> None:
    """Class counts, filename groups, issues and box sizes; bad rows are kept apart."""
    doc = readers.coco(spark, annotations, strict=False)
    images, classes = doc["images"].withColumn("image_id", F.col("id")), doc["categories"].withColumnRenamed("id", "class_id")
    judged = quality.annotation_issues(doc["annotations"], doc["images"], doc["categories"])
    good = judged.where("kept").withColumnRenamed("category_id", "class_id")
    writers.csv(profile.class_counts(good, classes), f"{output}/classes", ["class_id", "name", "objects", "images"])
    per_image = profile.objects_per_image(images, good).withColumn("suggested_group", N.sequence_group(F.col("file_name")))
    writers.csv(per_image, f"{output}/images", ["image_id", "file_name", "width", "height", "objects", "suggested_group"])
    sized = good.join(images.select("image_id", "width", "height"), "image_id")
    w, h, wide, high = F.get("bbox", 2), F.get("bbox", 3), F.col("width"), F.col("height")
    sized = sized.select("image_id", "class_id", w.alias("width_px"), h.alias("height_px"), B.relative_area(w, h, wide, high).alias("relative_area"), B.short_side(w, h, wide, high).alias("min_side_after_resize_640"))
    writers.csv(sized, f"{output}/boxes", sized.columns)
    writers.json_rows(judged.where("issue is not null").select("id", "issue"), f"{output}/issues")


def prepare(spark: SparkSession, annotations: str, groups: str, digests: str, output: str, seed: int = 42, tile: int | None = None, overlap: float = 0.0) -> None:
    """Validated, de-duplicated, split and tiled boxes with their manifests.

    ``digests`` is a table of (image_id, sha256) of the decoded images.
    """
    doc = readers.coco(spark, annotations)
    quality.validated(doc["images"], doc["annotations"], doc["categories"])
    images = doc["images"].withColumnRenamed("id", "image_id").select("image_id", "file_name", "width", "height")
    group_map = readers.groups(spark, groups).select("image_id", "group_id")
    quality.assert_none(quality.uncovered(images, group_map), "Image without a group")
    images = images.join(group_map, "image_id").join(spark.read.parquet(digests), "image_id")
    classes = curate.reindexed(doc["categories"])
    a = doc["annotations"].join(classes.select(F.col("source_id").alias("category_id"), F.col("id").alias("class_id")), "category_id").join(images.select("image_id", "width", "height"), "image_id")
    corners = B.clip(*[F.get("bbox", i) for i in range(4)], F.col("width"), F.col("height"))
    boxes = a.select("image_id", "class_id", *[c.alias(n) for c, n in zip(corners, CORNERS, strict=True)])
    quality.assert_none(boxes.where(~B.has_area(*[F.col(c) for c in CORNERS])), "Box outside its image")
    quality.assert_none(curate.duplicate_conflicts(images, boxes), "Copies of an image differ in their boxes")
    components = curate.group_components(images)
    split = curate.assign_splits(images, components, seed).select("image_id", "split")
    writers.csv(curate.exact_dedup(images).join(split, "image_id"), f"{output}/split_manifest", ["image_id", "file_name", "group_id", "split", "sha256", "duplicate_of"])
    kept = curate.representatives(images)
    tiles = tiling.tile_grid(kept, tile, overlap)
    parts = tiling.boxes_in_tiles(tiles, boxes) if tile is None else tiling.boxes_on_grid(kept, boxes, tile, overlap)
    counts = tiling.tile_counts(tiles, parts).join(split, "image_id")
    writers.parquet(counts, f"{output}/tiles", "split")
    size = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    shares = B.normalised(*[F.col(c) for c in CORNERS], *size)
    labels = parts.join(tiles, ["image_id", "tile"]).join(split, "image_id").select("image_id", "tile", "split", "class_id", *[s.alias(n) for s, n in zip(shares, ("cx", "cy", "w", "h"), strict=True)])
    writers.parquet(labels, f"{output}/labels", "split")
    writers.json_rows(profile.split_rollup(counts.select("split", "image_id", "objects")), f"{output}/rollup")


def nested(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections, truths and images of per-image records."""

    def flat(name: str, number: str, *more: str) -> DataFrame:
        x = rows.select(F.col("image").alias("image_id"), F.posexplode(name).alias(number, "v"))
        return x.select("image_id", number, "v.class_id", *[f"v.{m}" for m in more], *[F.get("v.xyxy", i).alias(c) for i, c in enumerate(CORNERS)])

    return flat("detections", "di", "confidence"), flat("truth", "tj"), rows.select(F.col("image").alias("image_id"))


def evaluate(spark: SparkSession, per_image: str, output: str, grid: list[float], match_iou: float = 0.5) -> None:
    """Curve, operating point, class scores and error rows of per-image records."""
    dets, truths, images = nested(readers.per_image(spark, per_image))
    hits = matching.matched(dets, truths, match_iou)
    curve = matching.confidence_curve(hits, truths, grid)
    conf = matching.best_threshold(curve).first()["conf"]
    writers.json_rows(curve, f"{output}/curve")
    writers.json_rows(matching.best_threshold(curve), f"{output}/operating_point")
    writers.json_rows(matching.class_scores(hits, truths, conf), f"{output}/classes")
    writers.json_rows(matching.error_rows(hits, dets, truths, images, conf), f"{output}/per_image")
    writers.json_rows(matching.fp_taxonomy(hits, dets, truths, conf, match_iou), f"{output}/false_positives")


def analyze(spark: SparkSession, per_image: str, images: str, output: str, conf: float, match_iou: float = 0.5) -> None:
    """Recall by object size and kinds of false positives of per-image records."""
    dets, truths, _ = nested(readers.per_image(spark, per_image))
    sizes = readers.csv(spark, images).select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    hits = matching.matched(dets, truths, match_iou)
    writers.json_rows(matching.recall_by_size(hits, truths, sizes, conf), f"{output}/recall_by_size")
    writers.json_rows(matching.fp_taxonomy(hits, dets, truths, conf, match_iou), f"{output}/false_positives")


def select(spark: SparkSession, runs: str, manifest: str, output: str, conf: float, metric: str = "mAP50_95") -> None:
    """The best run, frozen with its confidence and the dataset's identity."""
    best = selection.best_model(selection.renamed_metrics(spark.read.json(runs)), metric)
    identity = curate.table_identity(readers.csv(spark, manifest)).first()["identity"]
    writers.json_rows(selection.frozen(best, conf, identity), output)


def gate(spark: SparkSession, chosen: str, manifest: str) -> str:
    """The frozen selection's name, if neither it nor the dataset was changed since."""
    row = spark.read.json(chosen)
    selection.held_out_gate(row, curate.table_identity(readers.csv(spark, manifest)).first()["identity"])
    return row.first()["name"]


def _chain(spark: SparkSession, selected: dict, manifest: str, report: str, weights: str) -> DataFrame:
    """Digests of all that a final test rests on: manifest rows by split, selection by key, files by name."""
    out = trace.leaves("dataset", readers.csv(spark, manifest), "split").unionByName(trace.record_leaf(spark, "selection", selected))
    for part, path in (("report", report), ("weights", weights)):
        found = readers.file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("path"), "sha256")
        out = out.unionByName(trace.file_leaves(part, found))
    return out


def freeze(spark: SparkSession, runs: str, manifest: str, report: str, weights: str, output: str, conf: float, metric: str = "mAP50_95") -> None:
    """The best run with its confidence, and digests of all that it rests on."""
    best = selection.best_model(selection.renamed_metrics(spark.read.json(runs)), metric).withColumn("conf", F.lit(float(conf)))
    writers.json_rows(best, f"{output}/selection")
    writers.parquet(_chain(spark, readers.one(spark.read.json(f"{output}/selection"), "selection").asDict(), manifest, report, weights), f"{output}/leaves")


def final_test(spark: SparkSession, chosen: str, manifest: str, report: str, weights: str, per_image: str, output: str, match_iou: float = 0.5) -> str:
    """Scores of held-out records at the frozen confidence, if no link of the chain was changed."""
    selected = readers.one(spark.read.json(f"{chosen}/selection"), "selection").asDict()
    trace.assert_untampered(spark.read.parquet(f"{chosen}/leaves"), _chain(spark, selected, manifest, report, weights))
    dets, truths, images = nested(readers.per_image(spark, per_image))
    hits, conf = matching.matched(dets, truths, match_iou), selected["conf"]
    writers.json_rows(matching.confidence_curve(hits, truths, [conf]), f"{output}/totals")
    writers.json_rows(matching.class_scores(hits, truths, conf), f"{output}/classes")
    writers.json_rows(matching.error_rows(hits, dets, truths, images, conf), f"{output}/per_image")
    writers.json_rows(matching.fp_taxonomy(hits, dets, truths, conf, match_iou), f"{output}/false_positives")
    return selected["name"]


def latency(spark: SparkSession, samples: str, output: str, stages: list[str]) -> None:
    writers.json_rows(selection.stage_stats(spark.read.json(samples), stages), output)


def summarize(spark: SparkSession, runs: str, output: str, same: list[str]) -> None:
    rows = selection.compare_runs(spark.read.json(runs), same, same)
    writers.csv(rows, output, rows.columns)


def verify(spark: SparkSession, manifest: str, reference: str) -> str:
    """The identity of a manifest that equals its reference row for row."""
    a, b = readers.csv(spark, manifest), readers.csv(spark, reference)
    quality.require_columns(a, *b.columns)
    quality.assert_none(curate.manifest_diff(a.select(*b.columns), b), "The manifest differs from its reference")
    return curate.table_identity(a).first()["identity"]


COMMANDS = {
    audit: [("--annotations", str), ("--output", str)],
    prepare: [("--annotations", str), ("--groups", str), ("--digests", str), ("--output", str), ("--seed", int, 42), ("--tile", int, None), ("--overlap", float, 0.0)],
    evaluate: [("--per-image", str), ("--output", str), ("--grid", float, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), ("--match-iou", float, 0.5)],
    analyze: [("--per-image", str), ("--images", str), ("--output", str), ("--conf", float), ("--match-iou", float, 0.5)],
    select: [("--runs", str), ("--manifest", str), ("--output", str), ("--conf", float), ("--metric", str, "mAP50_95")],
    gate: [("--chosen", str), ("--manifest", str)],
    freeze: [("--runs", str), ("--manifest", str), ("--report", str), ("--weights", str), ("--output", str), ("--conf", float), ("--metric", str, "mAP50_95")],
    final_test: [("--chosen", str), ("--manifest", str), ("--report", str), ("--weights", str), ("--per-image", str), ("--output", str), ("--match-iou", float, 0.5)],
    latency: [("--samples", str), ("--output", str), ("--stages", str, ["wall_ms"])],
    summarize: [("--runs", str), ("--output", str), ("--same", str, ["seed"])],
    verify: [("--manifest", str), ("--reference", str)],
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridlark", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for f, options in COMMANDS.items():
        p = commands.add_parser(f.__name__, help=(f.__doc__ or f.__name__).split("\n")[0])
        p.set_defaults(run=f)
        for name, kind, *default in options:
            many = {"nargs": "+"} if default and isinstance(default[0], list) else {}
            p.add_argument(name, type=kind, required=not default, default=default[0] if default else None, **many)
    given = vars(parser.parse_args(argv))
    out = given.pop("run")(session(), **given)
    if out is not None:
        print(out)


if __name__ == "__main__":
    main()
