"""Greedy one-to-one matching of detections and truths, and what follows from it.

``dets`` has (image_id, di, class_id, confidence, x1, y1, x2, y2), ``truths`` has
(image_id, tj, class_id, x1, y1, x2, y2); ``di`` and ``tj`` number an image's rows.
Detections are visited by falling confidence, then rising ``di``; each takes the
free truth of its class with the greatest IoU, of equals the one with the larger
``tj``, if that reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions.boxes import finite, has_area, iou, overlap_bin, short_side, size_bin
from gridlark.functions.scores import precision_recall_f1, recall_or_null
from gridlark.operators.quality import ConstraintError
from gridlark.scratch import Scratch

CORNERS = ("x1", "y1", "x2", "y2")
PARTS = 1024
#: Truths of an image, or of a class in it, beyond which they are taken apart.
DENSE = 512
#: Rounds go on while one settles at least this share of the waiting detections.
SETTLING = 1 / 8


def _is_solid() -> Column:
    """Whether a box can overlap with anything."""
    corners = [F.col(c) for c in CORNERS]
    ok = has_area(*corners)
    for c in corners:
        ok = ok & finite(c)
    return ok


def _grids(truths: DataFrame, dense: int) -> DataFrame | None:
    """The grid of each image with many truths, none if there is no such image.

    A cell is twice as wide and high as the truths in the quadratic mean, or as a
    share of what they cover that gives no more cells than truths: so a truth touches
    about two cells on average, which is what is shuffled.
    """
    size = {"x": F.col("x2") - F.col("x1"), "y": F.col("y2") - F.col("y1")}
    parts = [x for k, v in size.items() for x in (F.sqrt(F.avg(v * v)).alias(f"mean_{k}"), F.min(f"{k}1").alias(f"low_{k}"), F.max(f"{k}2").alias(f"high_{k}"))]
    crowded = truths.groupBy("image_id").agg(F.count("*").alias("n"), *parts).where(F.col("n") > dense)
    edge = [F.greatest(2 * F.col(f"mean_{k}"), (F.col(f"high_{k}") - F.col(f"low_{k}")) / F.sqrt("n")).alias(f"edge_{k}") for k in size]
    if crowded.isEmpty():
        return None
    # written, so that a join knows its size and that of crowds is not computed for each side
    return Scratch(truths.sparkSession, "grids").table(crowded.select("image_id", *edge, *[f"{e}_{k}" for k in size for e in ("low", "high")]), "grids")


def _cell(at: Column, axis: str) -> Column:
    """The grid cell of a place; truths' first and last cells take what lies beyond them."""
    inside = F.least(F.greatest(at, f"low_{axis}"), f"high_{axis}")
    return F.coalesce(F.floor((inside - F.col(f"low_{axis}")) / F.col(f"edge_{axis}")), F.lit(0).cast("long"))


def _in_cells(boxes: DataFrame, grids: DataFrame) -> DataFrame:
    """A row for each grid cell that a box touches, and whether the box begins in it along
    each axis; an image without a grid is one cell."""
    out = boxes.join(grids, "image_id", "left")
    for axis in ("x", "y"):
        low, high = (_cell(F.col(f"{axis}{k}"), axis) for k in (1, 2))
        out = out.withColumn(f"cell_{axis}", F.explode(F.sequence(low, high))).withColumn(f"first_{axis}", F.col(f"cell_{axis}") == low)
    return out.select(*boxes.columns, *[f"{c}_{axis}" for c in ("cell", "first") for axis in ("x", "y")])  # the grid itself is not shuffled


def iou_pairs(dets: DataFrame, truths: DataFrame, same_class: bool = True, dense: int = DENSE) -> DataFrame:
    """Detections with the truths of their image, and of their class if asked, that
    they overlap with.

    Boxes without an area or with a corner that is not finite overlap with none.
    Images with more than ``dense`` truths are cut into grid cells; a pair is found
    in the cell of its intersection's first corner only, and what does not overlap
    is no row of the join.
    """
    truths = truths.where(_is_solid())
    return _pairs(dets.where(_is_solid()), truths, same_class, _grids(truths, dense))


def _pairs(dets: DataFrame, truths: DataFrame, same_class: bool, grids: DataFrame | None, least: float = 0.0, how: str = "inner") -> DataFrame:
    """``iou_pairs`` on given grids, of boxes that are solid, with an IoU of ``least`` or
    more; ``how`` may keep detections without a pair where there are no grids."""
    d = dets.select("image_id", "di", "class_id", "confidence", *CORNERS)
    t = truths.select("image_id", "tj", "class_id", *CORNERS)
    keys = ["image_id", *(["class_id"] if same_class else [])]
    if grids is not None:
        d, t, keys = _in_cells(d, grids), _in_cells(t, grids), [*keys, "cell_x", "cell_y"]
    firsts = [] if grids is None else ["first_x", "first_y"]
    t = t.select(*[F.col(c).alias(f"t_{c}") for c in dict.fromkeys([*keys, "tj", *CORNERS, *firsts])])
    on = [F.col(k) == F.col(f"t_{k}") for k in keys]
    for axis in ("x", "y"):
        on += [F.col(f"{axis}1") < F.col(f"t_{axis}2"), F.col(f"t_{axis}1") < F.col(f"{axis}2")]
        if grids is not None:
            on.append(F.col(f"first_{axis}") | F.col(f"t_first_{axis}"))  # where the later one begins, the intersection does
    overlap = iou(tuple(F.col(c) for c in CORNERS), tuple(F.col(f"t_{c}") for c in CORNERS))
    if how != "inner":
        on.append(_is_solid())
    if least:
        on.append(overlap >= least)
    return d.join(t, on, how).select("image_id", "class_id", "di", F.col("t_tj").alias("tj"), "confidence", overlap.alias("iou"))


GROUP = ["image_id", "class_id"]


def _turn() -> Column:
    """What detections are ordered by."""
    return F.struct((-F.col("confidence")).alias("order"), "di")


def _in_turn(thresholds: list[float]):
    """Each detection with what it takes at each threshold, over sorted pairs.

    A detection without a candidate, or with one that no other has, is settled with the
    rest of its batch; only those that share a truth are gone through one at a time.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, used = None, None, []
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            cut = int(_begins(batch, [*GROUP, "di"])[-1])  # the last detection may go on in the next batch
            held = batch.slice(cut)
            if cut:
                done, group, used = _taken(batch.slice(0, cut), thresholds, group, used)
                yield done
        if held is not None:
            yield _taken(held, thresholds, group, used)[0]

    return emit


def _begins(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows that differ from the one before in a key, and the first."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _taken(batch: pa.RecordBatch, thresholds: list[float], group: tuple | None, used: list[set]) -> tuple[pa.RecordBatch, tuple, list[set]]:
    """The detections of these pairs; ``group`` is that of the pairs before, ``used`` its truths taken so far."""
    n, tj = batch.num_rows, batch.column("tj")
    begins, groups = _begins(batch, [*GROUP, "di"]), _begins(batch, GROUP)
    of = np.zeros(n, np.int64)
    of[groups[1:]] = 1
    of = np.cumsum(of)
    has, overlap = tj.is_valid().to_numpy(zero_copy_only=False), batch.column("iou").to_numpy(zero_copy_only=False)
    codes = tj.dictionary_encode(null_encoding="encode")
    _, which, times = np.unique(of * (len(codes.dictionary) + 1) + codes.indices.to_numpy(), return_inverse=True, return_counts=True)
    alone = (times[which] == 1) & (of > 0) & (of < of[-1])  # the first group and the last may go on outside
    ends = np.append(begins[1:], n)
    simple = (ends - begins == 1) & (~has[begins] | alone[begins])
    rows = np.full((len(begins), len(thresholds)), -1, np.int64)
    one = begins[simple]
    rows[simple] = np.where(has[one, None] & (overlap[one, None] >= np.array(thresholds)), one[:, None], -1)
    first, last = (tuple(batch.column(c)[k].as_py() for c in GROUP) for k in (0, n - 1))
    now, fresh = 0, lambda: [set() for _ in thresholds]
    if first != group:
        used = fresh()
    values, overlaps = tj.to_pylist(), overlap.tolist()
    for d in np.flatnonzero(~simple).tolist():
        if of[begins[d]] != now:
            now, used = of[begins[d]], fresh()
        for row in range(begins[d], ends[d]):
            t = values[row]
            for k, limit in enumerate(thresholds):
                if t is not None and rows[d, k] < 0 and overlaps[row] >= limit and t not in used[k]:
                    rows[d, k] = row
                    used[k].add(t)
    if now != of[-1]:
        used = fresh()
    flat = rows.ravel()
    tjs = pa.ListArray.from_arrays(pa.array(np.arange(len(begins) + 1) * len(thresholds), pa.int32()), tj.take(pa.array(flat, mask=flat < 0)))
    at = pa.array(begins)
    return pa.record_batch([*[batch.column(c).take(at) for c in (*GROUP, "di", "confidence")], tjs], [*GROUP, "di", "confidence", "tjs"]), last, used


def _streamed(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """``(image_id, class_id, di, confidence, tjs)``: the truth taken at each threshold,
    of every detection in ``pairs``; a task keeps the taken truths of one group."""
    schema = T.StructType([*[pairs.schema[c] for c in (*GROUP, "di", "confidence")], T.StructField("tjs", T.ArrayType(pairs.schema["tj"].dataType))])
    order = [*GROUP, F.asc_nulls_first(-F.col("confidence")), "di", F.desc("iou"), F.desc("tj")]
    return pairs.repartition(*GROUP).sortWithinPartitions(*order).mapInArrow(_in_turn(thresholds), schema)


def _settled(pairs: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """``(image_id, class_id, di, tj)`` of groups of any size, in rounds.

    A detection takes its best free truth once it is the first in turn of all
    waiting ones that have this truth as a candidate: none before it can take it.
    Detections stacked on the same truths settle one by one; once rounds settle
    little, those that are left are few and go in turn, group by group.
    """
    waiting, turn, out = scratch.table(pairs.select(*GROUP, "di", "confidence", "tj", "iou"), "waiting-0"), 0, []
    while True:
        best = waiting.groupBy(*GROUP, "di").agg(F.max_by("tj", F.struct("iou", "tj")).alias("tj"))
        first = waiting.groupBy(*GROUP, "tj").agg(F.min_by("di", _turn()).alias("di"))
        settled = scratch.table(best.join(first, [*GROUP, "di", "tj"]), f"settled-{turn}")
        out.append(settled)
        left = waiting.join(settled, [*GROUP, "di"], "left_anti").join(settled, [*GROUP, "tj"], "left_anti")
        turn += 1
        left = scratch.table(left.select(*waiting.columns), f"waiting-{turn}")
        scratch.drop(f"waiting-{turn - 1}")
        waiting = left
        some, rest = settled.count(), waiting.select(*GROUP, "di").distinct().count()
        if not rest:
            break
        if some < SETTLING * (some + rest):
            out.append(_streamed(waiting, [threshold]).select(*GROUP, "di", F.get("tjs", 0).alias("tj")).where("tj is not null"))
            break
    taken = out[0]
    for more in out[1:]:
        taken = taken.unionByName(more)
    return taken


def _dense_groups(truths: DataFrame, grids: DataFrame, dense: int) -> DataFrame:
    return truths.join(grids, "image_id", "left_semi").groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") > dense).select(*GROUP)


def _above_zero(threshold: float) -> float:
    if not 0 < threshold <= 1:
        raise ConstraintError("An IoU threshold is above 0 and at most 1")
    return float(threshold)


def matched(dets: DataFrame, truths: DataFrame, threshold: float = 0.5, dense: int = DENSE) -> DataFrame:
    """Each detection with the truth it takes: ``(image_id, class_id, di,
    confidence, tj)``, ``tj`` null for a false positive.

    Only candidates that reach the threshold matter: a detection takes its best
    free one, and one below the threshold is never taken.  The sorted pairs of an
    (image, class) are gone through once; one with more than ``dense`` truths is
    settled in rounds before.
    """
    threshold, truths = _above_zero(threshold), truths.where(_is_solid())
    grids = _grids(truths, dense)
    if grids is None:
        return _streamed(_pairs(dets, truths, True, None, threshold, "left"), [threshold]).select(*GROUP, "di", "confidence", F.get("tjs", 0).alias("tj"))
    scratch, large = Scratch(dets.sparkSession, "settled"), _dense_groups(truths, grids, dense)
    pairs = scratch.table(_pairs(dets.where(_is_solid()), truths, True, grids, threshold), "pairs")  # found once, read for both kinds of groups
    settled = _settled(pairs.join(large, GROUP, "left_semi"), threshold, scratch)
    rest = _streamed(pairs.join(large, GROUP, "left_anti"), [threshold]).select(*GROUP, "di", F.get("tjs", 0).alias("tj"))
    return dets.select(*GROUP, "di", "confidence").join(rest.unionByName(settled), [*GROUP, "di"], "left")


def matched_at(dets: DataFrame, truths: DataFrame, thresholds: list[float]) -> DataFrame:
    """``matched`` at several thresholds, as rows with ``threshold``, from one pass over the pairs."""
    limits = sorted({_above_zero(t) for t in thresholds})
    if not limits:
        raise ConstraintError("No IoU threshold")
    truths = truths.where(_is_solid())
    grids = _grids(truths, DENSE)
    if grids is None:
        taken = _streamed(_pairs(dets, truths, True, None, limits[0], "left"), limits)
    else:
        found = _streamed(_pairs(dets.where(_is_solid()), truths, True, grids, limits[0]), limits).drop("confidence")
        taken = dets.select(*GROUP, "di", "confidence").join(found, [*GROUP, "di"], "left")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.get("tjs", k).alias("tj")) for k, t in enumerate(limits)])).alias("at")
    return taken.select(*GROUP, "di", "confidence", each).select(*GROUP, "di", "confidence", "at.threshold", "at.tj")


def per_image_counts(hits: DataFrame, truths: DataFrame, images: DataFrame, conf: float = 0.0) -> DataFrame:
    """``tp``, ``fp`` and ``fn`` of every image, empty ones included."""
    found = hits.where(F.col("confidence") >= conf).groupBy("image_id").agg(F.count("tj").alias("tp"), F.count_if(F.col("tj").isNull()).alias("fp"))
    have = truths.groupBy("image_id").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    out = images.select("image_id").distinct().join(have, "image_id", "left").join(found, "image_id", "left")
    tp = F.coalesce("tp", zero)
    return out.select("image_id", tp.alias("tp"), F.coalesce("fp", zero).alias("fp"), (F.coalesce("n", zero) - tp).alias("fn"))


def class_scores(hits: DataFrame, truths: DataFrame, conf: float = 0.0) -> DataFrame:
    """Counts and metrics of each class that has a truth or a detection."""
    found = hits.where(F.col("confidence") >= conf).groupBy("class_id").agg(F.count("tj").alias("tp"), F.count_if(F.col("tj").isNull()).alias("fp"))
    have = truths.groupBy("class_id").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    c = have.join(found, "class_id", "full").select("class_id", F.coalesce("tp", zero).alias("tp"), F.coalesce("fp", zero).alias("fp"), F.coalesce("n", zero).alias("n"))
    return with_metrics(c.withColumn("fn", F.col("n") - F.col("tp")).drop("n"))


def with_metrics(counts: DataFrame) -> DataFrame:
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def confidence_curve(hits: DataFrame, truths: DataFrame, grid: list[float]) -> DataFrame:
    """Totals and metrics at each confidence of the grid from one matching pass.

    Dropping detections of low confidence changes no earlier turn, so the curve is
    a conditional sum for each value of the grid.
    """
    from .quality import confidence_grid

    grid = confidence_grid(grid)
    at = [F.col("confidence") >= c for c in grid]
    rows = F.array(
        *[F.struct(F.lit(c).alias("conf"), F.count_if(a & F.col("tj").isNotNull()).alias("tp"), F.count_if(a & F.col("tj").isNull()).alias("fp")) for c, a in zip(grid, at, strict=True)]
    )
    n = truths.agg(F.count("*").alias("n"))
    c = hits.where(F.col("confidence") >= grid[0]).agg(rows.alias("r")).select(F.inline("r")).crossJoin(n)  # one row by one row for each value
    return with_metrics(c.select("conf", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn")))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row with the greatest (f1, precision, conf)."""
    names = ["f1", "precision", "conf", "tp", "fp", "fn", "recall"]
    return curve.agg(F.max(F.struct(*names)).alias("b")).select("b.*")


def average_precision(hits: DataFrame, truths: DataFrame) -> DataFrame:
    """``(class_id, truths, ap)`` of each class that has a truth: the mean, over the
    recalls 0, 0.01 .. 1, of the best precision at that recall or above.

    Detections of one confidence enter together; null confidences are left out.
    Running counts go by slices of the confidence, with the sums of the slices
    above added, so no task holds all detections of a class.
    """
    have = truths.groupBy("class_id").agg(F.count("*").alias("truths"))
    ap = _areas(hits, have, ["class_id"])
    return have.join(ap, "class_id", "left").select("class_id", "truths", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def _areas(hits: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, ap)``, ``class_id`` among the keys."""
    rows = hits.where("confidence is not null").groupBy(*keys, "confidence").agg(F.count("tj").alias("tp"), F.count("*").alias("dets"))
    rows = rows.withColumn("part", F.floor(F.col("confidence") * PARTS))
    above = W.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = rows.groupBy(*keys, "part").agg(F.sum("tp").alias("part_tp"), F.sum("dets").alias("part_dets"))
    sums = sums.select(*keys, "part", *[F.coalesce(F.sum(f"part_{c}").over(above), zero).alias(f"above_{c}") for c in ("tp", "dets")])
    within = W.partitionBy(*keys, "part").orderBy(F.desc("confidence")).rowsBetween(W.unboundedPreceding, W.currentRow)
    tp, dets = (F.col(f"above_{c}") + F.sum(c).over(within) for c in ("tp", "dets"))
    curve = rows.join(sums, [*keys, "part"]).select(*keys, tp.alias("tp"), dets.alias("dets"))
    best = curve.join(have, "class_id").groupBy(*keys, F.expr("100 * tp div truths").alias("point")).agg(F.max(F.col("tp") / F.col("dets")).alias("precision"))
    upward = W.partitionBy(*keys).orderBy("point")  # at most 101 rows of a key
    steps = best.select(
        *keys,
        (F.col("point") - F.coalesce(F.lag("point").over(upward), F.lit(-1).cast("long"))).alias("points"),
        F.max("precision").over(upward.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("precision"),
    )
    return steps.groupBy(*keys).agg((F.sum(F.col("points") * F.col("precision")) / 101).alias("ap"))


def mean_average_precision(dets: DataFrame, truths: DataFrame, thresholds: list[float]) -> DataFrame:
    """``(threshold, classes, map)``: the mean over classes at each IoU threshold, all from one matching pass."""
    limits = sorted({float(t) for t in thresholds})
    have = truths.groupBy("class_id").agg(F.count("*").alias("truths"))
    keys = ["threshold", "class_id"]
    ap = _areas(matched_at(dets, truths, limits), have, keys)
    every = have.select("class_id", F.explode(F.array(*[F.lit(t) for t in limits])).alias("threshold"))
    return every.join(ap, keys, "left").groupBy("threshold").agg(F.count("*").alias("classes"), F.avg(F.coalesce("ap", F.lit(0.0))).alias("map"))


def recall_by_size(hits: DataFrame, truths: DataFrame, images: DataFrame, conf: float, imgsz: int = 640) -> DataFrame:
    """Truths and found ones by their shorter side after resizing; all bins."""
    taken = hits.where((F.col("confidence") >= conf) & F.col("tj").isNotNull()).select("image_id", "tj", F.lit(1).alias("found"))
    side = short_side(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("width"), F.col("height"), imgsz)
    t = truths.join(images.select("image_id", "width", "height"), "image_id").join(taken, ["image_id", "tj"], "left")
    n = t.groupBy(size_bin(side).alias("size_bin")).agg(F.count("*").alias("objects"), F.count("found").alias("found"))
    names = hits.sparkSession.createDataFrame([(x,) for x in ("short_side_lt_8px", "short_side_8_to_16px", "short_side_ge_16px")], "size_bin string")
    zero = F.lit(0).cast("long")
    out = names.join(n, "size_bin", "left").select("size_bin", F.coalesce("objects", zero).alias("objects"), F.coalesce("found", zero).alias("found"))
    return out.withColumn("recall", recall_or_null(F.col("found"), F.col("objects")))


def fp_taxonomy(hits: DataFrame, dets: DataFrame, truths: DataFrame, conf: float, match_iou: float = 0.5) -> DataFrame:
    """False positives by their best overlap with any truth of the image; all bins."""
    wrong = hits.where((F.col("confidence") >= conf) & F.col("tj").isNull()).select("image_id", "di")
    boxes = dets.select("image_id", "di", "class_id", "confidence", *CORNERS).join(wrong, ["image_id", "di"])
    boxes = Scratch(hits.sparkSession, "wrong").table(boxes, "wrong")  # computed once, read for its pairs and for those without
    best = iou_pairs(boxes, truths, same_class=False).groupBy("image_id", "di").agg(F.max("iou").alias("iou"))
    n = boxes.join(best, ["image_id", "di"], "left").groupBy(overlap_bin(F.coalesce("iou", F.lit(0.0)), match_iou).alias("overlap")).agg(F.count("*").alias("n"))
    names = hits.sparkSession.createDataFrame([(x,) for x in ("overlap_lt_0.1", "overlap_0.1_to_match_iou", "duplicate_or_assignment_conflict")], "overlap string")
    return names.join(n, "overlap", "left").select("overlap", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def error_rows(hits: DataFrame, dets: DataFrame, truths: DataFrame, images: DataFrame, conf: float) -> DataFrame:
    """Counts with the kept detections and the truths nested, a row per image."""
    xyxy = F.array(*CORNERS).alias("xyxy")
    d = dets.where(F.col("confidence") >= conf).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("di", "class_id", "confidence", xyxy))).alias("detections"))
    t = truths.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("tj", "class_id", xyxy))).alias("truth"))
    return per_image_counts(hits, truths, images, conf).join(d, "image_id", "left").join(t, "image_id", "left")
