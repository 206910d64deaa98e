"""Box geometry as column expressions.

A box is four double columns; ``corners`` are x1, y1, x2, y2.  All functions are
null for null input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def valid_bbox(bbox: Column) -> Column:
    """Four finite numbers with a positive width and height."""
    four = bbox.isNotNull() & (F.size(bbox) == 4)
    parts = [F.get(bbox, i) for i in range(4)]
    ok = finite(parts[0]) & finite(parts[1]) & finite(parts[2]) & finite(parts[3]) & (parts[2] > 0) & (parts[3] > 0)
    return F.coalesce(four & ok & finite(parts[0] + parts[2]) & finite(parts[1] + parts[3]), F.lit(False))


def clip(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Corners of an x, y, w, h box inside the image."""
    zero = F.lit(0.0)
    return F.greatest(zero, x), F.greatest(zero, y), F.least(width.cast("double"), x + w), F.least(height.cast("double"), y + h)


def has_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 > x1) & (y2 > y1)


def was_clipped(corners: tuple, x: Column, y: Column, w: Column, h: Column) -> Column:
    x1, y1, x2, y2 = corners
    return (x1 != x) | (y1 != y) | (x2 != x + w) | (y2 != y + h)


def normalised(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Centre and size as shares of the image."""
    return (x1 + x2) / (2 * width), (y1 + y2) / (2 * height), (x2 - x1) / width, (y2 - y1) / height


def denormalised(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Corners in pixels, clamped to the image."""
    zero, wide, high = F.lit(0.0), width.cast("double"), height.cast("double")
    x1, y1, x2, y2 = (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height
    return F.greatest(zero, x1), F.greatest(zero, y1), F.least(wide, x2), F.least(high, y2)


def label_in_range(class_id: Column, cx: Column, cy: Column, w: Column, h: Column, classes: int, tolerance: float = 1e-6) -> Column:
    """A label that denotes a box of a known class inside the image."""
    inside = [(a - b / 2 >= -tolerance) & (a + b / 2 <= 1 + tolerance) for a, b in ((cx, w), (cy, h))]
    whole = (class_id == F.floor(class_id)) & (class_id >= 0) & (class_id < classes)
    return F.coalesce(finite(cx) & finite(cy) & finite(w) & finite(h) & whole & (w > 0) & (h > 0) & inside[0] & inside[1], F.lit(False))


def relative_area(w: Column, h: Column, width: Column, height: Column) -> Column:
    return w * h / (width * height)


def short_side(w: Column, h: Column, width: Column, height: Column, size: int = 640) -> Column:
    """The box's shorter side once the image's longer side is ``size``."""
    return F.least(w, h) * size / F.greatest(width, height)


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two tuples of corners; 0 for an empty union."""
    zero = F.lit(0.0)
    inner = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
    return F.when(union > 0, inner / union).otherwise(zero)


def scaled_polygon(polygon: Column, sx: Column, sy: Column) -> Column:
    """Even places by sx, odd ones by sy."""
    return F.transform(polygon, lambda v, i: v * F.when(i % 2 == 0, sx).otherwise(sy))


# The names and limits of the bins.
def size_bin(side: Column) -> Column:
    return F.when(side < 8, "short_side_lt_8px").when(side < 16, "short_side_8_to_16px").otherwise("short_side_ge_16px")


def overlap_bin(overlap: Column, match_iou: float) -> Column:
    return F.when(overlap < 0.1, "overlap_lt_0.1").when(overlap < match_iou, "overlap_0.1_to_match_iou").otherwise("duplicate_or_assignment_conflict")


def aspect_differs(w: Column, h: Column, expected_w: Column, expected_h: Column) -> Column:
    """The aspect ratio is off by more than two pixels of the longer side."""
    return F.abs(w * expected_h - h * expected_w) > 2 * F.greatest(expected_w, expected_h)
