"""Tiles of images and the boxes that fall into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _stride(tile: int, overlap: float) -> int:
    """Pixels between two starts, rounded half to even, at least one."""
    return max(1, round(tile * (1 - overlap)))


def starts(length: Column, tile: int, overlap: float) -> Column:
    """Tile starts along one axis; the last tile ends at the border."""
    stride = F.lit(_stride(tile, overlap))
    end = F.greatest(F.lit(0), length - F.lit(tile)).cast("int")
    return F.array_union(F.sequence(F.lit(0), end, stride), F.array(end))


def tile_grid(images: DataFrame, tile: int | None, overlap: float = 0.0) -> DataFrame:
    """``(image_id, tile, left, top, right, bottom)``, row by row from 0.

    The grid grows out of each image's own row; only the numbering shuffles.
    """
    if tile is None:
        one = F.lit(0)
        return images.select("image_id", one.alias("tile"), one.alias("left"), one.alias("top"), F.col("width").alias("right"), F.col("height").alias("bottom"))
    xs, ys = starts(F.col("width"), tile, overlap), starts(F.col("height"), tile, overlap)
    cells = images.select("image_id", "width", "height", F.size(xs).alias("nx"), xs.alias("xs"), F.posexplode(ys).alias("row", "top"))
    cells = cells.select("image_id", "width", "height", "nx", "row", "top", F.posexplode("xs").alias("col", "left"))
    right, bottom = F.least("width", F.col("left") + tile), F.least("height", F.col("top") + tile)
    return cells.select("image_id", (F.col("row") * F.col("nx") + F.col("col")).alias("tile"), "left", "top", right.alias("right"), bottom.alias("bottom"))


def boxes_in_tiles(tiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """Parts of boxes with an area inside a tile, in the tile's coordinates."""
    t, b = F.col("left").cast("double"), F.col("top").cast("double")
    right, bottom = F.col("right").cast("double"), F.col("bottom").cast("double")
    met = tiles.join(boxes, "image_id").where((F.col("x2") > t) & (F.col("x1") < right) & (F.col("y2") > b) & (F.col("y1") < bottom))
    rest = [c for c in boxes.columns if c not in ("image_id", "x1", "y1", "x2", "y2")]
    return met.select(
        "image_id", "tile", *rest,
        (F.greatest("x1", t) - t).alias("x1"), (F.greatest("y1", b) - b).alias("y1"), (F.least("x2", right) - t).alias("x2"), (F.least("y2", bottom) - b).alias("y2"),
    ).where("x2 > x1 and y2 > y1")


def boxes_on_grid(images: DataFrame, boxes: DataFrame, tile: int, overlap: float = 0.0) -> DataFrame:
    """``boxes_in_tiles`` for the tiles of ``tile_grid``, without a join of tiles.

    Which columns and rows of tiles a box meets follows from its corners, the
    stride and the image's size, so each row that is made is a part of a box.
    """
    b = boxes.join(images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id")
    stride = F.lit(_stride(tile, overlap))
    for low, high, size, at in (("x1", "x2", "_w", "_c"), ("y1", "y2", "_h", "_r")):
        end = F.greatest(F.lit(0), F.col(size) - tile)
        regular = F.floor(end / stride)  # the number of the last start by strides
        first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(low) - tile) / stride) + 1)
        last = F.least(regular, F.ceil(F.col(high) / stride) - 1)
        by_stride = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        at_border = (end % stride != 0) & (F.col(high) > end) & (F.col(low) < F.col(size))
        b = b.withColumn(at, F.explode(F.concat(by_stride, F.when(at_border, F.array(regular + 1)).otherwise(F.array().cast("array<bigint>")))))
        b = b.withColumn(f"{at}0", F.least(F.col(at) * stride, end).cast("int"))
    across = F.floor(F.greatest(F.lit(0), F.col("_w") - tile) / stride) + 1 + (F.greatest(F.lit(0), F.col("_w") - tile) % stride != 0).cast("int")
    right, bottom = F.least("_w", F.col("_c0") + tile).cast("double"), F.least("_h", F.col("_r0") + tile).cast("double")
    rest = [c for c in boxes.columns if c not in ("image_id", "x1", "y1", "x2", "y2")]
    left, top = F.col("_c0").cast("double"), F.col("_r0").cast("double")
    return b.select(
        "image_id", (F.col("_r") * across + F.col("_c")).cast("int").alias("tile"), *rest,
        (F.greatest("x1", left) - left).alias("x1"), (F.greatest("y1", top) - top).alias("y1"), (F.least("x2", right) - left).alias("x2"), (F.least("y2", bottom) - top).alias("y2"),
    ).where("x2 > x1 and y2 > y1")


def tile_counts(tiles: DataFrame, parts: DataFrame) -> DataFrame:
    """Objects of every tile, zero included."""
    n = parts.groupBy("image_id", "tile").agg(F.count("*").alias("objects"))
    return tiles.join(n, ["image_id", "tile"], "left").withColumn("objects", F.coalesce("objects", F.lit(0).cast("long")))


def numbered(tiles: DataFrame) -> DataFrame:
    """Tiles from elsewhere, numbered row by row."""
    return tiles.withColumn("tile", F.row_number().over(W.partitionBy("image_id").orderBy("top", "left")) - 1)
