"""File names, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQUENCE = r"^(batch_[a-z]?\d+)_(?:img|frame)_?\d+$"
#: Stem prefix -> name of the unverified family.
FAMILIES = {"gopr": "gopro", "dji": "dji", "photo_": "photo", "camera": "camera"}
#: Extensions that a written image may keep.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
#: Image states in the order in which the first that holds counts.
STATES = ("missing_or_corrupt", "dimension_mismatch", "oriented_tiff", "exif_orientation", "multi_frame")


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def sequence_group(path: Column) -> Column:
    """The batch that a file name states, else its camera family, unverified."""
    s = stem(path)
    batch = F.regexp_extract(s, SEQUENCE, 1)
    out = F.when(batch != "", batch)
    for prefix, family in FAMILIES.items():
        out = out.when(s.startswith(prefix), f"unverified_{family}")
    return out.otherwise("unverified_other")


def first_folder(path: Column) -> Column:
    return F.get(F.split(path, "/"), 0)


def output_name(image_id: Column, extension: Column, tile: Column | None = None) -> Column:
    ext = F.when(F.lower(extension).isin(*IMAGE_EXTENSIONS), F.lower(extension)).otherwise("png")
    if tile is None:
        return F.concat(F.format_string("image_%08d.", image_id), ext)
    return F.concat(F.format_string("image_%08d_tile_%05d.", image_id, tile), ext)


def is_safe_path(path: Column) -> Column:
    """Relative, on no drive and without parent steps; either slash."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce((F.trim(p) != "") & ~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"), F.lit(False))


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9_-]{1,80}$"), F.lit(False))


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def first_url(*urls: Column) -> Column:
    """The first url given, over https."""
    return https(F.coalesce(*[F.nullif(u, F.lit("")) for u in urls]))


def image_status(missing: Column, mismatch: Column, oriented_tiff: Column, exif: Column, frames: Column) -> Column:
    """The first state that holds, else ok."""
    flags = (missing, mismatch, oriented_tiff, exif, frames > 1)
    out = F.when(flags[0], STATES[0])
    for flag, state in zip(flags[1:], STATES[1:], strict=True):
        out = out.when(flag, state)
    return out.otherwise("ok")


def jpeg_end_missing(content: Column) -> Column:
    return F.hex(F.substring(content, -2, 2)) != "FFD9"
