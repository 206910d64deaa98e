"""Readers of annotation documents, label files, manifests and records."""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark import schemas
from gridlark.operators.quality import ConstraintError, assert_none, require_columns
from gridlark.scratch import Scratch
from gridlark.sources import folders
from gridlark.sources.coco import documents as coco_documents


def coco(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame]:
    """``images``, ``annotations`` and ``categories`` of COCO documents of any size.

    The strict form fails where one of the lists is absent.
    """
    return coco_documents(spark, path, {"images": schemas.IMAGE, "annotations": schemas.ANNOTATION, "categories": schemas.CATEGORY}, strict)


def groups(spark: SparkSession, path: str) -> DataFrame:
    """A group map; ids become numbers, blanks and repeats are refused."""
    raw = csv(spark, path)
    require_columns(raw, "image_id", "group_id")
    out = raw.withColumn("image_id", F.col("image_id").try_cast("long")).withColumn("group_id", F.trim("group_id"))
    assert_none(out.where("image_id is null or image_id < 0 or group_id is null or group_id = ''"), "Invalid group row")
    assert_none(out.groupBy("image_id").count().where("count > 1"), "Repeated image in the group map")
    return out


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns only."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def canonical(df: DataFrame) -> DataFrame:
    """Rows ordered by their JSON with sorted keys."""
    return df.orderBy(F.to_json(F.struct(*sorted(df.columns))))


def documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one row per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("_path", F.input_file_name())


def per_image(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PER_IMAGE).option("multiLine", True).json(path)


def epoch_history(spark: SparkSession, path: str) -> DataFrame:
    """An epoch table with numeric columns and stripped names."""
    raw = spark.read.option("header", True).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def _label_lines(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``(name, value)``: the lines of a folder's files, or of one file."""
    if not folders.readable(path):
        return spark.read.option("pathGlobFilter", f"*{suffix}").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("name"), "value")
    found = folders.contents(folders.names(spark, path, suffix), path, unpack=True)
    raw = F.col("content").cast("string")
    text = F.when(F.startswith(raw, F.lit("\ufeff")), F.substring(raw, 2, 2**31 - 1)).otherwise(raw)
    text = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    return found.select("name", F.explode(F.split(text, "\n")).alias("value"))  # one character is split at without a pattern


def labels(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``(path, class_id, cx, cy, w, h)`` of label files, ``path`` being their name;
    other than five tokens in a line is refused.  Files are read once."""
    names = ("class_id", "cx", "cy", "w", "h")
    lines = _label_lines(spark, path, suffix).select(F.col("name").alias("path"), F.split(F.trim("value"), r"\s+").alias("t")).where(F.get("t", 0) != "")
    parsed = lines.select("path", *[F.expr(f"try_cast(get(t, {i}) as double)").alias(n) for i, n in enumerate(names)], F.when(F.size("t") != 5, F.col("t")).alias("t"))
    held = Scratch(spark, "labels").table(parsed, "rows")
    assert_none(held.where("t is not null").select("path", "t"), "A label line needs five tokens")
    return held.drop("t")


def expected_labels(spark: SparkSession, path: str, stems: DataFrame) -> DataFrame:
    """``labels`` of a folder that has one file ``<stem>.txt`` for each of ``stems``.

    Files and names are compared before a line is read: a missing or an unlisted
    file is an error that names it, never an image without objects.
    """
    if folders.readable(path):
        listed = folders.names(spark, path, ".txt").select(F.regexp_extract("name", r"(?s)^(.*)\.txt$", 1).alias("stem"))
    else:
        # a scan skips empty files; the index that Spark has made of the folder does not
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).inputFiles()
        listed = spark.createDataFrame([(unquote(f.rsplit("/", 1)[-1].removesuffix(".txt")),) for f in found], "stem string")
    assert_none(listing_mismatch(stems.select("stem"), listed, "stem"), "Label files and manifest differ")
    rows = labels(spark, path, ".txt")
    return rows.select(F.regexp_extract("path", r"(?s)^(.*)\.txt$", 1).alias("stem"), *[c for c in rows.columns if c != "path"])


def label_tally(spark: SparkSession, path: str) -> DataFrame:
    """Objects by class over a folder of label files."""
    first = F.get(F.split(F.trim("value"), r"\s+", 2), 0)  # what follows the first is not split
    return _label_lines(spark, path).select(first.alias("class_id")).where("class_id <> ''").groupBy("class_id").agg(F.count("*").alias("objects"))


def files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Files below a folder, with their bytes if asked."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found if content else found.select("path", "length")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256, MD5 and CRC-32 of each file below a folder."""
    if folders.is_folder(path):
        root = path if ":" in path else f"file:{os.path.abspath(path)}"
        found = folders.contents(folders.names(spark, path, recursive=True), path).withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "name"))
    else:
        found = files(spark, path, content=True)
    return found.select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.crc32("content").alias("crc32"))


def listing_mismatch(manifest: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Names that only one side has."""
    m, f = manifest.select(key).distinct().withColumn("_m", F.lit(1)), listed.select(key).distinct().withColumn("_f", F.lit(1))
    side = F.when(F.col("_f").isNull(), "missing_file").otherwise("unlisted_file")
    return m.join(f, key, "full").where("_m is null or _f is null").select(key, side.alias("side"))


def one(df: DataFrame, what: str):
    """The only row."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ConstraintError(f"Expected one {what}, found {'several' if rows else 'none'}")
    return rows[0]
