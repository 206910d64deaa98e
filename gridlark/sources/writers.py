"""Writers; each refuses to replace what is there."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.quality import ConstraintError
from gridlark.sources.sinks import write_files


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A headed CSV in the given column order; nulls are empty."""
    df.select(*columns).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def parquet(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(path)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def json_document(value: object, path: str) -> None:
    """A small driver-side record, indented; NaN and infinities are refused."""
    target = Path(path)
    if target.exists():
        raise FileExistsError(path)
    try:
        text = json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False)
    except ValueError as e:
        raise ConstraintError(str(e)) from None
    target.write_text(text, encoding="utf-8")


def yaml_names(names: dict[int, str], splits: dict[str, str], path: str) -> None:
    """A dataset description: split folders and class names."""
    lines = [f"{k}: {v}" for k, v in splits.items()] + ["names:"] + [f"  {k}: {json.dumps(v)}" for k, v in sorted(names.items())]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


def label_line(class_id: Column, *values: Column) -> Column:
    """``class cx cy w h``; doubles in their shortest exact form."""
    return F.concat_ws(" ", class_id.cast("string"), *[v.cast("string") for v in values])


def label_text(labels: DataFrame, images: DataFrame) -> DataFrame:
    """``(stem, text)`` with one line per box, empty text for images without."""
    lines = labels.groupBy("stem").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))
    return images.select("stem").join(lines, "stem", "left").withColumn("text", F.coalesce("text", F.lit("")))


def label_files(labels: DataFrame, images: DataFrame, path: str) -> None:
    """One text file for each image, ``<stem>.txt``, empty ones included."""
    texts = label_text(labels, images)
    write_files(texts.select(F.concat("stem", F.lit(".txt")).alias("name"), F.when(F.col("text") != "", F.concat("text", F.lit("\n"))).otherwise("").alias("text")), path)


def detection_rows(predictions: DataFrame) -> DataFrame:
    """Nested detections as rows with x1 to y2."""
    d = predictions.select(*[c for c in predictions.columns if c != "detections"], F.inline("detections"))
    return d.select(*[c for c in d.columns if c != "xyxy"], *[F.get("xyxy", i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def class_counts(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """``counts_by_class``: a map with zero for absent classes."""
    def named(x: str):
        return lambda d: d["class_name"] == x

    n = [F.size(F.filter("detections", named(x))) for x in classes]
    return predictions.withColumn("counts_by_class", F.map_from_arrays(F.array(*map(F.lit, classes)), F.array(*n)))


def markdown(df: DataFrame, columns: list[str], digits: int = 4) -> str:
    """A small result as a Markdown table."""
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    rows = df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if c in doubles else F.col(c).cast("string").alias(c) for c in columns]).collect()
    line = lambda x: "| " + " | ".join("" if v is None else v for v in x) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, rows)]) + "\n"


def status(path: str, state: str, error: str | None = None) -> None:
    """A run's state: running, complete or failed."""
    Path(path).write_text(json.dumps({"status": state, **({"error": error} if error else {})}), encoding="utf-8")
