"""What a result was made from: digests by leaf, and results kept by them.

A leaf is a part of an input that can be named when it changes: a file, a
selection, a report, or the rows of a table with one key.  Digests do not
depend on the order of rows and are combined in partial aggregates.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.quality import ConstraintError
from gridlark.scratch import shared_dir



def _halves(text: Column) -> list[Column]:
    h = F.sha2(text, 256)
    return [F.sum(F.conv(F.substring(h, k, 15), 16, 10).cast("decimal(38,0)")) for k in (1, 16, 31, 46)]


def _digest(df: DataFrame, by: list[str], text: Column) -> DataFrame:
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), *[h.alias(f"_{i}") for i, h in enumerate(_halves(text))])
    return sums.select(*by, "n", F.sha2(F.concat_ws(":", "n", *[F.col(f"_{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def leaves(part: str, rows: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """``(part, leaf, n, digest)``: one leaf for each value of ``key``; a null key is a leaf."""
    shown = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in sorted(columns or rows.columns)]
    text = F.to_json(F.array(*shown))
    named = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("(null)")).alias("leaf"), text.alias("_text"))
    return _digest(named, ["leaf"], F.col("_text")).select(F.lit(part).alias("part"), "leaf", "n", "digest")


def record_leaf(spark: SparkSession, part: str, record: dict) -> DataFrame:
    """One leaf for each key of a small record, as a report or a selection is."""
    rows = [(part, str(k), 1, json.dumps(v, sort_keys=True, ensure_ascii=False, allow_nan=False)) for k, v in record.items()]
    df = spark.createDataFrame(rows, "part string, leaf string, n long, v string")
    return df.select("part", "leaf", "n", F.sha2("v", 256).alias("digest"))


def file_leaves(part: str, digests: DataFrame) -> DataFrame:
    """Leaves of ``(path, sha256)`` rows, as ``readers.file_digests`` gives them."""
    return digests.select(F.lit(part).alias("part"), F.col("path").alias("leaf"), F.lit(1).cast("long").alias("n"), F.col("sha256").alias("digest"))


def root(tree: DataFrame) -> str:
    """The digest of all leaves, whatever their order."""
    row = _digest(tree.withColumn("_all", F.lit(1)), ["_all"], F.to_json(F.array("part", "leaf", F.col("n").cast("string"), "digest"))).first()
    return row["digest"] if row else "0" * 64





def tampered(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """``(part, leaf, change)`` of every leaf that is not as it was."""
    was, is_ = (x.select("part", "leaf", F.struct("n", "digest").alias(n)) for x, n in ((frozen, "was"), (now, "now")))
    both = was.join(is_, ["part", "leaf"], "full")
    change = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return both.select("part", "leaf", change.alias("change")).where("change is not null")


def assert_untampered(frozen: DataFrame, now: DataFrame) -> None:
    """Refuse inputs that differ from the frozen ones, naming the first leaves."""
    some = tampered(frozen, now).orderBy("part", "leaf").limit(3).collect()
    if some:
        raise ConstraintError("Changed since it was frozen: " + ", ".join(f"{r.part}/{r.leaf} ({r.change})" for r in some))


def remembered(spark: SparkSession, signature: str, compute: Callable[[], DataFrame], store: str | None = None) -> tuple[DataFrame, bool]:
    """The result that a store keeps for a signature, computed and kept if there is none.

    Also says whether it was computed.  A run that was lost half way leaves no
    success mark, so its result is computed again.
    """
    path = f"{(store or shared_dir(spark) + '/results').rstrip('/')}/{signature}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return spark.read.parquet(path), False
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), True


def members_against_records(members: DataFrame, records: DataFrame, name: str = "file_name") -> DataFrame:
    """``(name, issue)`` of archive members and records that do not fit one to one.

    A member counts by its last path part; members of one name are an issue, and
    so is a record without a member.
    """
    base = members.select(F.regexp_extract(name, r"([^/\\]*)$", 1).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    wanted = records.select(F.col(name).alias("name")).distinct()
    lacking = wanted.join(base, "name", "left_anti").select("name", F.lit("not in the archive").alias("issue"))
    return base.where("n > 1").select("name", F.lit("repeated in the archive").alias("issue")).unionByName(lacking)
