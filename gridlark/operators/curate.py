"""Exact duplicates, linked groups, leakage-free splits and sampling."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.operators.order import running_sums, same_keys
from gridlark.scratch import Scratch

#: Rows of a mapping that each task may hold.
SMALL = 100_000


def exact_dedup(images: DataFrame) -> DataFrame:
    """Adds ``original``, the lowest id with the same content, and ``duplicate_of``."""
    first = images.groupBy("sha256").agg(F.min("image_id").alias("original"))
    out = images.join(first, "sha256")
    return out.withColumn("duplicate_of", F.when(F.col("original") != F.col("image_id"), F.col("original")))


def representatives(images: DataFrame) -> DataFrame:
    return exact_dedup(images).where("duplicate_of is null").drop("original", "duplicate_of")


def duplicate_conflicts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Contents whose copies carry different boxes, in whatever order."""
    own = boxes.groupBy("image_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("class_id", "x1", "y1", "x2", "y2")))).alias("b"))
    all_ = images.join(own, "image_id", "left").withColumn("b", F.coalesce("b", F.lit("[]")))
    return all_.groupBy("sha256").agg(F.count("*").alias("copies"), F.count_distinct("b").alias("versions")).where("versions > 1")


def group_components(images: DataFrame) -> DataFrame:
    """``(group_id, root)``: groups linked by shared contents, named by the
    smallest group.

    Groups and contents are the two sides of a graph; labels go from a content's
    smallest label to its groups, and on by the label's own label, until nothing
    changes.
    """
    scratch, turn = Scratch(images.sparkSession, "groups"), 0
    edges = scratch.table(images.select("group_id", "sha256").distinct(), "edges")
    labels = edges.select("group_id").distinct().withColumn("root", F.col("group_id"))
    while True:
        by_content = edges.join(labels, "group_id").groupBy("sha256").agg(F.min("root").alias("m"))
        near = edges.join(by_content, "sha256").groupBy("group_id").agg(F.min("m").alias("m"))
        hop = near.join(labels.select(F.col("group_id").alias("m"), F.col("root").alias("next")), "m", "left")
        new = scratch.table(labels.join(hop, "group_id").select("group_id", F.least("root", "m", "next").alias("root"), F.col("root").alias("old")), f"labels-{turn}")
        if turn:
            scratch.drop(f"labels-{turn - 1}")
        labels, turn = new.drop("old"), turn + 1
        if new.where("root <> old").isEmpty():
            return labels


def hash_order(seed: int, *keys: Column) -> Column:
    """A seeded order that every engine with SHA-256 reproduces."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def _cuts(sized: DataFrame) -> DataFrame:
    """Split from running sums over ``(group, n, place)``: the first cut is the
    place whose sum is nearest 70 %, the second, further on, nearest 90 %.

    The sums run over ranges of places, the cuts are combinable minima, so no
    task sees all groups.
    """
    c = running_sums(sized.select("group", "n", "place", F.lit(1).cast("long").alias("one")), [], ["place"], ["n", "one"], Scratch(sized.sparkSession, "cuts"))
    c = c.select("group", "n", F.col("before_one").alias("k"), F.col("before_n").alias("before"))
    away = lambda share: F.struct(F.abs(F.col("before") - F.col("total") * share).alias("d"), "k")
    one = lambda df: F.broadcast(df)  # noqa: E731  one row
    c = c.crossJoin(one(c.agg(F.sum("n").alias("total"), F.count("*").alias("groups"))))
    c = c.crossJoin(one(c.agg(F.min(F.when((F.col("k") >= 1) & (F.col("k") < F.col("groups") - 1), away(0.7)))["k"].alias("a"))))
    c = c.crossJoin(one(c.agg(F.min(F.when(F.col("k") > F.col("a"), away(0.9)))["k"].alias("b"))))
    few = F.raise_error(F.lit("Fewer than three independent groups: no train, val and test without leakage"))
    return c.withColumn("split", F.when(F.col("groups") < 3, few.cast("string")).when(F.col("k") < F.col("a"), "train").when(F.col("k") < F.col("b"), "val").otherwise("test"))


def split_groups(images: DataFrame, components: DataFrame, seed: int = 42) -> DataFrame:
    """``(root, n, split)`` in hash order, counting representatives only.

    Fewer than three groups are an error as soon as a split is read.
    """
    n = representatives(images).join(components, "group_id").groupBy("root").agg(F.count("*").alias("n"))
    sized = n.select(F.col("root").alias("group"), "n", hash_order(seed, F.col("root")).alias("place"))
    return _cuts(sized).select(F.col("group").alias("root"), "n", "split")


def split_groups_shuffled(spark: SparkSession, sizes: dict[str, int], seed: int = 42) -> dict[str, str]:
    """The same cuts after a seeded Mersenne shuffle of the sorted group names,
    for a list of groups that fits the driver."""
    keys = sorted(sizes)
    if len(keys) < 3:
        raise ValueError("At least 3 independent groups are needed for train, val and test")
    random.Random(seed).shuffle(keys)
    rows = spark.createDataFrame([(k, sizes[k], i) for i, k in enumerate(keys)], "group string, n long, place long")
    return {r["group"]: r["split"] for r in _cuts(rows).collect()}


def assign_splits(images: DataFrame, components: DataFrame, seed: int = 42) -> DataFrame:
    """Every image, copies too, with its component's split."""
    return images.join(components, "group_id").join(split_groups(images, components, seed).select("root", "split"), "root")


def round_robin(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """``n`` rows taken in turn from each group, groups by their first row."""
    own = W.partitionBy(group)
    # no group gives more than n rows, so a task keeps no more of one; what is kept still has its first row
    placed = rows.withColumn("_turn", F.row_number().over(own.orderBy(order))).where(F.col("_turn") <= n).withColumn("_first", F.min(order).over(own))
    return placed.orderBy("_turn", "_first").limit(n).drop("_turn", "_first")


def background_sample(negatives: DataFrame, group: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` negatives in turn from the groups by name, seeded order in each."""
    placed = negatives.withColumn("_turn", F.row_number().over(W.partitionBy(group).orderBy(hash_order(seed, F.col("image_id")), "image_id"))).where(F.col("_turn") <= n)
    return placed.orderBy("_turn", group).limit(n).drop("_turn")


def linspace_sample(rows: DataFrame, order: str, k: int) -> DataFrame:
    """``k`` rows evenly spaced by a unique column, first and last among them.

    The column alone is sorted, by range partitions; their counts, one number a
    partition, say in which of them and where the wanted places are.
    """
    ids = rows.select(order).repartitionByRange(order).sortWithinPartitions(order).select(order, F.monotonically_increasing_id().alias("_id"))
    ids = Scratch(rows.sparkSession, "linspace").table(ids, "ids")
    counts = sorted(map(tuple, ids.groupBy(F.shiftright("_id", 33)).count().collect()))
    total = sum(n for _, n in counts)
    k = min(k, total)
    wanted = sorted({i * (total - 1) // (k - 1) for i in range(k)} if k > 1 else set(range(k)))
    at, before = {}, 0
    for part, n in counts:
        at |= {(part << 33) + p - before: p for p in wanted if before <= p < before + n}
        before += n
    places = F.create_map(*[F.lit(x) for kv in at.items() for x in kv]) if at else F.lit(None).cast("map<bigint,int>")
    chosen = ids.where(F.col("_id").isin(list(at))).select(order, F.try_element_at(places, F.col("_id")).cast("int").alias("place"))
    return rows.join(F.broadcast(chosen), order)  # k rows


def contact_sheet(rows: DataFrame, group: str, order: str, n: int = 8) -> DataFrame:
    """Every k-th row of a group by a unique column so that about ``n`` remain, then the first ``n``."""
    scratch = Scratch(rows.sparkSession, "sheet")
    placed = running_sums(rows.select(group, order, F.lit(1).cast("long").alias("_one")), [group], [order], ["_one"], scratch)
    step = rows.groupBy(group).agg(F.greatest(F.lit(1), F.floor(F.count("*") / n)).alias("_s"))
    chosen = same_keys(placed, step, [group]).where(F.expr(f"before__one % _s = 0 and before__one div _s < {int(n)}"))
    return rows.join(chosen.select(order), order, "left_semi")


def union_of_ids(*parts: DataFrame, key: str = "image_id") -> DataFrame:
    """Every id that one of the parts has, once."""
    return reduce(DataFrame.union, [p.select(key) for p in parts]).distinct()


def concatenated(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, repeats too, by column name."""
    return reduce(DataFrame.unionByName, parts)


def available(rows: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Rows whose file is in a listing."""
    return rows.join(listing.select(key), key, "left_semi")


def overridden(record: Column, **fields: Column) -> Column:
    """A struct with some fields replaced or added."""
    return reduce(lambda c, kv: c.withField(*kv), fields.items(), record)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def reindexed(categories: DataFrame) -> DataFrame:
    """``source_id`` and a dense ``id`` from 0 in its order; one row per category."""
    return categories.withColumn("source_id", F.col("id")).withColumn("id", F.dense_rank().over(W.orderBy("source_id")) - 1)


def remapped(annotations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Annotations of mapped categories, with the target's id; ``mapping`` is
    ``(category_id, target)``, one row per category.

    A few categories hold all annotations, so a shuffle by category would give them
    to as few tasks; a mapping of at most ``SMALL`` rows goes to every task instead.
    """
    small = mapping.limit(SMALL + 1).count() <= SMALL
    return annotations.join(F.broadcast(mapping) if small else mapping, "category_id").drop("category_id").withColumnRenamed("target", "category_id")


def rescaled(annotations: DataFrame, scales: DataFrame) -> DataFrame:
    """Boxes, areas and polygons times the ``sx``, ``sy`` of their image."""
    from gridlark.functions.boxes import scaled_polygon

    a = annotations.join(scales, "image_id")
    bbox = F.transform("bbox", lambda v, i: v * F.when(i % 2 == 0, F.col("sx")).otherwise(F.col("sy")))
    a = a.withColumn("bbox", bbox)
    if "area" in a.columns:
        a = a.withColumn("area", F.col("area") * F.col("sx") * F.col("sy"))
    if "segmentation" in a.columns:
        a = a.withColumn("segmentation", F.transform("segmentation", lambda p: scaled_polygon(p, F.col("sx"), F.col("sy"))))
    return a.drop("sx", "sy")


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with ``side``."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).withColumn("side", F.lit("only_first")).unionByName(b.select(*cols).exceptAll(a).withColumn("side", F.lit("only_second")))


def table_identity(df: DataFrame, *columns: str) -> DataFrame:
    """One row: ``n`` and a digest that row order does not change.

    Rows are hashed one by one and the halves summed, so the digest is combined
    in partial aggregates and nothing is collected.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns or df.columns)])
    hashed = F.sha2(text, 256)
    part = lambda k: F.sum(F.conv(F.substring(hashed, k, 15), 16, 10).cast("decimal(38,0)"))
    total = df.agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))
    zero = F.lit(0).cast("decimal(38,0)")
    return total.select("n", F.sha2(F.concat_ws(":", "n", F.coalesce("a", zero).cast("string"), F.coalesce("b", zero).cast("string")), 256).alias("identity"))
