"""Validation, duplicates, components, splits, sampling, tiles."""

import pytest
from pyspark.sql import functions as F

from gridlark.operators import curate, profile, quality, tiling

IMAGES = "image_id long, group_id string, sha256 string, width int, height int"
#: Sizes of the seventeen published filename groups.
SIZES = {
    "batch_d07": 92, "unverified_gopro": 38, "batch_s05": 44, "unverified_camera": 4, "unverified_photo": 6, "batch_s03": 41, "batch_s02": 157, "batch_02": 41, "batch_05": 48,
    "batch_s04": 62, "batch_01": 36, "batch_s01": 34, "batch_d06": 36, "unverified_dji": 2, "batch_03": 21, "batch_04": 54, "batch_d08": 56,
}


#: A copy links "north" with "south"; "east" and "west" stand alone.
PHOTOS = [(11, "north", "a"), (12, "south", "a"), (13, "south", "b"), (14, "east", "c"), (15, "west", "d"), (16, "west", "e"), (17, "east", "f"), (18, "north", "g")]
BOXES = "image_id long, class_id int, x1 double, y1 double, x2 double, y2 double"


def photos(spark):
    return spark.createDataFrame([(*p, 20, 10) for p in PHOTOS], IMAGES)


def test_linked_groups_share_a_split(spark):
    imgs = photos(spark)
    roots = {r[0]: r[1] for r in curate.group_components(imgs).collect()}
    assert roots == {"north": "north", "south": "north", "east": "east", "west": "west"}
    split = {r["image_id"]: r["split"] for r in curate.assign_splits(imgs, curate.group_components(imgs)).collect()}
    for together in ((11, 12, 13, 18), (14, 17), (15, 16)):
        assert len({split[i] for i in together}) == 1
    assert set(split.values()) == {"train", "val", "test"}
    dup = {r["image_id"]: r["duplicate_of"] for r in curate.exact_dedup(imgs).collect()}
    assert {k: v for k, v in dup.items() if v is not None} == {12: 11} and curate.representatives(imgs).count() == 7


def test_long_chain_of_groups(spark):
    rows = [(i, f"g{i // 2:03d}", f"s{(i + 1) // 2:03d}", 1, 1) for i in range(60)]
    assert {r[1] for r in curate.group_components(spark.createDataFrame(rows, IMAGES)).collect()} == {"g000"}


def test_published_split_sizes(spark):
    split = curate.split_groups_shuffled(spark, SIZES)
    got = {s: sum(n for g, n in SIZES.items() if split[g] == s) for s in ("train", "val", "test")}
    assert got == {"train": 522, "val": 160, "test": 90}
    with pytest.raises(ValueError, match="3 independent groups"):
        curate.split_groups_shuffled(spark, {"a": 1, "b": 2})


def test_conflicting_copies(spark):
    box = spark.createDataFrame([(11, 0, 3.0, 1.0, 12.0, 8.0), (12, 0, 3.0, 1.0, 12.0, 7.0)], BOXES)
    assert [tuple(r) for r in curate.duplicate_conflicts(photos(spark), box).collect()] == [("a", 2, 2)]
    same = box.withColumn("y2", F.lit(7.0)).unionByName(box.withColumn("y2", F.lit(9.0)))
    assert curate.duplicate_conflicts(photos(spark), same).isEmpty()


def test_tiles(spark):
    tiles = tiling.tile_grid(photos(spark), 10)
    assert tiles.count() == 16
    box = spark.createDataFrame([(i, 0, 3.0, 1.0, 12.0, 8.0) for i in range(11, 18)], BOXES)
    n = tiling.tile_counts(tiles, tiling.boxes_in_tiles(tiles, box)).collect()
    assert {r["objects"] for r in n if r["image_id"] < 18} == {1} and {r["objects"] for r in n if r["image_id"] == 18} == {0}
    assert tiling.tile_grid(photos(spark), None).count() == 8
    touching = box.withColumn("x2", F.lit(10.0))
    assert tiling.boxes_in_tiles(tiles.where("left = 10"), touching).isEmpty()
    small = tiling.tile_grid(photos(spark).limit(1), 50).collect()
    assert [(r["left"], r["top"], r["right"], r["bottom"]) for r in small] == [(0, 0, 20, 10)]


def test_rescale(spark):
    a = spark.createDataFrame([(1, [20.0, 10.0, 40.0, 20.0], 800.0, [[20.0, 10.0, 60.0, 30.0]])], "image_id long, bbox array<double>, area double, segmentation array<array<double>>")
    r = curate.rescaled(a, spark.createDataFrame([(1, 0.5, 0.5)], "image_id long, sx double, sy double")).first()
    assert r["bbox"] == [10, 5, 20, 10] and r["area"] == 200 and r["segmentation"] == [[10, 5, 30, 15]]


def test_quarantine_keeps_boxes_that_only_stick_out(spark):
    imgs = spark.createDataFrame([(1, 100, 100), (2, 100, 100)], "id long, width int, height int")
    cats = spark.createDataFrame([(9, "litter")], "id int, name string")
    boxes = [[1.0, 1.0, 2.0, 2.0], [1.0, 1.0, -2.0, 2.0], [99.0, 0.0, 2.0, 1.0], [99.0, 0.0, 3.0, 1.0], None, [1.0, 1.0, float("inf"), 2.0]]
    rows = [(i, 1, 9, b) for i, b in enumerate(boxes)] + [(90, 7, 9, boxes[0]), (91, 1, 8, boxes[0])]
    got = {r["id"]: (r["issue"], r["kept"]) for r in quality.annotation_issues(spark.createDataFrame(rows, "id long, image_id long, category_id int, bbox array<double>"), imgs, cats).collect()}
    assert got[0] == (None, True) and got[2] == (None, True) and got[3] == ("bbox exceeds image", True)
    assert got[1] == ("nonpositive dimensions", False) and got[4] == got[5] == ("invalid numeric bbox", False) and got[90] == got[91] == ("unknown image or category", False)
    with pytest.raises(quality.ConstraintError, match="Invalid box"):
        quality.validated(imgs, spark.createDataFrame([(1, 1, 9, boxes[1])], "id long, image_id long, category_id int, bbox array<double>"), cats)
    with pytest.raises(quality.ConstraintError, match="Repeated category name"):
        quality.validated(imgs, spark.createDataFrame([], "id long, image_id long, category_id int, bbox array<double>"), spark.createDataFrame([(1, "a"), (2, "a")], "id int, name string"))
    assert quality.uncovered(photos(spark), photos(spark).where("image_id > 11")).count() == 1


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "image_id long, g string")
    assert [r[0] for r in curate.round_robin(df.where("image_id <> 1"), "g", "image_id", 4).orderBy("image_id").collect()] == [0, 2, 3, 5]
    assert [r[0] for r in curate.linspace_sample(df, "image_id", 4).orderBy("image_id").collect()] == [0, 3, 6, 9]
    assert curate.linspace_sample(df, "image_id", 1).first()[0] == 0 and curate.linspace_sample(df, "image_id", 99).count() == 10
    assert curate.background_sample(df, "g", 3).count() == 3
    many = spark.range(40).select(F.col("id").alias("image_id"), F.lit("g").alias("g"))
    assert [r[0] for r in curate.contact_sheet(many, "g", "image_id").orderBy("image_id").collect()] == list(range(0, 40, 5))


def test_identity_and_diff(spark):
    df = photos(spark)
    one = curate.table_identity(df).first()
    assert one == curate.table_identity(df.orderBy(F.desc("image_id")).repartition(3)).first()
    assert one != curate.table_identity(df.withColumn("sha256", F.when(F.col("image_id") == 14, "y").otherwise(F.col("sha256")))).first()
    assert curate.manifest_diff(df, df).isEmpty()
    assert {tuple(r)[-1] for r in curate.manifest_diff(df, df.union(df.limit(1))).collect()} == {"only_second"}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 4)], "v double")
    assert [r["n"] for r in profile.histogram(df, "v", 4).orderBy("bin").collect()] == [1, 1, 1, 1]
    assert sum(r["n"] for r in profile.histogram(df.where("v = 1"), "v", 3).collect()) == 1


def test_fewer_than_three_groups_have_no_split(spark):
    """Two independent groups cannot fill train, val and test."""
    rows = [(i, f"g{i % 2}", f"h{i}") for i in range(8)]
    images = spark.createDataFrame(rows, "image_id long, group_id string, sha256 string")
    components = spark.createDataFrame([("g0", "g0"), ("g1", "g1")], "group_id string, root string")
    with pytest.raises(Exception, match="Fewer than three"):
        curate.assign_splits(images, components).collect()
    assert curate.assign_splits(images.limit(0), components).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 7, 50])
def test_linspace_of_any_size(spark, k):
    rows = spark.range(40, numPartitions=5).selectExpr("39 - id AS image_id")
    got = {(r["image_id"], r["place"]) for r in curate.linspace_sample(rows, "image_id", k).collect()}
    n = min(k, 40)
    assert got == {(p, p) for p in ({i * 39 // (n - 1) for i in range(n)} if n > 1 else set(range(n)))}


def test_running_sums_and_percentiles(spark):
    import random

    from gridlark.operators.order import percentiles, running_sums
    from gridlark.scratch import Scratch

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([1, 2, 5, None]), rng.choice([0.5, 1.5, float(i), None, float("nan")])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o long, v long, x double").repartition(7)
    for by in ([], ["g"]):
        got = {r.o: r.before_v for r in running_sums(df, by, ["o"], ["v"], Scratch(spark, "t")).collect()}
        so_far, want = {}, {}
        for g, o, v, _ in rows:
            k = g if by else 0
            want[o] = so_far.get(k, 0)
            so_far[k] = want[o] + (v or 0)
        assert got == want
    got = {r.g: (r.m, r.p) for r in percentiles(df, ["g"], "x", {"m": 0.5, "p": 0.95}, Scratch(spark, "t")).collect()}
    want = {r.g: (r.m, r.p) for r in df.groupBy("g").agg(F.percentile("x", 0.5).alias("m"), F.percentile("x", 0.95).alias("p")).collect()}
    assert {k: tuple(map(str, v)) for k, v in got.items()} == {k: tuple(map(str, v)) for k, v in want.items()}
    none = df.withColumn("x", F.lit(None).cast("double")).where("g = 'a'")
    assert [tuple(r) for r in percentiles(none, ["g"], "x", {"m": 0.5}, Scratch(spark, "t")).collect()] == [("a", None)]
    plan = running_sums(df, [], ["o"], ["v"], Scratch(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize(("tile", "overlap"), [(10, 0.0), (10, 0.35), (7, 0.5), (50, 0.1), (3, 0.9)])
def test_tiles_of_a_box_by_arithmetic(spark, tile, overlap):
    import random

    rng = random.Random(9)
    sizes = [(i, rng.randint(1, 60), rng.randint(1, 45)) for i in range(25)]
    boxes = []
    for i, w, h in sizes:
        for k in range(12):
            x, y = rng.choice([rng.uniform(-5, w), float(rng.randint(0, w))]), rng.choice([rng.uniform(-5, h), float(rng.randint(0, h))])
            boxes.append((i, k, x, y, x + rng.choice([0.0, 0.5, 3.0, 10.0, 80.0]), y + rng.choice([0.25, 7.0, 20.0])))
    imgs = spark.createDataFrame(sizes, "image_id long, width int, height int")
    given = spark.createDataFrame(boxes, "image_id long, idx int, x1 double, y1 double, x2 double, y2 double")
    want = tiling.boxes_in_tiles(tiling.tile_grid(imgs, tile, overlap), given)
    got = tiling.boxes_on_grid(imgs, given, tile, overlap)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_a_remap_shuffles_no_annotations(spark, monkeypatch):
    mapping = spark.createDataFrame([("A", 2), ("N", 0)], "category_id string, target int")
    rows = spark.range(1000).select("id", F.when(F.col("id") % 4 == 0, "A").when(F.col("id") % 4 == 1, "N").otherwise("R").alias("category_id"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = curate.remapped(rows, mapping)
    assert "BuildRight" in plan(got) and "SortMergeJoin" not in plan(got)  # the mapping goes to the tasks
    monkeypatch.setattr(curate, "SMALL", 1)
    more = curate.remapped(rows, mapping)
    assert "BuildRight" not in plan(more) and sorted(map(tuple, more.collect())) == sorted(map(tuple, got.collect())) and got.count() == 500
