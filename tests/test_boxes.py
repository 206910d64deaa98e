"""Clipping, normalisation, label parsing, names, rounding."""

import pytest
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.functions import names as N
from gridlark.functions import scores as C


def value(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lits(*v):
    return [F.lit(float(x)) for x in v]


def test_clip_and_normalise(spark):
    corners = B.clip(*lits(5, -3, 10, 6), F.lit(12), F.lit(8))
    assert value(spark, *corners) == (5, 0, 12, 3)
    shares = (17 / 24, 3 / 16, 7 / 12, 3 / 8)
    assert value(spark, *B.normalised(*corners, F.lit(12), F.lit(8))) == pytest.approx(shares)
    assert value(spark, B.was_clipped(corners, *lits(5, -3, 10, 6))) == (True,)
    assert value(spark, *B.denormalised(*lits(*shares), F.lit(12), F.lit(8))) == pytest.approx((5, 0, 12, 3))


@pytest.mark.parametrize("bbox", [None, [], [0.0, 0.0, 0.0, 2.0], [0.0, 0.0, float("nan"), 1.0], [0.0, 0.0, float("inf"), 1.0], [1.0, 2.0, 3.0], [None, 0.0, 1.0, 1.0], [1.7e308, 0.0, 1.7e308, 1.0]])
def test_invalid_boxes(spark, bbox):
    df = spark.createDataFrame([(bbox,)], "b array<double>")
    assert df.select(B.valid_bbox(F.col("b"))).first()[0] is False


def test_box_beside_the_image_has_no_area(spark):
    assert value(spark, B.has_area(*B.clip(*lits(20, 0, 2, 2), F.lit(10), F.lit(8)))) == (False,)


@pytest.mark.parametrize(
    ("label", "ok"),
    [
        ((2, 0.25, 0.625, 0.5, 0.75), True),
        ((1, 0.375, float("nan"), 0.25, 0.125), False),
        ((7, 0.25, 0.25, 0.125, 0.25), False),
        ((0.25, 0.75, 0.25, 0.125, 0.5), False),
        ((1, 0.25, 0.875, 0.25, 0.5), False),
        ((2, 0.375, 0.375, 0.25, -0.125), False),
    ],
)
def test_label_range(spark, label, ok):
    assert value(spark, B.label_in_range(*lits(*label), 3)) == (ok,)


def test_iou_and_bins(spark):
    assert value(spark, B.iou(tuple(lits(0, 0, 2, 2)), tuple(lits(1, 0, 3, 2))))[0] == pytest.approx(1 / 3)
    assert value(spark, B.iou(tuple(lits(0, 0, 0, 0)), tuple(lits(0, 0, 0, 0)))) == (0.0,)
    assert value(spark, B.size_bin(F.lit(7.9)), B.size_bin(F.lit(8)), B.size_bin(F.lit(16))) == ("short_side_lt_8px", "short_side_8_to_16px", "short_side_ge_16px")
    assert value(spark, B.overlap_bin(F.lit(0.1), 0.5), B.overlap_bin(F.lit(0.5), 0.5)) == ("overlap_0.1_to_match_iou", "duplicate_or_assignment_conflict")
    assert value(spark, B.aspect_differs(F.lit(100), F.lit(50), F.lit(200), F.lit(100)), B.aspect_differs(F.lit(100), F.lit(60), F.lit(200), F.lit(100))) == (False, True)


def test_names(spark):
    files = ["BATCH_k19_img_55.jpg", "batch_k19_img_7.jpg", "batch_44_frame_902.jpg", "gopr7.Jpg", "a/dji_1.png", "x.jpg"]
    df = spark.createDataFrame([(f,) for f in files], "f string")
    assert [r[0] for r in df.select(N.sequence_group(F.col("f"))).collect()] == ["batch_k19", "batch_k19", "batch_44", "unverified_gopro", "unverified_dji", "unverified_other"]
    unsafe = ["/a", "C:\\a", "a/../b", "..\\a", " "]
    df = spark.createDataFrame([(f,) for f in [*unsafe, "a/b.jpg"]], "f string")
    assert [r[0] for r in df.select(N.is_safe_path(F.col("f"))).collect()] == [False] * 5 + [True]
    assert value(spark, N.output_name(F.lit(7), F.lit("TIFF")), N.output_name(F.lit(7), F.lit("gif"), F.lit(2))) == ("image_00000007.tiff", "image_00000007_tile_00002.png")
    assert value(spark, N.first_url(F.lit(""), F.lit("http://a/b")), N.relative_to(F.lit("/r/a"), "/r"), N.is_identifier(F.lit("a b"))) == ("https://a/b", "a", False)


def test_zero_and_null_ratios(spark):
    zero = F.lit(0)
    assert value(spark, *C.precision_recall_f1(zero, zero, zero)) == (0.0, 0.0, 0.0)
    assert value(spark, C.recall_or_null(zero, zero)) == (None,)
    assert value(spark, C.shown(F.lit(2.5), 0)) == (2.0,)
