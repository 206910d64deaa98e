"""Configuration, digests by leaf, kept results."""

import json

import pytest
from pyspark.sql import functions as F

from gridlark.operators import quality, trace
from gridlark.operators.quality import ConstraintError
from gridlark.settings import Number, checked, load

RULES = {"epochs": Number(1, whole=True), "rate": Number(0, 1, above=True), "optimizer": ("SGD", "Adam"), "cache": (False, "ram"), "aug": {"degrees": Number(0, 180)}}
GOOD = {"epochs": 3, "rate": 0.5, "optimizer": "Adam", "cache": False, "aug": {"degrees": 0}}


@pytest.mark.parametrize(
    "change", [{"epochs": 0}, {"epochs": 1.0}, {"epochs": True}, {"rate": 0}, {"rate": float("nan")}, {"optimizer": "X"}, {"cache": 0}, {"aug": {}}, {"aug": {"degrees": 181}}, {"aug": 1}, {"more": 1}]
)
def test_ranges_and_exact_keys(change):
    checked(GOOD, RULES)
    with pytest.raises(ConstraintError):
        checked(GOOD | change, RULES)
    with pytest.raises(ConstraintError, match="rate"):
        checked({k: v for k, v in GOOD.items() if k != "rate"}, RULES)


def test_configuration_files(tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps(GOOD), encoding="utf-8")
    assert load(str(tmp_path / "a.json")) == GOOD
    (tmp_path / "b.json").write_text("[]")
    with pytest.raises(ConstraintError):
        load(str(tmp_path / "b.json"))
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("epochs: 3\naug: {degrees: 0}\n")
    assert load(str(tmp_path / "a.yaml")) == {"epochs": 3, "aug": {"degrees": 0}}


def test_each_tampered_link_is_named(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", None), (2, "train", "x"), (3, "val", "y"), (4, None, "z")], "id int, split string, sha string")
    selection = {"name": "b", "conf": 0.25, "report": "r1"}

    def tree(rows, selection, weights="w1"):
        files = spark.createDataFrame([("best.pt", weights)], "path string, sha256 string")
        return trace.leaves("dataset", rows, "split").unionByName(trace.record_leaf(spark, "selection", selection)).unionByName(trace.file_leaves("weights", files))

    frozen = tree(rows, selection)
    trace.assert_untampered(frozen, tree(rows.repartition(3), dict(reversed(selection.items()))))
    assert trace.root(frozen) == trace.root(tree(rows.repartition(3), selection)) != trace.root(tree(rows, selection, "w2"))
    for now, named in (
        (tree(rows.withColumn("sha", F.coalesce("sha", F.lit(""))), selection), "dataset/train"),
        (tree(rows.where("id <> 4"), selection), r"dataset/\(null\) \(missing\)"),
        (tree(rows, selection | {"conf": 0.3}), "selection/conf"),
        (tree(rows, selection, "w2"), "weights/best.pt"),
        (tree(rows.unionByName(rows.where("id = 3")), selection), "dataset/val"),
    ):
        with pytest.raises(ConstraintError, match=named):
            trace.assert_untampered(frozen, now)


def test_kept_results_are_not_computed_again(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    first, made = trace.remembered(spark, "s1", compute, f"file://{tmp_path}/store")
    again, made_again = trace.remembered(spark, "s1", compute, f"file://{tmp_path}/store")
    assert (made, made_again, len(calls)) == (True, False, 1) and first.count() == again.count() == 3
    assert trace.remembered(spark, "s2", compute, f"file://{tmp_path}/store")[1] and len(calls) == 2


def test_minimum_images(spark):
    quality.enough_images(spark.range(100))
    with pytest.raises(ConstraintError, match="99 images"):
        quality.enough_images(spark.range(99))
