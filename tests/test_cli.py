"""Commands end to end on small files."""

import json

import pytest
from pyspark.sql import functions as F

from gridlark import cli
from gridlark.operators.quality import ConstraintError

IMAGES = [{"id": i, "file_name": f"batch_0{i}_img_1.jpg", "width": 20, "height": 10} for i in range(11, 19)]
BOXES = [{"id": i, "image_id": i, "category_id": 4, "bbox": [3, 1, 9, 7]} for i in range(11, 18)]
GROUPS = dict(zip(range(11, 19), ["north", "south", "south", "east", "west", "west", "east", "north"], strict=True))


@pytest.fixture
def document(tmp_path):
    path = tmp_path / "coco.json"
    path.write_text(json.dumps({"images": IMAGES, "annotations": BOXES, "categories": [{"id": 4, "name": "bottle"}]}))
    return str(path)


def test_audit(spark, tmp_path, document):
    cli.main(["audit", "--annotations", document, "--output", str(tmp_path / "out")])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out/classes"), header=True).collect()] == [("4", "bottle", "7", "7")]
    assert spark.read.csv(str(tmp_path / "out/images"), header=True).where("objects = 0").count() == 1


def test_prepare(spark, tmp_path, document):
    (tmp_path / "groups.csv").write_text("image_id,group_id\n" + "".join(f"{i},{g}\n" for i, g in GROUPS.items()))
    spark.createDataFrame([(i, "same" if i < 13 else str(i)) for i in GROUPS], "image_id long, sha256 string").write.parquet(str(tmp_path / "digests"))
    cli.prepare(spark, document, str(tmp_path / "groups.csv"), str(tmp_path / "digests"), str(tmp_path / "out"), tile=10)
    manifest = {r["image_id"]: r for r in spark.read.csv(str(tmp_path / "out/split_manifest"), header=True).collect()}
    assert len({manifest[str(i)]["split"] for i in (11, 12, 13, 18)}) == 1 and manifest["12"]["duplicate_of"] == "11" and manifest["11"]["duplicate_of"] is None
    tiles = spark.read.parquet(str(tmp_path / "out/tiles"))
    assert tiles.count() == 7 * 2 and tiles.where("objects = 1").count() == 6 * 2
    assert spark.read.parquet(str(tmp_path / "out/labels")).where("w > 0 and w <= 1").count() == 12
    with pytest.raises(Exception, match="(?i)exists"):
        cli.prepare(spark, document, str(tmp_path / "groups.csv"), str(tmp_path / "digests"), str(tmp_path / "out"))


def test_evaluate_and_verify(spark, tmp_path):
    box = [0.0, 0.0, 10.0, 10.0]
    rows = [
        {"image": "a", "tp": 1, "fp": 0, "fn": 0, "detections": [{"class_id": 0, "class_name": "bag", "confidence": 0.8, "xyxy": box}], "truth": [{"class_id": 0, "xyxy": box}]},
        {"image": "b", "tp": 0, "fp": 0, "fn": 0, "detections": [], "truth": []},
    ]
    (tmp_path / "rows.json").write_text(json.dumps(rows))
    cli.evaluate(spark, str(tmp_path / "rows.json"), str(tmp_path / "out"), [0.1, 0.4, 0.8])
    best = spark.read.json(str(tmp_path / "out/operating_point")).first()
    assert (best["conf"], best["f1"]) == (0.8, 1.0) and spark.read.json(str(tmp_path / "out/per_image")).count() == 2
    for name, text in (("m.csv", "a,b\n1,2\n3,4\n"), ("r.csv", "a,b\n3,4\n1,2\n"), ("x.csv", "a,b\n3,4\n1,9\n")):
        (tmp_path / name).write_text(text)
    assert len(cli.verify(spark, str(tmp_path / "m.csv"), str(tmp_path / "r.csv"))) == 64
    with pytest.raises(ConstraintError):
        cli.verify(spark, str(tmp_path / "m.csv"), str(tmp_path / "x.csv"))


def test_latency_and_summarize(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"model": "m", "wall_ms": 1.0}\n{"model": "m", "wall_ms": 3.0}\n')
    cli.latency(spark, str(tmp_path / "s.json"), str(tmp_path / "l"), ["wall_ms"])
    assert spark.read.json(str(tmp_path / "l")).first()["median_ms"] == 2.0
    (tmp_path / "r.json").write_text('{"name": "a", "seed": 1}\n{"name": "b", "seed": 1}\n')
    cli.summarize(spark, str(tmp_path / "r.json"), str(tmp_path / "c"), ["seed"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_analyze(spark, tmp_path):
    tall, flat = [0.0, 0.0, 30.0, 30.0], [50.0, 50.0, 70.0, 54.0]
    found = [{"class_id": 0, "class_name": "bag", "confidence": 0.8, "xyxy": tall}]
    rows = [{"image": "a", "tp": 1, "fp": 0, "fn": 1, "detections": found, "truth": [{"class_id": 0, "xyxy": tall}, {"class_id": 0, "xyxy": flat}]}]
    (tmp_path / "rows.json").write_text(json.dumps(rows))
    (tmp_path / "images.csv").write_text("image_id,width,height\na,640,320\n")
    cli.analyze(spark, str(tmp_path / "rows.json"), str(tmp_path / "images.csv"), str(tmp_path / "out"), 0.5)
    got = {r["size_bin"]: (r["objects"], r["found"]) for r in spark.read.json(str(tmp_path / "out/recall_by_size")).collect()}
    assert got == {"short_side_lt_8px": (1, 0), "short_side_8_to_16px": (0, 0), "short_side_ge_16px": (1, 1)}
    assert sum(r["n"] for r in spark.read.json(str(tmp_path / "out/false_positives")).collect()) == 0


def test_select_and_gate(spark, tmp_path):
    (tmp_path / "runs.json").write_text('{"name": "a", "seed": 1, "mAP50_95": 0.3}\n{"name": "b", "seed": 1, "mAP50_95": 0.5}\n')
    (tmp_path / "m.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    chosen = str(tmp_path / "chosen")
    cli.select(spark, str(tmp_path / "runs.json"), str(tmp_path / "m.csv"), chosen, 0.25)
    assert cli.gate(spark, chosen, str(tmp_path / "m.csv")) == "b"
    with pytest.raises(ConstraintError, match="dataset"):
        cli.gate(spark, chosen, str(tmp_path / "other.csv"))
    spark.read.json(chosen).withColumn("conf", F.lit(0.3)).write.json(str(tmp_path / "changed"))
    with pytest.raises(ConstraintError, match="changed"):
        cli.gate(spark, str(tmp_path / "changed"), str(tmp_path / "m.csv"))


def test_final_test_scores_behind_the_chain(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "runs.json").write_text('{"name": "a", "mAP50_95": 0.3}\n{"name": "b", "mAP50_95": 0.5}\n')
    (tmp_path / "m.csv").write_text("image_id,split\n1,train\n2,val\n3,test\n")
    for folder, text in (("report", "scores"), ("weights", "numbers")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{folder}.txt").write_text(text)
    box = [0.0, 0.0, 10.0, 10.0]
    found = [{"class_id": 0, "class_name": "bag", "confidence": c, "xyxy": box} for c in (0.8, 0.1)]
    (tmp_path / "rows.json").write_text(json.dumps([{"image": "t", "tp": 0, "fp": 0, "fn": 0, "detections": found, "truth": [{"class_id": 0, "xyxy": box}]}]))
    given = ["--manifest", at("m.csv"), "--report", at("report"), "--weights", at("weights")]
    cli.main(["freeze", "--runs", at("runs.json"), "--conf", "0.25", "--output", at("frozen"), *given])
    run = lambda out: cli.main(["final_test", "--chosen", at("frozen"), "--per-image", at("rows.json"), "--output", at(out), *given])
    run("out")
    assert (r := spark.read.json(at("out/totals")).first()) and (r["conf"], r["tp"], r["fp"], r["fn"]) == (0.25, 1, 0, 0)
    for name, text, link in (("m.csv", "image_id,split\n1,train\n2,val\n9,test\n", "dataset/test"), ("report/report.txt", "other", "report/report.txt"), ("weights/weights.txt", "other", "weights/weights.txt")):
        before = (tmp_path / name).read_text()
        (tmp_path / name).write_text(text)
        with pytest.raises(ConstraintError, match=link):
            run("again")
        (tmp_path / name).write_text(before)
