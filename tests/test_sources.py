"""Readers and writers, there and back."""

import json

import pytest
from pyspark.sql import functions as F

from gridlark.operators.detector import detect
from gridlark.operators.quality import ConstraintError
from gridlark.sources import readers as R
from gridlark.sources import writers as K
from gridlark.sources.sinks import coco_file

COCO = {
    "images": [{"id": i, "file_name": f"batch_1/{i}.jpg", "width": 12, "height": 8} for i in (1, 2)],
    "annotations": [{"id": 1, "image_id": 1, "category_id": 9, "bbox": [4, 2, 6, 4], "area": 24, "segmentation": [[4, 2, 10, 2, 10, 6]]}],
    "categories": [{"id": 9, "name": "litter"}],
}


def test_coco_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps(COCO), encoding="utf-8")
    doc = R.coco(spark, str(tmp_path / "a.json"))
    assert doc["images"].count() == 2 and doc["annotations"].first()["bbox"] == [4, 2, 6, 4]
    coco_file(doc["images"], doc["annotations"], doc["categories"], str(tmp_path / "b"))
    again = R.coco(spark, str(tmp_path / "b"))
    assert all(again[k].exceptAll(doc[k]).isEmpty() and doc[k].exceptAll(again[k]).isEmpty() for k in ("images", "categories"))
    (tmp_path / "c.json").write_text('{"images": []}')
    with pytest.raises(ConstraintError):
        R.coco(spark, str(tmp_path / "c.json"))
    assert R.coco(spark, str(tmp_path / "c.json"), strict=False)["annotations"].count() == 0


def test_groups_and_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text("\ufeffimage_id,group_id\n1,A\n2,B\n", encoding="utf-8")
    assert [tuple(r) for r in R.groups(spark, str(tmp_path / "g.csv")).orderBy("image_id").collect()] == [(1, "A"), (2, "B")]
    for bad in ("image_id,group_id\n1,A\n1,B\n", "image_id,group_id\n1, \n", "image_id\n1\n", "image_id,group_id\nx,A\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ConstraintError):
            R.groups(spark, str(tmp_path / "bad.csv"))
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, duplicate_of string")
    K.csv(df, str(tmp_path / "out"), ["duplicate_of", "id"])
    got = R.canonical(R.csv(spark, str(tmp_path / "out")))
    assert got.columns == ["duplicate_of", "id"] and [tuple(r) for r in got.orderBy("id").collect()] == [(None, "1"), ("x", "2")]
    with pytest.raises(Exception, match="(?i)exists"):
        K.csv(df, str(tmp_path / "out"), ["id"])


def test_labels(spark, tmp_path):
    labels = spark.createDataFrame([("a", 0, 0.5, 0.5, 0.25, 0.2), ("a", 1, 0.1, 0.1, 0.1, 0.1)], "stem string, class_id int, cx double, cy double, w double, h double")
    lines = labels.select("stem", K.label_line(F.col("class_id"), *[F.col(c) for c in ("cx", "cy", "w", "h")]).alias("line"))
    imgs = spark.createDataFrame([("a",), ("empty",)], "stem string")
    assert {r[0]: r[1] for r in K.label_text(lines, imgs).collect()} == {"a": "0 0.5 0.5 0.25 0.2\n1 0.1 0.1 0.1 0.1", "empty": ""}
    K.label_files(lines, imgs, str(tmp_path / "labels"))
    assert sorted(p.name for p in (tmp_path / "labels").iterdir() if not p.name.startswith(".")) == ["a.txt", "empty.txt"] and (tmp_path / "labels/empty.txt").read_text() == ""
    back = R.expected_labels(spark, str(tmp_path / "labels"), imgs)
    assert back.exceptAll(labels.withColumn("class_id", F.col("class_id").cast("double"))).isEmpty() and back.count() == 2
    assert {r[0]: r[1] for r in R.label_tally(spark, str(tmp_path / "labels")).collect()} == {"0": 1, "1": 1}
    for stems, name in (([("a",)], "empty"), ([("a",), ("empty",), ("gone",)], "gone")):
        with pytest.raises(ConstraintError, match=name):
            R.expected_labels(spark, str(tmp_path / "labels"), spark.createDataFrame(stems, "stem string"))
    with pytest.raises(Exception, match="exists"):
        K.label_files(lines, imgs, str(tmp_path / "labels"))
    with pytest.raises(Exception, match="cannot be written"):
        K.label_files(lines, imgs, "nowhere://a/b")
    with pytest.raises(Exception, match="same file"):
        K.label_files(lines, imgs.union(imgs), str(tmp_path / "twice"))
    assert not [p for p in tmp_path.iterdir() if "_stage" in p.name or p.name == "twice"]
    (tmp_path / "bad.txt").write_text("0 1 1 1\n")
    with pytest.raises(ConstraintError):
        R.labels(spark, str(tmp_path / "bad.txt"))


def test_predictions_and_files(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for n in ("a.jpg", "b.jpg"):
        (tmp_path / "img" / n).write_bytes(n.encode())
    found = detect(R.files(spark, str(tmp_path / "img"), content=True), lambda: lambda raw: [{"class_id": 0, "class_name": "bag", "confidence": 0.5, "xyxy": [0.0, 0.0, 1.0, float(len(raw))]}] if raw == b"a.jpg" else [])
    rows = K.detection_rows(found).collect()
    assert len(rows) == 1 and rows[0]["y2"] == 5.0
    assert sorted(r["counts_by_class"]["bag"] for r in K.class_counts(found, ["bag", "can"]).collect()) == [0, 1]
    assert {r["crc32"] for r in R.file_digests(spark, str(tmp_path / "img")).collect()} and R.files(spark, str(tmp_path / "img")).count() == 2
    listed = spark.createDataFrame([("a",), ("c",)], "f string")
    assert {tuple(r) for r in R.listing_mismatch(spark.createDataFrame([("a",), ("b",)], "f string"), listed, "f").collect()} == {("b", "missing_file"), ("c", "unlisted_file")}


def test_records(spark, tmp_path):
    with pytest.raises(ConstraintError):
        K.json_document({"x": float("nan")}, str(tmp_path / "x.json"))
    K.json_document({"x": 1}, str(tmp_path / "x.json"))
    with pytest.raises(FileExistsError):
        K.json_document({}, str(tmp_path / "x.json"))
    assert K.markdown(spark.createDataFrame([("a", 0.5)], "n string, v double"), ["n", "v"]) == "| n | v |\n| --- | --- |\n| a | 0.5000 |\n"
    (tmp_path / "h.csv").write_text("epoch,  metrics/mAP50-95(B)\n1, 0.5\n2, 0.6\n")
    assert R.epoch_history(spark, str(tmp_path / "h.csv")).columns == ["epoch", "metrics/mAP50-95(B)"]
    with pytest.raises(ConstraintError):
        R.one(spark.range(2), "row")


ODD = ["plain", 'a "quoted" } { name', "back\\\\slash\\", "[x] {y} }}", "é } 字 \U0001f600", 'end\\"', "", "line\nbreak } \t"]


@pytest.mark.parametrize("indent", [None, 1])
def test_documents_in_pieces(spark, tmp_path, indent):
    images = [{"id": i, "file_name": ODD[i % len(ODD)] + str(i), "width": 12, "height": i, "extra": {"a": [{"b": "}"}], "c": [[1], ["{"]]}} for i in range(900)]
    notes = [{"id": i, "image_id": i, "category_id": 1, "bbox": [1, 2.5, 3, 4], "segmentation": [[1, 2], [3, 4]]} for i in range(700)]
    doc = {"info": {"year": 1, "by": [{"images": [{"id": 7}]}], "s": '"images": [ {'}, "tags": ["x{", "}"], "images": images, "licenses": [{"id": 5}], "version": 1.5, "annotations": notes, "none": [], "categories": []}
    text = json.dumps(doc, indent=indent, ensure_ascii=False)
    (tmp_path / "a.json").write_text(text + ("\n" if indent else ""), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = R.coco(spark, str(tmp_path / "a.json"))
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 8
        assert {(r["id"], r["file_name"], r["height"]) for r in got["images"].collect()} == {(x["id"], x["file_name"], x["height"]) for x in images}
        assert got["images"].count() == 900 and got["annotations"].count() == 700 and got["categories"].count() == 0
        assert got["annotations"].where("id = 3").first()["bbox"] == [1, 2.5, 3, 4] and got["annotations"].first()["segmentation"] == [[1, 2], [3, 4]]
        for bad in (text[:-1], text[: len(text) // 2], "[]", "", text.replace('"categories"', '"other"'), text.replace('"id": 3,', '"id": "x",', 1)):
            (tmp_path / "bad.json").write_text(bad, encoding="utf-8")
            with pytest.raises(Exception):  # noqa: B017, PT011  a constraint, or Spark's error for a malformed element
                R.coco(spark, str(tmp_path / "bad.json"))["images"].collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_commit_moves_one_folder_however_many_files(monkeypatch, tmp_path):
    from types import SimpleNamespace

    import pyarrow as pa
    from pyarrow import fs

    from gridlark.sources import sinks

    class Counting:
        def __init__(self):
            self.moved, self.local = 0, fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.local, name)

        def move(self, a, b):
            self.moved += 1
            self.local.move(a, b)

    there = Counting()
    monkeypatch.setattr(sinks, "file_system", lambda path: (there, path))
    monkeypatch.setattr(sinks.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    writer, rows = sinks.FileWriter(str(tmp_path / "out"), False), [(f"d/{i}.txt", str(i)) for i in range(40)]
    batch = lambda n: pa.record_batch([list(x) for x in zip(*rows[:n], strict=True)], ["name", "text"])
    writer.write(iter([batch(10)]))  # an attempt that is lost
    done, there.moved = writer.write(iter([batch(40)])), 0
    writer.commit([done])
    assert there.moved == 1 and {p.name: p.read_text() for p in (tmp_path / "out/d").iterdir()} == {f"{i}.txt": str(i) for i in range(40)}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """Six hundred small files, one of them empty, and what readers pass over."""
    at = tmp_path_factory.mktemp("many")
    for i in range(600):
        (at / f"{i} é%20.txt").write_text("" if i == 7 else f"﻿{i % 3} 0.5 0.5 0.25 0.2\r\n\n" + "1 0.1 0.1 0.1 0.1" * (i % 2), encoding="utf-8")
    for hidden in (".hidden.txt", "_hidden.txt"):
        (at / hidden).write_text("x")
    (at / "below").mkdir()
    (at / "below/b.bin").write_bytes(b"\x00\xff")
    return at


def test_labels_of_many_files(spark, many):
    stems = spark.createDataFrame([(f"{i} é%20",) for i in range(600)], "stem string")
    got = R.expected_labels(spark, str(many), stems)
    assert got.count() == 898 and {(r["stem"], r["class_id"]) for r in got.where("w = 0.25").collect()} == {(f"{i} é%20", float(i % 3)) for i in range(600) if i != 7}
    assert not any(p.endswith("%20.txt") for p in got.inputFiles())  # what was read is kept, files are not read again


def test_tally_of_many_files(spark, many):
    got = R.label_tally(spark, str(many))
    assert {r[0]: r[1] for r in got.collect()} == {"0": 200, "1": 199 + 299, "2": 200}
    assert not got.inputFiles()  # no list of the files in the driver


def test_digests_of_many_files(spark, many):
    import hashlib
    import zlib

    got = R.file_digests(spark, str(many))
    want = {(f"file:{p}", hashlib.sha256(p.read_bytes()).hexdigest(), hashlib.md5(p.read_bytes()).hexdigest(), zlib.crc32(p.read_bytes())) for p in many.rglob("*") if p.is_file() and "hidden" not in p.name}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 601
    assert got.rdd.getNumPartitions() == 4 and not got.inputFiles()  # no list of the files in the driver, tasks by share


def test_a_document_is_put_together_by_ranges(spark, monkeypatch, tmp_path):
    from gridlark.sources import sinks

    monkeypatch.setattr(sinks, "RANGE", 1000)
    images = spark.range(50).select("id", F.concat(F.lit("é"), "id").alias("file_name"), F.lit(1).alias("width"), F.lit(2).alias("height"))
    notes = spark.range(3000).select("id", (F.col("id") % 50).alias("image_id"), F.lit(1).alias("category_id")).repartition(7)
    coco_file(images, notes, spark.createDataFrame([(1, "x")], "id int, name string"), str(tmp_path / "a"))
    doc = json.loads((tmp_path / "a").read_text(encoding="utf-8"))
    assert [x["id"] for x in doc["annotations"]] == list(range(3000)) and [x["file_name"] for x in doc["images"]] == [f"é{i}" for i in range(50)] and list(doc) == ["images", "annotations", "categories"]
    assert [p.name for p in tmp_path.iterdir()] == ["a"]
    with pytest.raises(ConstraintError, match="exists"):
        coco_file(images, notes, images.select("id"), str(tmp_path / "a"))


@pytest.mark.parametrize("tail", ["", "\n"])
def test_ranges_of_a_document_begin_anywhere(tail):
    """Cut at any one brace, or at two, a document has the same elements; no range is shuffled."""
    import pyarrow as pa

    from gridlark.sources import coco

    doc = {"info": {"s": '"images": [ {', "b": "x}\\\\"}, "images": [{"id": i, "n": ODD[i], "c": [[1], ["{"], {"d": "}"}]} for i in range(len(ODD))], "annotations": [], "categories": [{"id": 1}]}
    text = (json.dumps(doc, ensure_ascii=False) + tail).encode()
    pieces = text.split(b"}")
    pieces = pieces[:-1] if not pieces[-1] else pieces

    def elements(*cuts):
        blocks, rows = [sum(k >= c for c in cuts) for k in range(len(pieces))], []
        batch = pa.record_batch({"value": pa.array(pieces, pa.binary()), "file": pa.array(["f"] * len(pieces)), "block": pa.array(blocks, pa.int64()), "file_bytes": pa.array([len(text)] * len(pieces), pa.int64())})
        batches = [batch.slice(k, 3) for k in range(0, len(pieces), 3)]
        starts = coco._starts([tuple(r.values()) for b in coco._summed(iter(batches)) for r in b.to_pylist()])
        for b in coco._cut_at(starts)(iter(batches)):
            rows += b.to_pylist()
        out, part = [], b""
        for r in sorted(rows, key=lambda r: r["number"]):
            part += r["text"] if r["body"] is None else r["body"].removeprefix(b", ")
            if r["complete"]:
                out.append((part.removeprefix(b", "), r["objects"], r["lists"]))
                part = b""
        return out, part

    want = elements()
    assert want[1] == tail.encode() and [json.loads(x) for x, o, n in want[0] if (o, n) == (1, 1) and x.startswith(b"{")][-len(ODD) + 1 :] == doc["images"][1:]
    for a in range(1, len(pieces)):
        assert elements(a) == want and elements(a, a + 2) == want


def test_files_of_a_lost_attempt_are_replaced_and_new_ones_not_moved(monkeypatch, tmp_path):
    from types import SimpleNamespace

    import pyarrow as pa

    from gridlark.sources import sinks

    moves = []
    replace = sinks._replace
    monkeypatch.setattr(sinks, "_replace", lambda there, a, b: (moves.append(b), replace(there, a, b)))
    monkeypatch.setattr(sinks.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    writer = sinks.FileWriter(str(tmp_path / "out"), False)
    batch = pa.record_batch([[f"{i % 3}/{i}.txt" for i in range(30)], [f"text {i}" for i in range(30)]], ["name", "text"])
    writer.write(iter([batch.slice(0, 4)]))
    staged = next(p for p in tmp_path.iterdir()) / "files"
    assert moves == []  # new files stay where they were written
    (staged / "0/3.txt").write_text("te")  # half a file
    done = writer.write(iter([batch]))
    assert len(moves) == 4
    writer.commit([done])
    assert {p.name: p.read_text() for p in (tmp_path / "out").rglob("*.txt")} == {f"{i}.txt": f"text {i}" for i in range(30)} and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_lines_end_in_any_way(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\ufeff0 1 1 1 1\r2 1 1 1 1\r\n \t0 1\n\n 3\t1 1\r\r".encode())
    (tmp_path / "b.txt").write_bytes(b"0 1 1 1 1\n\n4")
    got = R.label_tally(spark, str(tmp_path))
    assert {r[0]: r[1] for r in got.collect()} == {"0": 2, "2": 1, "3": 1, "4": 1}
    assert ", 2)" in got._jdf.queryExecution().optimizedPlan().toString()  # no line is split beyond its first word
