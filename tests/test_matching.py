"""Greedy matching, curves, selection, latency."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlark.operators import matching as M
from gridlark.operators import quality, selection

DET = "image_id long, di int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
TRUTH = "image_id long, tj int, class_id int, x1 double, y1 double, x2 double, y2 double"


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inner = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
    return inner / union if union > 0 else 0.0


def plain_match(dets, truths, threshold=0.5):
    """Brute force over one image: di -> tj or None."""
    free, out = {t[1]: t for t in truths}, {}
    for d in sorted(dets, key=lambda d: (-d[3], d[1])):
        best = max(((plain_iou(d[4:], t[3:]), j) for j, t in free.items() if t[2] == d[2]), default=(0.0, None))
        hit = best[1] is not None and best[0] >= threshold
        out[d[1]] = best[1] if hit else None
        if hit:
            del free[best[1]]
    return out


def test_confident_detection_takes_the_truth(spark):
    truths = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 20.0, 20.0, 30.0, 30.0)], TRUTH)
    dets = spark.createDataFrame([(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 0.7, 0.0, 0.0, 10.0, 10.0), (1, 2, 0, 0.9, 20.0, 20.0, 30.0, 30.0)], DET)
    hits = M.matched(dets, truths)
    assert {r["di"]: r["tj"] for r in hits.collect()} == {0: 0, 1: None, 2: None}
    counts = M.per_image_counts(hits, truths, spark.createDataFrame([(1,), (2,)], "image_id long")).orderBy("image_id").collect()
    assert [tuple(r) for r in counts] == [(1, 1, 2, 1), (2, 0, 0, 0)]
    by_class = {r["class_id"]: (r["tp"], r["fp"], r["fn"]) for r in M.class_scores(hits, truths).collect()}
    assert by_class == {0: (1, 2, 0), 1: (0, 0, 1)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_matching_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    box = lambda: (x := rng.randint(0, 8) * 2.0, y := rng.randint(0, 8) * 2.0, x + rng.choice([4.0, 6.0]), y + rng.choice([4.0, 6.0]))
    truths = [(i, j, rng.randint(0, 1), *box()) for i in range(6) for j in range(rng.randint(0, 8))]
    dets = [(i, j, rng.randint(0, 1), rng.choice([0.3, 0.5, 0.5, 0.9]), *box()) for i in range(6) for j in range(rng.randint(1, 12))]
    t = spark.createDataFrame(truths, TRUTH) if truths else spark.createDataFrame([], TRUTH)
    got = {(r["image_id"], r["di"]): r["tj"] for r in M.matched(spark.createDataFrame(dets, DET), t, 0.3).collect()}
    want = {(i, k): v for i in range(6) for k, v in plain_match([d for d in dets if d[0] == i], [x for x in truths if x[0] == i], 0.3).items()}
    assert got == want


def test_curve_equals_matching_again_at_each_value(spark):
    rng = random.Random(3)
    box = lambda: (x := rng.randint(0, 6) * 2.0, y := rng.randint(0, 6) * 2.0, x + 5.0, y + 5.0)
    truths = [(i, j, 0, *box()) for i in range(10) for j in range(5)]
    dets = [(i, j, 0, rng.choice([0.1, 0.4, 0.8]), *box()) for i in range(10) for j in range(7)]
    t, d = spark.createDataFrame(truths, TRUTH), spark.createDataFrame(dets, DET)
    curve = M.confidence_curve(M.matched(d, t), t, [0.8, 0.1, 0.4, 0.4])
    rows = {r["conf"]: (r["tp"], r["fp"], r["fn"]) for r in curve.collect()}
    assert len(rows) == 3
    for c in rows:
        tp = sum(v is not None for i in range(10) for v in plain_match([x for x in dets if x[0] == i and x[3] >= c], [x for x in truths if x[0] == i]).values())
        assert rows[c] == (tp, sum(x[3] >= c for x in dets) - tp, len(truths) - tp)
    with pytest.raises(quality.ConstraintError):
        M.confidence_curve(M.matched(d, t), t, [])


def test_threshold_ties_prefer_the_higher_confidence(spark):
    curve = spark.createDataFrame([(c, 1, 0, 0, 1.0, 1.0, 1.0) for c in (0.1, 0.8, 0.4)], "conf double, tp long, fp long, fn long, precision double, recall double, f1 double")
    assert M.best_threshold(curve).first()["conf"] == 0.8


def test_error_breakdown_has_all_bins(spark):
    truths = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0)], TRUTH)
    dets = spark.createDataFrame([(1, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0)], DET)
    imgs = spark.createDataFrame([(1, 100, 50), (2, 100, 50)], "image_id long, width int, height int")
    hits = M.matched(dets, truths)
    assert {r["overlap"]: r["n"] for r in M.fp_taxonomy(hits, dets, truths, 0.5).collect()} == {"overlap_lt_0.1": 1, "overlap_0.1_to_match_iou": 0, "duplicate_or_assignment_conflict": 1}
    assert {r["size_bin"]: (r["objects"], r["found"], r["recall"]) for r in M.recall_by_size(hits, truths, imgs, 0.5, 100).collect()} == {"short_side_lt_8px": (0, 0, None), "short_side_8_to_16px": (1, 0, 0.0), "short_side_ge_16px": (0, 0, None)}
    rows = {r["image_id"]: r for r in M.error_rows(hits, dets, truths, imgs, 0.5).collect()}
    assert rows[1]["truth"][0]["xyxy"] == [0, 0, 10, 10] and rows[2]["truth"] is None


def test_selection(spark):
    rows = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "name string, mAP50_95 double")
    best = selection.best_model(rows)
    assert best.first()["name"] == "a"
    frozen = selection.frozen(best, 0.4, "id-1", imgsz=640)
    selection.held_out_gate(frozen, "id-1")
    with pytest.raises(quality.ConstraintError, match="dataset"):
        selection.held_out_gate(frozen, "id-2")
    with pytest.raises(quality.ConstraintError, match="changed"):
        selection.held_out_gate(frozen.withColumn("conf", F.lit(0.3)), "id-1")


def test_runs_must_agree(spark):
    runs = spark.createDataFrame([("r1", 1, 0.5), ("r2", 1, 0.6)], "name string, seed int, `metrics/mAP50-95(B)` double")
    assert selection.compare_runs(runs, ["seed"]).columns == ["name", "seed", "mAP50_95"]
    for other in (runs.withColumn("seed", F.when(F.col("name") == "r1", 2).otherwise(F.col("seed"))), runs.limit(1)):
        with pytest.raises(quality.ConstraintError):
            selection.compare_runs(other, ["seed"])
    lacking = runs.withColumn("seed", F.lit(None).cast("int"))
    assert quality.differing_columns(lacking, ["seed"], ["seed"]) == ["seed"]


def test_latency(spark):
    df = spark.createDataFrame([("m", float(x), 1.0) for x in range(1, 6)], "model string, wall_ms double, inference double")
    assert tuple(selection.latency_stats(df).first()) == ("m", 5, 3.0, 3.0, 4.8)
    assert selection.stage_stats(df, ["wall_ms", "inference"]).count() == 2


def test_average_precision_equals_brute_force(spark):
    rng = random.Random(8)
    truths, dets = [], []
    for image in range(12):
        for j in range(rng.randint(0, 5)):
            x, y = rng.randint(0, 60), rng.randint(0, 60)
            truths.append((image, j, rng.randint(0, 2), x * 1.0, y * 1.0, x + 20.0, y + 20.0))
        for i in range(rng.randint(0, 6)):
            near = [t for t in truths if t[0] == image]
            x, y = rng.choice(near)[3:5] if near else (0.0, 0.0)
            x += rng.randint(0, 8)
            dets.append((image, i, rng.randint(0, 2), rng.randint(0, 9) / 10, x, y, x + 20.0, y + 20.0))
    truths.append((0, 9, 7, 0.0, 0.0, 5.0, 5.0))  # a class without detections
    d, t = spark.createDataFrame(dets, DET), spark.createDataFrame(truths, TRUTH)

    def plain(threshold):
        taken = {(k, i): j for k in range(12) for i, j in plain_match([x for x in dets if x[0] == k], [x for x in truths if x[0] == k], threshold).items()}
        out = {}
        for c in {x[2] for x in truths}:
            n, own = sum(x[2] == c for x in truths), [x for x in dets if x[2] == c]
            points = []
            for conf in {x[3] for x in own}:
                kept = [x for x in own if x[3] >= conf]
                tp = sum(taken[x[0], x[1]] is not None for x in kept)
                points.append((tp, tp / len(kept)))
            out[c] = sum(max((p for tp, p in points if 100 * tp >= k * n), default=0) for k in range(101)) / 101
        return out

    for threshold in (0.5, 0.75):
        got = {r["class_id"]: r["ap"] for r in M.average_precision(M.matched(d, t, threshold), t).collect()}
        assert got == pytest.approx(plain(threshold)) and got[7] == 0
    means = {r["threshold"]: (r["classes"], r["map"]) for r in M.mean_average_precision(d, t, [0.5, 0.75]).collect()}
    assert means == {x: (4, pytest.approx(sum(plain(x).values()) / 4)) for x in (0.5, 0.75)}
    assert M.average_precision(M.matched(d.limit(0), t), t).where("ap > 0").isEmpty() and M.average_precision(M.matched(d, t), t.limit(0)).isEmpty()


def crowd(seed, n, spread, classes=2):
    """One image full of boxes, many of them stacked."""
    rng = random.Random(seed)
    spots = [(rng.uniform(-spread, spread), rng.uniform(-spread, spread)) for _ in range(n // 6)]

    def box():
        x, y = rng.choice(spots)
        x, y, s = x + rng.randint(0, 3), y + rng.randint(0, 3), rng.choice([8.0, 10.0, 10.0, 200.0 if rng.random() < 0.01 else 9.0])
        return x, y, x + s, y + s

    truths = [(1, j, rng.randrange(classes), *box()) for j in range(n)]
    dets = [(1, j, rng.randrange(classes), rng.choice([0.2, 0.5, 0.5, 0.7, 0.9]), *box()) for j in range(n)]
    return dets, truths


def test_grid_cells_lose_and_repeat_no_pair(spark):
    dets, truths = crowd(4, 700, 90)
    dets += [(1, 9001, 0, 0.5, 0.0, 0.0, 0.0, 5.0), (1, 9002, 0, 0.5, float("nan"), 0.0, 1.0, 5.0), (1, 9003, 0, 0.5, 0.0, 0.0, float("inf"), 5.0)]
    d, t = spark.createDataFrame(dets, DET), spark.createDataFrame(truths, TRUTH)
    for same in (True, False):
        rows = M.iou_pairs(d, t, same, dense=100).collect()
        got = {(r["di"], r["tj"]): r["iou"] for r in rows}
        want = {(x[1], y[1]): v for x in dets[:700] for y in truths if (not same or x[2] == y[2]) and (v := plain_iou(x[4:], y[3:])) > 0}
        assert len(rows) == len(got) == len(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_dense_groups_settle_as_the_fold_does(spark):
    dets, truths = crowd(5, 1500, 120)
    d, t = spark.createDataFrame(dets, DET), spark.createDataFrame(truths, TRUTH)
    want = plain_match(dets, truths, 0.4)
    assert {r["di"]: r["tj"] for r in M.matched(d, t, 0.4, dense=50).collect()} == want
    assert {r["di"]: r["tj"] for r in M.matched(d, t, 0.4, dense=10**6).collect()} == want
    for limit in (0.4, 0.75):
        rows = M.matched_at(d, t, [0.75, 0.4]).where(F.col("threshold") == limit).collect()
        assert {r["di"]: r["tj"] for r in rows} == plain_match(dets, truths, limit)
    for bad in (0.0, 1.5):
        with pytest.raises(quality.ConstraintError):
            M.matched(d, t, bad)


def test_dense_image_of_50000_boxes(spark):
    rng = random.Random(6)
    truths = [(1, j, 0, x := rng.randrange(2000) * 5.0, y := rng.randrange(200) * 5.0, x + 10.0, y + 10.0) for j in range(25_000)]
    dets = [(1, j, 0, rng.randrange(100) / 100, x := rng.randrange(2000) * 5.0 + 1, y := rng.randrange(200) * 5.0, x + 10.0, y + 10.0) for j in range(25_000)]
    by_cell = {}
    for q in truths:
        by_cell.setdefault((int(q[3] // 10), int(q[4] // 10)), []).append(q)
    free, want = set(range(len(truths))), {}
    for q in sorted(dets, key=lambda q: (-q[3], q[1])):
        cx, cy = int(q[4] // 10), int(q[5] // 10)
        near = [x for i in (-1, 0, 1) for j in (-1, 0, 1) for x in by_cell.get((cx + i, cy + j), ()) if x[1] in free]
        best = max(((plain_iou(q[4:], x[3:]), x[1]) for x in near), default=(0.0, None))
        want[q[1]] = best[1] if best[0] >= 0.3 else None
        free.discard(want[q[1]])
    got = {r["di"]: r["tj"] for r in M.matched(spark.createDataFrame(dets, DET), spark.createDataFrame(truths, TRUTH), 0.3).collect()}
    assert got == want


def _crowd(spark, n, seed=5):
    rng = random.Random(seed)
    box = lambda: (x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + 10.0, y + 10.0)
    truths = [(1, j, j % 2, *box()) for j in range(n)]
    dets = [(1, j, t[2], rng.random(), t[3] + rng.uniform(0, 4), t[4], t[5] + 1, t[6]) for j, t in enumerate(truths)]
    return dets, truths, spark.createDataFrame(dets, DET), spark.createDataFrame(truths, TRUTH)


def test_cells_copy_a_box_about_twice_and_without_the_grid(spark):
    _, truths, _, t = _crowd(spark, 900)
    cells = M._in_cells(t, M._grids(t, 100))
    assert set(cells.columns) == {*t.columns, "cell_x", "cell_y", "first_x", "first_y"} and cells.count() <= 2.5 * len(truths)
    assert cells.where("first_x and first_y").select("tj").distinct().count() == cells.where("first_x and first_y").count() == len(truths)


def test_dense_matching_finds_its_pairs_once(spark):
    dets, truths, d, t = _crowd(spark, 300)
    hits = M.matched(d, t, 0.4, dense=160)
    assert {r["di"]: r["tj"] for r in hits.collect()} == plain_match(dets, truths, 0.4)
    assert "cell_x" not in hits._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", [1, 2, 7, 100000])
def test_detections_are_settled_by_batch_as_one_at_a_time(size):
    """Groups, detections and contested truths that lie across batches, at several thresholds."""
    import pyarrow as pa

    draw, pairs = random.Random(5), []
    for image in range(40):
        for cls in range(draw.choice([1, 3])):
            for di in range(draw.randrange(1, 9)):
                conf = draw.choice([0.1, 0.5, 0.9, None])
                found = draw.sample(range(draw.choice([3, 40])), draw.choice([0, 1, 1, 2, 3])) or [None]
                pairs += [(f"i{image:02d}", cls, di, conf, tj, None if tj is None else draw.choice([0.5, 0.6, 0.6, 0.9])) for tj in found]
    pairs.sort(key=lambda p: (p[0], p[1], p[3] is not None, -(p[3] or 0), p[2], -(p[5] or 0), -(p[4] or 0)))
    limits, want, used = [0.5, 0.6, 0.9], {}, {}
    for image, cls, di, conf, tj, overlap in pairs:
        got = want.setdefault((image, cls, di, conf), [None] * 3)
        for k, limit in enumerate(limits):
            if tj is not None and got[k] is None and overlap >= limit and (image, cls, k, tj) not in used:
                got[k] = tj
                used[image, cls, k, tj] = di
    kinds = pa.schema([("image_id", pa.string()), ("class_id", pa.int32()), ("di", pa.int32()), ("confidence", pa.float64()), ("tj", pa.int32()), ("iou", pa.float64())])
    whole = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*pairs, strict=True), kinds, strict=True)], schema=kinds)
    out = [r for b in M._in_turn(limits)(whole.slice(k, size) for k in range(0, len(pairs), size)) for r in b.to_pylist()]
    assert {(r["image_id"], r["class_id"], r["di"], r["confidence"]): r["tjs"] for r in out} == want and len(out) == len(want)
    assert list(M._in_turn(limits)(iter([whole.slice(0, 0)]))) == []


def test_detections_without_rivals_are_not_gone_through():
    import numpy as np
    import pyarrow as pa

    n = 3000  # a detection and a truth of its own in each group; only the first and the last group may go on
    cols = {"image_id": np.arange(n), "class_id": np.zeros(n, np.int32), "di": np.zeros(n, np.int32), "confidence": np.full(n, 0.5), "tj": np.ones(n, np.int32), "iou": np.linspace(0.4, 1, n)}
    seen = []

    class Counted(set):
        def add(self, x):
            seen.append(x)
            super().add(x)

    batch, _, _ = M._taken(pa.record_batch(cols), [0.5], (0, 0), [Counted()])
    assert [r is not None for r in batch.column("tjs").flatten().to_pylist()] == (cols["iou"] >= 0.5).tolist() and len(seen) <= 1
