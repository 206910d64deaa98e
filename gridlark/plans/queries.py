"""The library's operators bound to the driver's tables, and their SQL.

``register`` keeps a query's two forms side by side; ``oracle.py`` hands out the
SQL half; ``checks.py`` adds the queries of constraints and records.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.functions import names as N
from gridlark.operators import curate, matching, profile, quality, selection, tiling
from gridlark.plans import standins as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None, *uses: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = S.with_sql(sql, *uses)
        return f

    return keep


def _classes(spark):
    return spark.createDataFrame([(0, "A"), (1, "N"), (2, "R"), (3, "unused")], "class_id int, name string")


NAMES = "(VALUES (0, 'A'), (1, 'N'), (2, 'R'), (3, 'unused')) c(class_id, name)"

# counts and roll-ups -------------------------------------------------------


@register(f"""SELECT c.class_id, c.name, count(b.image_id) AS objects, count(DISTINCT b.image_id) AS images
FROM {NAMES} LEFT JOIN fx_box b ON b.class_id = c.class_id GROUP BY c.class_id, c.name""", "fx_box")
def class_object_counts(spark, d):
    return profile.class_counts(S.boxes(spark, d), _classes(spark))


@register("SELECT image_id FROM fx_image WHERE image_id NOT IN (SELECT doc_id FROM labels)", "fx_image")
def images_without_objects(spark, d):
    labelled = S.table(spark, d, "labels").select(F.col("doc_id").alias("image_id"))
    return profile.objects_per_image(S.images(spark, d).select("image_id"), labelled).where("objects = 0").select("image_id")


@register("SELECT group_id, count(*) AS n FROM fx_image GROUP BY group_id ORDER BY n DESC, group_id", "fx_image")
def group_sizes(spark, d):
    return profile.counts_by(S.images(spark, d), "group_id").orderBy(F.desc("n"), "group_id")


@register("""SELECT CASE WHEN n_chars < 100 THEN 'missing_or_corrupt' WHEN n_chars % 11 = 0 THEN 'dimension_mismatch' WHEN n_chars % 7 = 0 THEN 'oriented_tiff'
WHEN n_chars % 5 = 0 THEN 'exif_orientation' WHEN n_chars % 3 + 1 > 1 THEN 'multi_frame' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1""")
def status_counts(spark, d):
    c = F.col("n_chars")
    return profile.counts_by(S.table(spark, d, "documents"), N.image_status(c < 100, c % 11 == 0, c % 7 == 0, c % 5 == 0, c % 3 + 1).alias("status"))


TILES = """SELECT CASE l_linestatus WHEN 'O' THEN 'train' ELSE 'val' END AS split, l_orderkey AS image_id, (l_linenumber % 3)::BIGINT AS objects FROM lineitem"""


@register(f"""SELECT split, count(*) AS images, sum(objects)::BIGINT AS objects, count(*) FILTER (WHERE objects = 0) AS negative_images, count(DISTINCT image_id) AS source_images
FROM ({TILES}) GROUP BY ROLLUP (split)""")
def split_rollup(spark, d):
    li = S.table(spark, d, "lineitem")
    split = F.when(F.col("l_linestatus") == "O", "train").otherwise("val")
    return profile.split_rollup(li.select(split.alias("split"), F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 3).cast("long").alias("objects")))


@register("""SELECT l_linestatus AS split, count(*) FILTER (WHERE l_returnflag = 'A') AS "0", count(*) FILTER (WHERE l_returnflag = 'N') AS "1", count(*) FILTER (WHERE l_returnflag = 'R') AS "2"
FROM lineitem GROUP BY 1""")
def split_class_counts(spark, d):
    li = S.table(spark, d, "lineitem")
    cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return profile.split_class_counts(li.select(F.col("l_linestatus").alias("split"), cls.alias("class_id")), [0, 1, 2])


# boxes ---------------------------------------------------------------------

CLIP = "greatest(0.0::DOUBLE, x) AS x1, greatest(0.0::DOUBLE, y) AS y1, least(120.0::DOUBLE, x + w) AS x2, least(100.0::DOUBLE, y + h) AS y2"


def _clipped(spark, d):
    b = S.boxes(spark, d).select("image_id", "idx", "class_id", (F.col("x") - 5).alias("x"), (F.col("y") - 3).alias("y"), "w", "h")
    given = tuple(F.col(c) for c in "xywh")
    corners = B.clip(*given, F.lit(120), F.lit(100))
    named = [c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)]
    return b.select("image_id", "idx", "class_id", *named, B.was_clipped(corners, *given).cast("int").alias("clipped")).where(B.has_area(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))


CLIPPED = f"""SELECT image_id, idx, class_id, x1, y1, x2, y2, (x1 <> x OR y1 <> y OR x2 <> x + w OR y2 <> y + h)::INTEGER AS clipped
FROM (SELECT image_id, idx, class_id, x, y, w, h, {CLIP} FROM (SELECT image_id, idx, class_id, x - 5 AS x, y - 3 AS y, w, h FROM fx_box)) WHERE x2 > x1 AND y2 > y1"""


@register(CLIPPED, "fx_box")
def clip_boxes(spark, d):
    return _clipped(spark, d)


@register(f"""SELECT image_id, idx, class_id, (x1 + x2) / 240 AS cx, (y1 + y2) / 200 AS cy, (x2 - x1) / 120 AS w, (y2 - y1) / 100 AS h FROM ({CLIPPED})""", "fx_box")
def yolo_normalise(spark, d):
    parts = B.normalised(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(120), F.lit(100))
    return _clipped(spark, d).select("image_id", "idx", "class_id", *[p.alias(n) for p, n in zip(parts, ("cx", "cy", "w", "h"), strict=True)])


@register(f"""SELECT image_id, idx, class_id, greatest(0.0::DOUBLE, (cx - w / 2) * 120) AS x1, greatest(0.0::DOUBLE, (cy - h / 2) * 100) AS y1,
least(120.0::DOUBLE, (cx + w / 2) * 120) AS x2, least(100.0::DOUBLE, (cy + h / 2) * 100) AS y2
FROM (SELECT image_id, idx, class_id, (x1 + x2) / 240 AS cx, (y1 + y2) / 200 AS cy, (x2 - x1) / 120 AS w, (y2 - y1) / 100 AS h FROM ({CLIPPED}))""", "fx_box")
def yolo_inverse(spark, d):
    parts = B.denormalised(*[F.col(c) for c in ("cx", "cy", "w", "h")], F.lit(120), F.lit(100))
    return yolo_normalise(spark, d).select("image_id", "idx", "class_id", *[p.alias(n) for p, n in zip(parts, ("x1", "y1", "x2", "y2"), strict=True)])


@register("""SELECT image_id, idx, w * h / (120 * 100) AS relative_area, least(w, h) * 640 / 120 AS short_side, count(*) FILTER (WHERE least(w, h) * 640 / 120 < 40) OVER () AS small FROM fx_box""", "fx_box")
def relative_area_and_short_side(spark, d):
    b, w, h, wide, high = S.boxes(spark, d), F.col("w"), F.col("h"), F.lit(120), F.lit(100)
    side = B.short_side(w, h, wide, high)
    small = b.agg(F.count_if(side < 40).alias("small"))
    return b.select("image_id", "idx", B.relative_area(w, h, wide, high).alias("relative_area"), side.alias("short_side")).crossJoin(F.broadcast(small))  # one row


def _annotations(spark, d):
    """Line items as annotations with faults: foreign keys, sizes, borders."""
    b = S.boxes(spark, d)
    w = F.when(F.col("idx") % 11 == 0, F.lit(-1.0)).when(F.col("idx") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("w"))
    return b.select((F.col("image_id") * 100 + F.col("idx")).alias("id"), F.when(F.col("idx") % 17 == 0, F.lit(-1).cast("long")).otherwise(F.col("image_id")).alias("image_id"), F.col("class_id").alias("category_id"), F.array("x", "y", w, "h").alias("bbox"))


ANN = """fx_ann AS (SELECT image_id * 100 + idx AS id, CASE WHEN idx % 17 = 0 THEN -1 ELSE image_id END AS image_id, class_id AS category_id, x, y,
CASE WHEN idx % 11 = 0 THEN -1.0::DOUBLE WHEN idx % 13 = 0 THEN 'nan'::DOUBLE ELSE w END AS w, h FROM fx_box)"""


@register(f"""SELECT issue, count(*) AS n FROM (WITH {ANN} SELECT CASE WHEN image_id = -1 OR category_id = 2 THEN 'unknown image or category' WHEN isnan(w) THEN 'invalid numeric bbox'
WHEN w <= 0 OR h <= 0 THEN 'nonpositive dimensions' WHEN x < 0 OR y < 0 OR x + w > 121 OR y + h > 101 THEN 'bbox exceeds image' END AS issue FROM fx_ann) GROUP BY issue""", "fx_box")
def box_issues_quarantine(spark, d):
    imgs = S.box_images(spark, d).withColumnRenamed("image_id", "id")
    cats = spark.createDataFrame([(0, "A"), (1, "N")], "id int, name string")
    return profile.counts_by(quality.annotation_issues(_annotations(spark, d), imgs, cats), "issue")


@register(f"SELECT id, image_id FROM (WITH {ANN} SELECT id, image_id FROM fx_ann WHERE image_id NOT IN (SELECT image_id FROM fx_box))", "fx_box")
def fk_violations(spark, d):
    return quality.missing_keys(_annotations(spark, d), S.box_images(spark, d), "image_id").select("id", "image_id")


@register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return quality.duplicate_keys(S.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


# names, categories, scales ---------------------------------------------------

FILE = """CASE doc_id % 6 WHEN 0 THEN 'BATCH_d0' || (doc_id % 9) || '_img_' || doc_id || '.jpg' WHEN 1 THEN 'GOPR' || doc_id || '.JPG' WHEN 2 THEN 'x/dji_' || doc_id || '.png'
WHEN 3 THEN 'photo_' || doc_id || '.jpg' WHEN 4 THEN 'batch_1/' || doc_id || '.jpg' ELSE 'batch_0' || (doc_id % 4) || '_frame_' || doc_id || '.jpg' END"""


def _files(spark, d):
    i = F.col("doc_id")
    text = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    s = i.cast("string")
    name = (
        F.when(i % 6 == 0, text("BATCH_d0", (i % 9).cast("string"), "_img_", s, ".jpg")).when(i % 6 == 1, text("GOPR", s, ".JPG")).when(i % 6 == 2, text("x/dji_", s, ".png"))
        .when(i % 6 == 3, text("photo_", s, ".jpg")).when(i % 6 == 4, text("batch_1/", s, ".jpg")).otherwise(text("batch_0", (i % 4).cast("string"), "_frame_", s, ".jpg"))
    )
    return S.table(spark, d, "documents").select(i.alias("image_id"), name.alias("file_name"))


@register(f"""SELECT image_id, file_name, CASE WHEN m <> '' THEN m WHEN starts_with(stem, 'gopr') THEN 'unverified_gopro' WHEN starts_with(stem, 'dji') THEN 'unverified_dji'
WHEN starts_with(stem, 'photo_') THEN 'unverified_photo' WHEN starts_with(stem, 'camera') THEN 'unverified_camera' ELSE 'unverified_other' END AS grp, split_part(file_name, '/', 1) AS folder
FROM (SELECT *, regexp_extract(stem, '^(batch_[a-z]?\\d+)_(?:img|frame)_?\\d+$', 1) AS m FROM (
SELECT doc_id AS image_id, {FILE} AS file_name, lower(regexp_replace(regexp_replace({FILE}, '^.*/', ''), '\\.[^.]*$', '')) AS stem FROM documents))""")
def filename_group(spark, d):
    return _files(spark, d).select("image_id", "file_name", N.sequence_group(F.col("file_name")).alias("grp"), N.first_folder(F.col("file_name")).alias("folder"))


@register("SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 0 END::INTEGER AS category_id FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def category_remap(spark, d):
    a = S.table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("category_id"))
    return curate.remapped(a, spark.createDataFrame([("A", 2), ("N", 0)], "category_id string, target int"))


@register("SELECT (dense_rank() OVER (ORDER BY p_size) - 1)::INTEGER AS id, p_size AS source_id FROM (SELECT DISTINCT p_size FROM part WHERE p_size % 3 = 0)")
def category_reindex(spark, d):
    return curate.reindexed(S.table(spark, d, "part").where("p_size % 3 = 0").select(F.col("p_size").alias("id")).distinct())


@register("SELECT image_id, group_id FROM fx_image WHERE image_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "fx_image")
def positives_semi(spark, d):
    return S.images(spark, d).join(S.table(spark, d, "labels").where("quality = 1"), F.col("image_id") == F.col("doc_id"), "left_semi").select("image_id", "group_id")


@register("SELECT image_id, group_id FROM fx_image WHERE image_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)", "fx_image")
def negatives_anti(spark, d):
    return S.images(spark, d).join(S.table(spark, d, "labels").where("quality = 1"), F.col("image_id") == F.col("doc_id"), "left_anti").select("image_id", "group_id")


SCALE = "SELECT DISTINCT image_id, (1 + image_id % 4) / 4.0::DOUBLE AS sx, (1 + image_id % 2) / 2.0::DOUBLE AS sy FROM fx_box"


def _scales(spark, d):
    i = F.col("image_id")
    return S.box_images(spark, d).select(i, ((1 + i % 4) / F.lit(4.0)).alias("sx"), ((1 + i % 2) / F.lit(2.0)).alias("sy"))


def _boxes_with_area(spark, d):
    polygon = F.array(F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2"))
    return S.boxes(spark, d).select("image_id", "idx", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), polygon.alias("segmentation"))


@register(f"SELECT b.image_id, idx, x * sx AS x, y * sy AS y, w * sx AS w, h * sy AS h, w * h * sx * sy AS area FROM fx_box b JOIN ({SCALE}) s ON b.image_id = s.image_id", "fx_box")
def rescale_boxes(spark, d):
    return curate.rescaled(_boxes_with_area(spark, d), _scales(spark, d)).select("image_id", "idx", *[F.get("bbox", i).alias(n) for i, n in enumerate("xywh")], "area")


@register(f"""SELECT b.image_id, idx, x1 * sx AS p0, y1 * sy AS p1, x2 * sx AS p2, y1 * sy AS p3, x2 * sx AS p4, y2 * sy AS p5, x1 * sx AS p6, y2 * sy AS p7
FROM fx_box b JOIN ({SCALE}) s ON b.image_id = s.image_id""", "fx_box")
def rescale_polygons(spark, d):
    return curate.rescaled(_boxes_with_area(spark, d), _scales(spark, d)).select("image_id", "idx", *[F.get(F.get("segmentation", 0), i).alias(f"p{i}") for i in range(8)])


# duplicates, groups, splits, samples -----------------------------------------

FIRST = "SELECT image_id, group_id, sha256, min(image_id) OVER (PARTITION BY sha256) AS original FROM fx_image"


@register(f"SELECT image_id, original, CASE WHEN original <> image_id THEN original END AS duplicate_of FROM ({FIRST})", "fx_image")
def exact_dedup(spark, d):
    return curate.exact_dedup(S.images(spark, d)).select("image_id", "original", "duplicate_of")


@register(f"SELECT image_id, group_id FROM ({FIRST}) WHERE original = image_id", "fx_image")
def representatives(spark, d):
    return curate.representatives(S.images(spark, d)).select("image_id", "group_id")


@register("""SELECT sha256, count(*) AS copies, count(DISTINCT k) AS versions FROM (SELECT sha256, CASE WHEN image_id % 2 = 0 THEN 'box' ELSE '' END AS k FROM fx_image)
GROUP BY sha256 HAVING count(DISTINCT k) > 1""", "fx_image")
def duplicate_conflicts(spark, d):
    imgs = S.images(spark, d)
    one = F.lit(1.0)
    return curate.duplicate_conflicts(imgs, imgs.where("image_id % 2 = 0").select("image_id", F.lit(0).alias("class_id"), (one - 1).alias("x1"), (one - 1).alias("y1"), one.alias("x2"), one.alias("y2")))


LINKED = """fx_reach AS (SELECT DISTINCT group_id, group_id AS root FROM fx_image UNION
SELECT b.group_id, r.root FROM fx_reach r JOIN fx_image a ON a.group_id = r.group_id JOIN fx_image b ON a.sha256 = b.sha256)"""


@register(f"SELECT * FROM (WITH RECURSIVE {LINKED} SELECT group_id, min(root) AS root FROM fx_reach GROUP BY group_id)", "fx_image")
def group_components(spark, d):
    return curate.group_components(S.images(spark, d))


SPLIT = f"""WITH RECURSIVE {LINKED}, comp AS (SELECT group_id, min(root) AS root FROM fx_reach GROUP BY group_id),
n AS (SELECT root, count(*) AS n FROM ({FIRST}) i JOIN comp c ON i.group_id = c.group_id WHERE original = image_id GROUP BY root),
run AS (SELECT root, n, row_number() OVER w - 1 AS k, sum(n) OVER w - n AS before, sum(n) OVER () AS total, count(*) OVER () AS groups FROM n WINDOW w AS (ORDER BY sha256('42:' || root))),
a AS (SELECT arg_min(k, struct_pack(d := abs(before - total * 0.7::DOUBLE), k := k)) AS a FROM run WHERE k >= 1 AND k < groups - 1),
b AS (SELECT arg_min(k, struct_pack(d := abs(before - total * 0.9::DOUBLE), k := k)) AS b FROM run, a WHERE k > a)
SELECT root, n, CASE WHEN k < a THEN 'train' WHEN k < b THEN 'val' ELSE 'test' END AS split FROM run, a, b"""


@register(f"SELECT * FROM ({SPLIT})", "fx_image")
def group_split_cumulative(spark, d):
    imgs = S.images(spark, d)
    return curate.split_groups(imgs, curate.group_components(imgs))


@register("""SELECT image_id, group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY image_id) AS t, min(image_id) OVER (PARTITION BY group_id) AS f FROM fx_image)
ORDER BY t, f LIMIT 150""", "fx_image")
def round_robin_sample(spark, d):
    return curate.round_robin(S.images(spark, d), "group_id", "image_id", 150).select("image_id", "group_id")


@register("""SELECT image_id, group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sha256('42:' || image_id), image_id) AS t FROM fx_image
WHERE image_id NOT IN (SELECT doc_id FROM labels)) ORDER BY t, group_id LIMIT 120""", "fx_image")
def background_sample(spark, d):
    return curate.background_sample(S.images(spark, d).join(S.table(spark, d, "labels"), F.col("image_id") == F.col("doc_id"), "left_anti"), "group_id", 120).select("image_id", "group_id")


@register("SELECT image_id FROM fx_image ORDER BY sha256('42:' || image_id), image_id LIMIT 40", "fx_image")
def seeded_sample(spark, d):
    return curate.seeded_sample(S.images(spark, d), "image_id", 40).select("image_id")


@register("""SELECT image_id, place::INTEGER AS place FROM (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS place, count(*) OVER () AS n FROM fx_image)
WHERE place IN (SELECT i * (n - 1) // 19 FROM range(20) t(i))""", "fx_image")
def linspace_sample(spark, d):
    return curate.linspace_sample(S.images(spark, d).select("image_id"), "image_id", 20)


@register("""SELECT image_id, source FROM (SELECT doc_id AS image_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY source) // 8) AS s FROM documents)
WHERE i % s = 0 AND i // s < 8""")
def contact_sheet_sample(spark, d):
    return curate.contact_sheet(S.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), "source"), "source", "image_id")


# tiles -------------------------------------------------------------------------

GRID = """fx_tile AS (SELECT image_id, (r * 3 + c)::INTEGER AS tile, l::INTEGER AS "left", t::INTEGER AS top, least(120, l + 48)::INTEGER AS "right", least(100, t + 48)::INTEGER AS bottom
FROM fx_box_image, (VALUES (0, 0), (1, 36), (2, 72)) x(c, l), (VALUES (0, 0), (1, 36), (2, 52)) y(r, t))"""
PARTS = """fx_part AS (SELECT g.image_id, tile, idx, class_id, greatest(x1, "left") - "left" AS x1, greatest(y1, top) - top AS y1, least(x2, "right") - "left" AS x2, least(y2, bottom) - top AS y2
FROM fx_tile g JOIN fx_box b ON g.image_id = b.image_id WHERE least(x2, "right") > greatest(x1, "left") AND least(y2, bottom) > greatest(y1, top))"""


@register(f"SELECT * FROM (WITH {GRID} SELECT * FROM fx_tile)", "fx_box_image")
def tile_grid(spark, d):
    return tiling.tile_grid(S.box_images(spark, d), 48, 0.25)


def _parts(spark, d):
    return tiling.boxes_on_grid(S.box_images(spark, d), S.boxes(spark, d).select("image_id", "idx", "class_id", "x1", "y1", "x2", "y2"), 48, 0.25)


@register(f"SELECT * FROM (WITH {GRID}, {PARTS} SELECT * FROM fx_part)", "fx_box", "fx_box_image")
def box_tile_intersection(spark, d):
    return _parts(spark, d)


@register(f"SELECT * FROM (WITH {GRID}, {PARTS} SELECT g.image_id, g.tile, count(p.idx) AS objects FROM fx_tile g LEFT JOIN fx_part p ON g.image_id = p.image_id AND g.tile = p.tile GROUP BY 1, 2)", "fx_box", "fx_box_image")
def tile_object_counts(spark, d):
    return tiling.tile_counts(tile_grid(spark, d), _parts(spark, d)).select("image_id", "tile", "objects")


# matching ------------------------------------------------------------------------

RATES = """CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS "precision", CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS recall"""
SCORED = f"""SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0::DOUBLE END AS f1 FROM (SELECT *, {RATES} FROM"""


def _hits(spark, d):
    return matching.matched(*S.sides(spark, d))


@register("SELECT * FROM fx_pair WHERE iou > 0", "fx_pair")
def iou_pairs(spark, d):
    return matching.iou_pairs(*S.sides(spark, d))


def _scenes(spark, d):
    dets, truths = S.sides(spark, d)
    return S.scenes(dets, "di"), S.scenes(truths, "tj")


@register("SELECT * FROM fx_scene_pair", "fx_scene_pair")
def iou_pairs_dense(spark, d):
    return matching.iou_pairs(*_scenes(spark, d))


@register("SELECT * FROM fx_scene_hit", "fx_scene_hit")
def greedy_match_dense(spark, d):
    return matching.matched(*_scenes(spark, d))


@register("SELECT * FROM fx_hit", "fx_hit")
def greedy_match(spark, d):
    return _hits(spark, d)


COUNTS = """SELECT i.image_id, coalesce(h.tp, 0) AS tp, coalesce(h.fp, 0) AS fp, coalesce(t.n, 0) - coalesce(h.tp, 0) AS fn FROM fx_box_image i
LEFT JOIN (SELECT image_id, count(tj) AS tp, count(*) - count(tj) AS fp FROM fx_hit WHERE confidence >= 0.3 GROUP BY 1) h ON h.image_id = i.image_id
LEFT JOIN (SELECT image_id, count(*) AS n FROM fx_truth GROUP BY 1) t ON t.image_id = i.image_id"""


@register(COUNTS, "fx_hit", "fx_truth", "fx_box_image")
def per_image_counts(spark, d):
    return matching.per_image_counts(_hits(spark, d), S.truths(spark, d), S.box_images(spark, d), 0.3)


@register(f"""{SCORED} (SELECT t.class_id, tp, fp, n - tp AS fn FROM (SELECT class_id, count(*) AS n FROM fx_truth GROUP BY 1) t
JOIN (SELECT class_id, count(tj) AS tp, count(*) - count(tj) AS fp FROM fx_hit WHERE confidence >= 0.3 GROUP BY 1) h ON t.class_id = h.class_id))""", "fx_hit", "fx_truth")
def per_class_scores(spark, d):
    return matching.class_scores(_hits(spark, d), S.truths(spark, d), 0.3)


CURVE = f"""{SCORED} (SELECT conf, count(tj) FILTER (WHERE confidence >= conf) AS tp, count(*) FILTER (WHERE confidence >= conf AND tj IS NULL) AS fp,
any_value(n) - count(tj) FILTER (WHERE confidence >= conf) AS fn FROM fx_hit, (SELECT count(*) AS n FROM fx_truth), (SELECT unnest({S.GRID}::DOUBLE[]) AS conf) GROUP BY conf))"""


@register(CURVE, "fx_hit", "fx_truth")
def confidence_curve(spark, d):
    return matching.confidence_curve(_hits(spark, d), S.truths(spark, d), S.GRID)


@register(f'SELECT f1, "precision", conf, tp, fp, fn, recall FROM ({CURVE}) ORDER BY f1 DESC, "precision" DESC, conf DESC LIMIT 1', "fx_hit", "fx_truth")
def best_threshold(spark, d):
    return matching.best_threshold(confidence_curve(spark, d))


@register("""SELECT class_id, any_value(n) AS truths, round(sum(coalesce(best, 0)) / 101, 6) AS ap FROM (
SELECT t.class_id, t.n, p.k, max(c.tp::DOUBLE / c.dets) AS best FROM (SELECT class_id, count(*) AS n FROM fx_truth GROUP BY 1) t CROSS JOIN (SELECT unnest(range(101)) AS k) p
LEFT JOIN (SELECT DISTINCT class_id, confidence, count(tj) OVER w AS tp, count(*) OVER w AS dets FROM fx_hit
WINDOW w AS (PARTITION BY class_id ORDER BY confidence DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c ON c.class_id = t.class_id AND 100 * c.tp >= p.k * t.n
GROUP BY 1, 2, 3) GROUP BY class_id""", "fx_hit", "fx_truth")
def average_precision(spark, d):
    return matching.average_precision(_hits(spark, d), S.truths(spark, d)).withColumn("ap", F.round("ap", 6))


@register("""SELECT size_bin, count(t.image_id) AS objects, count(h.tj) AS found, CASE WHEN count(t.image_id) > 0 THEN count(h.tj)::DOUBLE / count(t.image_id) END AS recall
FROM (VALUES ('short_side_lt_8px'), ('short_side_8_to_16px'), ('short_side_ge_16px')) v(size_bin)
LEFT JOIN (SELECT *, CASE WHEN least(x2 - x1, y2 - y1) * 100 / 120 < 8 THEN 'short_side_lt_8px' WHEN least(x2 - x1, y2 - y1) * 100 / 120 < 16 THEN 'short_side_8_to_16px' ELSE 'short_side_ge_16px' END AS b FROM fx_truth) t ON t.b = v.size_bin
LEFT JOIN (SELECT * FROM fx_hit WHERE confidence >= 0.3 AND tj IS NOT NULL) h ON h.image_id = t.image_id AND h.tj = t.tj GROUP BY size_bin""", "fx_hit", "fx_truth")
def recall_by_size(spark, d):
    return matching.recall_by_size(_hits(spark, d), S.truths(spark, d), S.box_images(spark, d), 0.3, imgsz=100)


@register("""SELECT overlap, count(b) AS n FROM (VALUES ('overlap_lt_0.1'), ('overlap_0.1_to_match_iou'), ('duplicate_or_assignment_conflict')) v(overlap) LEFT JOIN (
SELECT CASE WHEN m < 0.1 THEN 'overlap_lt_0.1' WHEN m < 0.5 THEN 'overlap_0.1_to_match_iou' ELSE 'duplicate_or_assignment_conflict' END AS b FROM (
SELECT w.image_id, w.di, max(i / nullif((d.x2-d.x1)*(d.y2-d.y1)+(t.x2-t.x1)*(t.y2-t.y1)-i, 0)) AS m FROM (SELECT * FROM fx_hit WHERE confidence >= 0.3 AND tj IS NULL) w
JOIN fx_det d ON d.image_id = w.image_id AND d.di = w.di JOIN fx_truth t ON t.image_id = w.image_id,
LATERAL (SELECT greatest(0.0::DOUBLE, least(d.x2, t.x2) - greatest(d.x1, t.x1)) * greatest(0.0::DOUBLE, least(d.y2, t.y2) - greatest(d.y1, t.y1)) AS i) GROUP BY 1, 2)) ON b = overlap GROUP BY overlap""", "fx_hit", "fx_truth")
def fp_taxonomy(spark, d):
    return matching.fp_taxonomy(_hits(spark, d), S.detections(spark, d), S.truths(spark, d), 0.3)


# latency, selection, identity ---------------------------------------------------------


@register("SELECT model, count(*) AS n, round(avg(wall_ms), 6) AS mean_ms, quantile_cont(wall_ms, 0.5) AS median_ms, quantile_cont(wall_ms, 0.95) AS p95_ms FROM fx_latency GROUP BY model", "fx_latency")
def latency_stats(spark, d):
    return selection.latency_stats(S.latency(spark, d)).withColumn("mean_ms", F.round("mean_ms", 6))


@register("""SELECT model, stage, count(ms) AS n, round(avg(ms), 6) AS mean_ms, quantile_cont(ms, 0.5) AS median_ms, quantile_cont(ms, 0.95) AS p95_ms FROM (
SELECT model, 'wall_ms' AS stage, wall_ms AS ms FROM fx_latency UNION ALL SELECT model, 'inference', inference FROM fx_latency) GROUP BY model, stage""", "fx_latency")
def latency_stage_stats(spark, d):
    return selection.stage_stats(S.latency(spark, d), ["wall_ms", "inference"]).withColumn("mean_ms", F.round("mean_ms", 6))


@register(f"""SELECT image_id, tp, fp, fn, kind, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY image_id) AS rank FROM (
SELECT *, unnest(list_filter([CASE WHEN tp > 0 THEN 'tp' END, CASE WHEN fp > 0 THEN 'fp' END, CASE WHEN fn > 0 THEN 'fn' END], lambda k: k IS NOT NULL)) AS kind FROM ({COUNTS}))) WHERE rank <= 5""", "fx_hit", "fx_truth", "fx_box_image")
def examples_per_kind(spark, d):
    return selection.examples_per_kind(per_image_counts(spark, d), 5)


@register("SELECT p_brand AS name, max(p_retailprice) AS mAP50_95 FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def model_selection(spark, d):
    return selection.best_model(S.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_retailprice").alias("mAP50_95")))


@register(f"SELECT * FROM ({COUNTS}) ORDER BY fn DESC, fp DESC, image_id LIMIT 15", "fx_hit", "fx_truth", "fx_box_image")
def worst_images(spark, d):
    return selection.worst_images(per_image_counts(spark, d))


@register("""SELECT t.class_id, coalesce(b.b.image_id, t.first) AS image_id, b.b.confidence AS confidence, CASE WHEN b.b IS NULL THEN 'no_correct_detection' ELSE 'correct_detection' END AS status
FROM (SELECT class_id, min(image_id) AS first FROM fx_truth GROUP BY 1) t
LEFT JOIN (SELECT class_id, max(struct_pack(confidence := confidence, image_id := image_id)) AS b FROM fx_hit WHERE tj IS NOT NULL GROUP BY 1) b ON b.class_id = t.class_id""", "fx_hit", "fx_truth")
def best_example_per_class(spark, d):
    return selection.best_examples(_hits(spark, d), S.truths(spark, d))


RUNS = """SELECT p_brand AS name, count(*) AS epochs, max(p_retailprice) AS "mAP50", min(p_retailprice) AS "mAP50_95", 640::INTEGER AS imgsz FROM part GROUP BY 1"""


def _runs(spark, d):
    return S.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("epochs"), F.max("p_retailprice").alias("metrics/mAP50(B)"), F.min("p_retailprice").alias("metrics/mAP50-95(B)")).withColumn("imgsz", F.lit(640))


@register(RUNS)
def run_comparison(spark, d):
    return selection.compare_runs(_runs(spark, d), ["imgsz"], ["imgsz"])


@register(f"""SELECT 'imgsz' AS "column", count(DISTINCT imgsz) AS versions, count(*) FILTER (WHERE imgsz IS NULL) AS missing, true AS homogeneous FROM ({RUNS})
UNION ALL SELECT 'epochs', count(DISTINCT epochs), 0, count(DISTINCT epochs) <= 1 FROM ({RUNS})""")
def run_homogeneity(spark, d):
    return selection.homogeneity(_runs(spark, d), ["imgsz", "epochs"])


@register("""(SELECT o_orderkey, o_orderstatus, 'only_first' AS side FROM orders WHERE o_orderstatus = 'P')
UNION ALL (SELECT o_orderkey, 'P', 'only_second' FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0)
UNION ALL (SELECT o_orderkey, o_orderstatus, 'only_first' FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0)""")
def manifest_diff(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    other = o.where("o_orderstatus <> 'P'").withColumn("o_orderstatus", F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0), "P").otherwise(F.col("o_orderstatus")))
    return curate.manifest_diff(o, other)


@register("""SELECT n, sha256(n || ':' || a || ':' || b) AS identity FROM (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT) AS a, sum(('0x' || substr(h, 16, 15))::HUGEINT) AS b
FROM (SELECT sha256(group_id || chr(31) || image_id || chr(31) || sha256) AS h FROM fx_image))""", "fx_image")
def dataset_identity(spark, d):
    return curate.table_identity(S.images(spark, d), "image_id", "group_id", "sha256")


@register("""WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), p AS (SELECT least(24, floor((p_retailprice - lo) / ((hi - lo) / 25)))::BIGINT AS bin FROM part, e)
SELECT b AS bin, lo + b * ((hi - lo) / 25) AS low, lo + (b + 1) * ((hi - lo) / 25) AS high, (SELECT count(*) FROM p WHERE p.bin = b) AS n FROM e, range(25) r(b)""")
def histogram_bins(spark, d):
    return profile.histogram(S.table(spark, d, "part"), "p_retailprice", 25)


from gridlark.plans import checks, files  # noqa: E402, F401  they register their queries, which use the above
