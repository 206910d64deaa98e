"""Queries of constraints, names, set operations and records, with their SQL.

Imported by ``queries.py``, whose registry they join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.functions import names as N
from gridlark.operators import curate, matching, profile, quality, selection
from gridlark.plans import standins as S
from gridlark.plans.queries import ANN, COUNTS, FIRST, LINKED, _annotations, _hits, register

# constraints ---------------------------------------------------------------


@register(f"SELECT id, image_id FROM (WITH {ANN} SELECT id, image_id FROM fx_ann) WHERE image_id IS NULL OR image_id < 0", "fx_box")
def invalid_ids(spark, d):
    return quality.bad_ids(_annotations(spark, d).select("id", "image_id"), "image_id")


@register("SELECT image_id, group_id FROM fx_image WHERE image_id % 10 >= 8", "fx_image")
def images_without_a_group(spark, d):
    imgs = S.images(spark, d).select("image_id", "group_id")
    return quality.uncovered(imgs, imgs.where("image_id % 10 < 8"))


LABELS = """SELECT image_id, idx, class_id + idx % 2 AS class_id, (x1 + x2) / 240 AS cx, (y1 + y2) / 200 AS cy, (x2 - x1) / 120 AS w, (y2 - y1) / 100 AS h FROM fx_box"""


@register(f"""SELECT image_id, idx, cx - w / 2 >= -1e-6 AND cx + w / 2 <= 1 + 1e-6 AND cy - h / 2 >= -1e-6 AND cy + h / 2 <= 1 + 1e-6 AND class_id < 3 AS ok FROM ({LABELS})""", "fx_box")
def label_ranges(spark, d):
    b = S.boxes(spark, d)
    parts = B.normalised(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(120), F.lit(100))
    return b.select("image_id", "idx", B.label_in_range((F.col("class_id") + F.col("idx") % 2).cast("double"), *parts, 3).alias("ok"))


@register("""SELECT image, objects, found FROM (SELECT image_id AS image, (count(*) + image_id % 5 // 4)::BIGINT AS objects, count(*) FILTER (WHERE idx % 7 <> 0) AS found FROM fx_box GROUP BY image_id)
WHERE objects <> found""", "fx_box")
def label_count_mismatches(spark, d):
    b = S.boxes(spark, d).select(F.col("image_id").alias("image"), "idx")
    manifest = b.groupBy("image").agg((F.count("*") + F.expr("image % 5 div 4")).cast("long").alias("objects"))
    return quality.count_mismatches(b.where("idx % 7 <> 0"), manifest)


@register("SELECT split, n FROM (SELECT l_shipdate::DATE::VARCHAR AS split, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1) WHERE n < 3")
def splits_without_all_classes(spark, d):
    li = S.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("split"), F.col("l_returnflag").alias("class_id"))
    return quality.splits_lacking_classes(li, 3)


@register("SELECT DISTINCT l_linenumber AS class_id FROM lineitem WHERE l_linenumber > 4")
def unmapped_classes(spark, d):
    used = S.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("class_id"))
    return quality.unmapped_classes(used, spark.range(1, 5).select(F.col("id").cast("int").alias("class_id")))


@register("SELECT doc_id AS image_id, source AS status FROM documents WHERE n_chars >= 100")
def readable_images(spark, d):
    docs = S.table(spark, d, "documents")
    status = F.when(F.col("n_chars") < 100, "missing_or_corrupt").otherwise(F.col("source"))
    return quality.readable(docs.select(F.col("doc_id").alias("image_id"), status.alias("status")))


@register("SELECT image_id, group_id FROM fx_image WHERE image_id IN (SELECT page_id FROM pages)", "fx_image")
def available_images(spark, d):
    return curate.available(S.images(spark, d).select("image_id", "group_id"), S.table(spark, d, "pages").select(F.col("page_id").alias("image_id")), "image_id")


@register(f"""SELECT * FROM (WITH i AS (SELECT count(*) AS images, count(*) - count(DISTINCT sha256) AS duplicates FROM fx_image),
a AS (SELECT count(*) AS annotations, count(*) FILTER (WHERE NOT isnan(w) AND w > 0) AS valid_boxes, count(*) FILTER (WHERE image_id IN (SELECT image_id FROM fx_image)) AS on_known_images
FROM (WITH {ANN} SELECT * FROM fx_ann)) SELECT * FROM i, a)""", "fx_image", "fx_box")
def validation_counters(spark, d):
    return quality.validation_counters(S.images(spark, d), _annotations(spark, d))


@register("""SELECT key, was, now FROM (SELECT 'customers' AS key, count(*)::VARCHAR AS was, (count(*) - 1)::VARCHAR AS now FROM customer
UNION ALL SELECT 'nations', count(DISTINCT c_nationkey)::VARCHAR, count(DISTINCT c_nationkey)::VARCHAR FROM customer) WHERE was <> now""")
def changed_manifest_keys(spark, d):
    c = S.table(spark, d, "customer").agg(F.count("*").alias("customers"), F.count_distinct("c_nationkey").alias("nations"))
    return quality.changed_keys(c.withColumn("customers", F.col("customers") - 1), c, ["customers", "nations"])


# names and records -----------------------------------------------------------


@register("""SELECT doc_id, format('image_{:08d}.', doc_id) || CASE WHEN doc_id % 3 = 0 THEN 'jpg' WHEN doc_id % 3 = 1 THEN 'png' ELSE 'png' END AS name,
format('image_{:08d}_tile_{:05d}.', doc_id, n_chars % 1000) || 'jpg' AS tile FROM documents""")
def output_names(spark, d):
    given = F.when(F.col("doc_id") % 3 == 0, "JPG").when(F.col("doc_id") % 3 == 1, "png").otherwise("gif")
    return S.table(spark, d, "documents").select("doc_id", N.output_name(F.col("doc_id"), given).alias("name"), N.output_name(F.col("doc_id"), F.lit("jpg"), F.col("n_chars") % 1000).alias("tile"))


PATHS = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '../' || page_id WHEN 2 THEN 'C:/x' ELSE 'a/b_' || page_id || '.jpg' END"


def _paths(spark, d):
    k = F.col("page_id") % 4
    number = F.col("page_id").cast("string")
    path = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("../"), number)).when(k == 2, "C:/x").otherwise(F.concat(F.lit("a/b_"), number, F.lit(".jpg")))
    return S.table(spark, d, "pages").select("page_id", path.alias("path"), "url")


@register(rf"""SELECT page_id, NOT regexp_matches(path, '^/|^[A-Za-z]:|(^|/)\.\.(/|$)') AS safe, regexp_full_match(path, '[A-Za-z0-9_-]{{1,80}}') AS identifier,
CASE WHEN path LIKE 'a/%' THEN path[3:] ELSE path END AS short FROM (SELECT page_id, {PATHS} AS path FROM pages)""")
def path_checks(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("page_id", N.is_safe_path(p).alias("safe"), N.is_identifier(p).alias("identifier"), N.relative_to(p, "a").alias("short"))


@register("SELECT page_id, regexp_replace(url, '^http://', 'https://') AS first_url FROM pages")
def first_urls(spark, d):
    return S.table(spark, d, "pages").select("page_id", N.first_url(F.lit(""), F.lit(None).cast("string"), F.col("url"), F.lit("http://other")).alias("first_url"))


@register("SELECT page_id, upper(right(hex(encode(html)), 4)) <> 'FFD9' AS lacks_end FROM pages")
def end_marker_missing(spark, d):
    return S.table(spark, d, "pages").select("page_id", N.jpeg_end_missing(F.col("html").cast("binary")).alias("lacks_end"))


@register("""SELECT p_partkey, abs(p_size * 4 - 3 * (p_size + p_partkey % 5)) > 8 AS differs FROM part""")
def aspect_differs(spark, d):
    w = F.col("p_size")
    return S.table(spark, d, "part").select("p_partkey", B.aspect_differs(w, w + F.col("p_partkey") % 5, F.lit(3), F.lit(4)).alias("differs"))


@register("SELECT p_partkey, p_brand AS brand, p_size + 1 AS size, 'x' AS note FROM part")
def struct_override(spark, d):
    record = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return S.table(spark, d, "part").select("p_partkey", curate.overridden(record, size=F.col("p_size") + 1, note=F.lit("x")).alias("r")).select("p_partkey", "r.*")


# sets and counts ----------------------------------------------------------------


@register("SELECT doc_id AS image_id FROM documents UNION SELECT page_id FROM pages UNION SELECT doc_id FROM labels")
def union_of_ids(spark, d):
    named = lambda t, c: S.table(spark, d, t).select(F.col(c).alias("image_id"))
    return curate.union_of_ids(named("documents", "doc_id"), named("pages", "page_id"), named("labels", "doc_id"))


@register("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def concatenated_tables(spark, d):
    region = S.table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))
    return curate.concatenated(S.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), region, region)


@register(f"SELECT (image_id % 3)::INTEGER AS class_id, count(*) AS objects FROM ({FIRST}) WHERE original = image_id GROUP BY 1", "fx_image")
def objects_of_representatives(spark, d):
    imgs = S.images(spark, d)
    return profile.objects_of_representatives(imgs.select("image_id", (F.col("image_id") % 3).cast("int").alias("class_id")), curate.representatives(imgs))


@register(f"SELECT * FROM (WITH RECURSIVE {LINKED} SELECT count(*) AS groups, count(DISTINCT root) AS components FROM (SELECT group_id, min(root) AS root FROM fx_reach GROUP BY group_id))", "fx_image")
def component_counts(spark, d):
    return profile.component_counts(curate.group_components(S.images(spark, d)))


@register("SELECT list_sort(list(DISTINCT basis)) AS bases, bool_or(regexp_matches(basis, 'unverified|heuristic')) AS unverified FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'heuristic name' ELSE 'unspecified' END AS basis FROM part)")
def distinct_bases(spark, d):
    basis = F.when(F.col("p_size") % 3 == 0, "manual").when(F.col("p_size") % 3 == 1, "heuristic name")
    return profile.distinct_bases(S.table(spark, d, "part").select(basis.alias("basis")))


# detections and runs --------------------------------------------------------------


@register("""SELECT image_id, count(*) AS tp, count(DISTINCT class_id) AS classes FROM fx_hit WHERE tj IS NOT NULL GROUP BY image_id ORDER BY tp DESC, classes DESC, image_id LIMIT 1""", "fx_hit")
def richest_image(spark, d):
    return selection.richest_image(_hits(spark, d))


@register(f"""SELECT c.image_id, tp, fp, fn, coalesce(d.n, 0) AS detections, coalesce(d.s, 0) AS of_classes, coalesce(t.n, 0) AS truth, coalesce(t.x, 0.0::DOUBLE) AS first_x FROM ({COUNTS}) c
LEFT JOIN (SELECT image_id, count(*) AS n, sum(class_id)::BIGINT AS s FROM fx_det WHERE confidence >= 0.3 GROUP BY 1) d ON d.image_id = c.image_id
LEFT JOIN (SELECT image_id, count(*) AS n, arg_min(x1, tj) AS x FROM fx_truth GROUP BY 1) t ON t.image_id = c.image_id""", "fx_hit", "fx_truth", "fx_box_image")
def error_rows(spark, d):
    dets, truths = S.sides(spark, d)
    rows = matching.error_rows(matching.matched(dets, truths), dets, truths, S.box_images(spark, d), 0.3)
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("long")
    of = F.coalesce(F.aggregate("detections", F.lit(0).cast("long"), lambda s, x: s + x["class_id"]), F.lit(0).cast("long"))
    first = F.coalesce(F.get(F.get("truth", F.lit(0))["xyxy"], 0), F.lit(0.0))
    return rows.select("image_id", "tp", "fp", "fn", size("detections").alias("detections"), of.alias("of_classes"), size("truth").alias("truth"), first.alias("first_x"))


@register("""SELECT name, "mAP50", n, median_ms FROM (SELECT p_brand AS name, max(p_retailprice) AS "mAP50" FROM part GROUP BY 1) r
LEFT JOIN (SELECT 'Brand#' || (10 + user_id % 20) AS model, count(value) AS n, quantile_cont(value, 0.5) AS median_ms FROM events GROUP BY 1) l ON l.model = r.name""")
def models_with_latency(spark, d):
    runs = S.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_retailprice").alias("mAP50"))
    samples = S.table(spark, d, "events").select(F.concat(F.lit("Brand#"), (10 + F.col("user_id") % 20).cast("string")).alias("model"), F.col("value").alias("wall_ms"))
    return selection.with_latency(runs, selection.latency_stats(samples).select("model", "n", "median_ms")).select("name", "mAP50", "n", "median_ms")


@register("SELECT p_partkey, round_even((p_size / 64.0::DOUBLE - 0.25) * 100, 2) AS points FROM part")
def percentage_points(spark, d):
    return S.table(spark, d, "part").select("p_partkey", selection.points_apart(F.col("p_size") / F.lit(64.0), F.lit(0.25)).alias("points"))


LIMITS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
AT_LIMITS = f"""lim AS (SELECT unnest({LIMITS}::DOUBLE[]) AS threshold),
turn_at AS (SELECT threshold, image_id, class_id, di, list(tj ORDER BY iou DESC, tj DESC) AS cands, row_number() OVER (PARTITION BY threshold, image_id, class_id ORDER BY confidence DESC, di) AS k
  FROM fx_pair JOIN lim ON iou >= threshold GROUP BY threshold, image_id, class_id, di, confidence),
step_at AS (SELECT threshold, image_id, class_id, 0::BIGINT AS k, NULL::INTEGER AS di, NULL::INTEGER AS tj, []::INTEGER[] AS used FROM (SELECT DISTINCT threshold, image_id, class_id FROM turn_at)
  UNION ALL SELECT s.threshold, s.image_id, s.class_id, t.k, t.di, f.tj, CASE WHEN f.tj IS NULL THEN s.used ELSE list_append(s.used, f.tj) END
  FROM step_at s JOIN turn_at t ON s.threshold = t.threshold AND s.image_id = t.image_id AND s.class_id = t.class_id AND t.k = s.k + 1,
  LATERAL (SELECT list_filter(t.cands, lambda c: NOT list_contains(s.used, c))[1] AS tj) f),
hit_at AS (SELECT l.threshold, d.image_id, d.class_id, d.di, d.confidence, s.tj FROM fx_det d CROSS JOIN lim l
  LEFT JOIN step_at s ON d.image_id = s.image_id AND d.class_id = s.class_id AND d.di = s.di AND s.threshold = l.threshold),
cnt AS (SELECT threshold, class_id, confidence, count(tj) AS tp, count(*) AS dets FROM hit_at GROUP BY 1, 2, 3), have AS (SELECT class_id, count(*) AS truths FROM fx_truth GROUP BY 1),
curve AS (SELECT threshold, class_id, sum(tp) OVER w AS tp, sum(dets) OVER w AS dets FROM cnt WINDOW w AS (PARTITION BY threshold, class_id ORDER BY confidence DESC)),
ap AS (SELECT threshold, class_id, sum(coalesce(best, 0)) / 101 AS ap FROM (SELECT l.threshold, h.class_id, r.p, max(c.tp / c.dets::DOUBLE) AS best FROM lim l CROSS JOIN have h CROSS JOIN range(101) r(p)
  LEFT JOIN curve c ON c.threshold = l.threshold AND c.class_id = h.class_id AND 100 * c.tp >= r.p * h.truths GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@register(f"SELECT * FROM (WITH RECURSIVE {AT_LIMITS} SELECT threshold, count(*) AS classes, round(avg(ap), 9) AS map FROM ap GROUP BY threshold)", "fx_pair")
def mean_average_precision(spark, d):
    return matching.mean_average_precision(*S.sides(spark, d), LIMITS).withColumn("map", F.round("map", 9))


@register("""SELECT name, 0.4::DOUBLE AS conf, 'table' AS dataset_identity, true AS unchanged FROM (SELECT p_brand AS name, max(p_retailprice) AS m FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""")
def frozen_selection(spark, d):
    best = selection.best_model(S.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_retailprice").alias("mAP50_95")))
    row = selection.frozen(best, 0.4, "table")
    again = F.sha2(F.to_json(F.struct(*sorted(c for c in row.columns if c != "selection_sha256"))), 256)
    return row.select("name", "conf", "dataset_identity", (again == F.col("selection_sha256")).alias("unchanged"))
