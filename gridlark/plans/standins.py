"""Images, boxes, detections and runs as projections of the driver's tables.

Each has a DataFrame form and the SQL of the same rows, for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.scratch import Scratch

BOX_ORDER = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
GRID = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
CLASSES = ["A", "N", "R"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    group = F.concat(F.lit("g"), F.lpad(F.expr("doc_id div 10").cast("string"), 5, "0"))
    return d.select(F.col("doc_id").alias("image_id"), group.alias("group_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit(120).alias("width"), F.lit(100).alias("height"))


def boxes(spark, sf_dir) -> DataFrame:
    """x, y, w, h and corners of every line item; ``idx`` numbers an image's."""
    li = table(spark, sf_dir, "lineitem")
    image = F.expr("l_orderkey div 10")
    idx = F.row_number().over(W.partitionBy("image_id").orderBy(*BOX_ORDER))
    cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    x, y = (F.col("l_partkey") % 100).cast("double"), ((F.col("l_suppkey") * 7) % 80).cast("double")
    w, h = F.col("l_quantity") + 4, (4 + 6 * F.col("l_linenumber")).cast("double")
    b = li.withColumn("image_id", image).withColumn("idx", idx)
    b = b.select("image_id", "idx", cls.alias("class_id"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), "l_extendedprice", "l_discount")
    return b.withColumn("x1", F.col("x")).withColumn("y1", F.col("y")).withColumn("x2", F.col("x") + F.col("w")).withColumn("y2", F.col("y") + F.col("h"))


def numbered(spark, sf_dir) -> DataFrame:
    """``boxes`` in a written table, for what reads them as truths and as detections: they are shuffled and sorted once."""
    b = boxes(spark, sf_dir)
    held = Scratch(spark, "boxes").table(b.drop("x1", "y1", "x2", "y2"), "boxes")
    return held.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")})


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Detections and truths of the same numbered boxes."""
    b = numbered(spark, sf_dir)
    return detections(spark, sf_dir, b), truths(spark, sf_dir, b)


def truths(spark, sf_dir, of: DataFrame | None = None) -> DataFrame:
    return (boxes(spark, sf_dir) if of is None else of).select("image_id", F.col("idx").alias("tj"), "class_id", "x1", "y1", "x2", "y2")


def detections(spark, sf_dir, of: DataFrame | None = None) -> DataFrame:
    shift = 8 * F.col("l_discount") * F.col("w")
    conf = (F.round(F.col("l_extendedprice") * 100).cast("long") % 1000).cast("double") / 1000.0
    b = (boxes(spark, sf_dir) if of is None else of).where("idx % 3 <> 0")
    return b.select("image_id", F.col("idx").alias("di"), "class_id", conf.alias("confidence"), (F.col("x1") + shift).alias("x1"), "y1", (F.col("x2") + shift).alias("x2"), "y2")


def scenes(rows: DataFrame, number: str) -> DataFrame:
    """A hundred images side by side as one, which holds thousands of boxes."""
    i = F.col("image_id")
    right, down = 150 * (i % 10), 130 * (F.expr("image_id div 10") % 10)
    moved = {"x1": F.col("x1") + right, "x2": F.col("x2") + right, "y1": F.col("y1") + down, "y2": F.col("y2") + down}
    return rows.withColumns({number: ((i % 100) * 1000 + F.col(number)).cast("int"), **moved}).withColumn("image_id", F.expr("image_id div 100"))


def box_images(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 10").alias("image_id"), F.lit(120).alias("width"), F.lit(100).alias("height")).distinct()


def latency(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("model"), F.col("user_id").alias("image"), F.col("value").alias("wall_ms"), F.get_json_object("props", "$.k").cast("double").alias("inference"))


SQL = {
    "fx_image": "SELECT doc_id AS image_id, 'g' || lpad((doc_id // 10)::VARCHAR, 5, '0') AS group_id, sha256(text) AS sha256, 120::INTEGER AS width, 100::INTEGER AS height FROM documents",
    "fx_box": f"""SELECT image_id, idx, class_id, x, y, w, h, price, discount, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM (
      SELECT l_orderkey // 10 AS image_id, row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY {', '.join(BOX_ORDER)})::INTEGER AS idx,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::INTEGER AS class_id, (l_partkey % 100)::DOUBLE AS x, ((l_suppkey * 7) % 80)::DOUBLE AS y,
        l_quantity + 4 AS w, (4 + 6 * l_linenumber)::DOUBLE AS h, l_extendedprice AS price, l_discount AS discount FROM lineitem)""",
    "fx_truth": "SELECT image_id, idx AS tj, class_id, x1, y1, x2, y2 FROM fx_box",
    "fx_det": """SELECT image_id, idx AS di, class_id, (round(price * 100)::BIGINT % 1000)::DOUBLE / 1000.0::DOUBLE AS confidence,
      x1 + 8 * discount * w AS x1, y1, x2 + 8 * discount * w AS x2, y2 FROM fx_box WHERE idx % 3 <> 0""",
    "fx_box_image": "SELECT DISTINCT l_orderkey // 10 AS image_id, 120::INTEGER AS width, 100::INTEGER AS height FROM lineitem",
    "fx_latency": "SELECT event_type AS model, user_id AS image, value AS wall_ms, json_extract_string(props, '$.k')::DOUBLE AS inference FROM events",
    "fx_pair": """SELECT d.image_id, d.class_id, di, tj, confidence, CASE WHEN (d.x2-d.x1)*(d.y2-d.y1)+(t.x2-t.x1)*(t.y2-t.y1)-i > 0
      THEN i / ((d.x2-d.x1)*(d.y2-d.y1)+(t.x2-t.x1)*(t.y2-t.y1)-i) ELSE 0.0 END AS iou
      FROM fx_det d JOIN fx_truth t ON d.image_id = t.image_id AND d.class_id = t.class_id,
      LATERAL (SELECT greatest(0.0::DOUBLE, least(d.x2, t.x2) - greatest(d.x1, t.x1)) * greatest(0.0::DOUBLE, least(d.y2, t.y2) - greatest(d.y1, t.y1)) AS i)""",
    "fx_turn": """SELECT image_id, class_id, di, list(tj ORDER BY iou DESC, tj DESC) AS cands,
      row_number() OVER (PARTITION BY image_id, class_id ORDER BY confidence DESC, di) AS k FROM fx_pair WHERE iou >= 0.5 GROUP BY image_id, class_id, di, confidence""",
    "fx_step": """SELECT image_id, class_id, 0::BIGINT AS k, NULL::INTEGER AS di, NULL::INTEGER AS tj, []::INTEGER[] AS used FROM (SELECT DISTINCT image_id, class_id FROM fx_turn)
      UNION ALL SELECT s.image_id, s.class_id, t.k, t.di, f.tj, CASE WHEN f.tj IS NULL THEN s.used ELSE list_append(s.used, f.tj) END
      FROM fx_step s JOIN fx_turn t ON s.image_id = t.image_id AND s.class_id = t.class_id AND t.k = s.k + 1,
      LATERAL (SELECT list_filter(t.cands, lambda c: NOT list_contains(s.used, c))[1] AS tj) f""",
    "fx_hit": "SELECT d.image_id, d.class_id, d.di, d.confidence, s.tj FROM fx_det d LEFT JOIN fx_step s ON d.image_id = s.image_id AND d.class_id = s.class_id AND d.di = s.di",
}
_SCENE = """SELECT image_id // 100 AS image_id, ((image_id % 100) * 1000 + {0})::INTEGER AS {0}, class_id{1}, x1 + 150 * (image_id % 10) AS x1,
  y1 + 130 * (image_id // 10 % 10) AS y1, x2 + 150 * (image_id % 10) AS x2, y2 + 130 * (image_id // 10 % 10) AS y2 FROM {2}"""
SQL |= {"fx_scene_truth": _SCENE.format("tj", "", "fx_truth"), "fx_scene_det": _SCENE.format("di", ", confidence", "fx_det")}
SQL["fx_scene_pair"] = SQL["fx_pair"].replace("fx_det", "fx_scene_det").replace("fx_truth", "fx_scene_truth") + "\n      WHERE i > 0"
SQL["fx_scene_turn"] = SQL["fx_turn"].replace("fx_pair", "fx_scene_pair")
SQL["fx_scene_step"] = SQL["fx_step"].replace("fx_step", "fx_scene_step").replace("fx_turn", "fx_scene_turn")
SQL["fx_scene_hit"] = SQL["fx_hit"].replace("fx_det", "fx_scene_det").replace("fx_step", "fx_scene_step")
_NEEDS = {"fx_truth": ["fx_box"], "fx_det": ["fx_box"], "fx_pair": ["fx_det", "fx_truth"], "fx_turn": ["fx_pair"], "fx_step": ["fx_turn"], "fx_hit": ["fx_det", "fx_step"]}
_NEEDS |= {
    "fx_scene_truth": ["fx_truth"], "fx_scene_det": ["fx_det"], "fx_scene_pair": ["fx_scene_det", "fx_scene_truth"], "fx_scene_turn": ["fx_scene_pair"],
    "fx_scene_step": ["fx_scene_turn"], "fx_scene_hit": ["fx_scene_det", "fx_scene_step"],
}


def with_sql(body: str, *names: str) -> str:
    """``body`` with the stand-ins it needs in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order]
    return ("WITH RECURSIVE " + ", ".join(parts) + "\n" + body) if parts else body
