"""Instance-discovery views over the driver's star-schema tables.

Ten orders are an image: their lines are detections (scored boxes) and the orders
themselves ground-truth boxes. Embeddings are patch features on 10 x 10 grids, events
are nodes of zoom trees of 500. Every view covers its whole table. Each has a SQL
twin for checks; boxes are half-open (y0, y1, x0, x1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ranked(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("image_id", F.expr("l_orderkey div 10"))
    return _ranked(lines, ["image_id"], LINE_ORDER, "det_id").selectExpr(
        "image_id", "det_id", "l_partkey % 80 AS y0", "l_partkey % 80 + 5 + cast(l_quantity AS bigint) AS y1",
        "l_suppkey % 80 AS x0", "l_suppkey % 80 + 5 + 6 * cast(l_linenumber AS bigint) AS x1", "l_extendedprice AS score",
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("image_id", F.expr("o_orderkey div 10"))
    return _ranked(orders, ["image_id"], ["o_orderkey"], "gt_id").selectExpr(
        "image_id", "gt_id", "o_custkey % 80 AS y0", "o_custkey % 80 + 10 + o_orderkey % 40 AS y1",
        "(7 * o_custkey) % 80 AS x0", "(7 * o_custkey) % 80 + 10 + o_orderkey % 30 AS x1",
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of the detections that are no rectangles: each row begins up to three pixels late and ends up to two early."""
    rows = detections(spark, sf_dir).select("image_id", "det_id", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "y0", "x0", "x1")
    return rows.select("image_id", "det_id", "y", (F.col("x0") + (F.col("y") - F.col("y0")) % 4).alias("xs"), (F.col("x1") - F.col("y") % 3).alias("xe"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS image_id", "480 + o_custkey % 160 AS height", "640 + o_custkey % 200 AS width")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ann_id orders an image's annotations."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image_id")
    order = ["l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"]
    return _ranked(lines, ["image_id"], order, "ann_id").selectExpr("image_id", "ann_id", "1 + l_suppkey % 10 AS category_id", "l_quantity * l_quantity AS area")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id div 100 AS image_id", "cast((vec_id % 100) div 10 AS bigint) AS r", "vec_id % 10 AS c", "vec_id AS patch_id",
        "cast(label AS bigint) AS class_id", "transform(embedding, x -> cast(x AS double)) AS feat",
    )


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three vectors of each label."""
    own = table(spark, sf_dir, "embeddings").selectExpr("cast(label AS bigint) AS class_id", "vec_id AS ex_id", "transform(embedding, x -> cast(x AS double)) AS feat")
    return _ranked(own, ["class_id"], ["ex_id"], "n").filter("n <= 3").drop("n")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 500 AS image_id", "event_id % 500 + 1 AS node_id", "CASE WHEN event_id % 500 > 0 THEN (event_id % 500 + 1) div 2 END AS parent_id",
        "event_type AS kind", "round(value / 500, 6) AS reid_score",
    )


#: The same views in SQL.
SQL = {
    "detections": """SELECT l_orderkey // 10 AS image_id, row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS det_id,
        l_partkey % 80 AS y0, l_partkey % 80 + 5 + CAST(l_quantity AS BIGINT) AS y1, l_suppkey % 80 AS x0, l_suppkey % 80 + 5 + 6 * l_linenumber::BIGINT AS x1, l_extendedprice AS score FROM lineitem""",
    "gt": """SELECT o_orderkey // 10 AS image_id, row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS gt_id, o_custkey % 80 AS y0, o_custkey % 80 + 10 + o_orderkey % 40 AS y1,
        (7 * o_custkey) % 80 AS x0, (7 * o_custkey) % 80 + 10 + o_orderkey % 30 AS x1 FROM orders""",
    "shapes": "SELECT image_id, det_id, y, x0 + (y - y0) % 4 AS xs, x1 - y % 3 AS xe FROM (SELECT *, unnest(range(y0, y1)) AS y FROM detections)",
    "images": "SELECT o_orderkey AS image_id, 480 + o_custkey % 160 AS height, 640 + o_custkey % 200 AS width FROM orders",
    "annotations": """SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS ann_id,
        1 + l_suppkey % 10 AS category_id, l_quantity * l_quantity AS area FROM lineitem""",
    "patches": """SELECT vec_id // 100 AS image_id, (vec_id % 100) // 10 AS r, vec_id % 10 AS c, vec_id AS patch_id, label::BIGINT AS class_id, embedding::DOUBLE[] AS feat FROM embeddings""",
    "exemplars": """SELECT class_id, ex_id, feat FROM (SELECT label::BIGINT AS class_id, vec_id AS ex_id, embedding::DOUBLE[] AS feat, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 3""",
    "sim": """SELECT p.image_id, p.patch_id, p.r, p.c, e.class_id, e.ex_id, round(list_dot_product(p.feat, e.feat), 9) AS s FROM patches p, exemplars e""",
    "trace": """SELECT event_id // 500 AS image_id, event_id % 500 + 1 AS node_id, CASE WHEN event_id % 500 > 0 THEN (event_id % 500 + 1) // 2 END AS parent_id, event_type AS kind, round(value / 500, 6) AS reid_score FROM events""",
    "iou": """SELECT d.image_id, d.det_id, d.score, g.gt_id, inter, inter / ((d.y1 - d.y0) * (d.x1 - d.x0) + (g.y1 - g.y0) * (g.x1 - g.x0) - inter)::DOUBLE AS iou FROM detections d JOIN gt g USING (image_id),
        LATERAL (SELECT greatest(0, least(d.y1, g.y1) - greatest(d.y0, g.y0)) * greatest(0, least(d.x1, g.x1) - greatest(d.x0, g.x0)) AS inter)""",
}
_NEEDS = {"shapes": ["detections"], "sim": ["patches", "exemplars"], "iou": ["detections", "gt"]}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` behind the named views as common table expressions."""
    order: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    views = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    joint = ",\n" if body.upper().startswith("WITH ") else "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{joint}{body[5:] if joint == ',' + chr(10) else body}"
