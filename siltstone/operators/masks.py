"""Masks as run-length rows: (image_id, <id>, y, xs, xe), half-open. Overlaps are measured on packed runs (see packs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import packs


def box_runs(boxes: DataFrame, key: str) -> DataFrame:
    return boxes.filter("y1 > y0 AND x1 > x0").select("image_id", key, F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), F.col("x0").alias("xs"), F.col("x1").alias("xe"))


def areas(runs: DataFrame, key: str) -> DataFrame:
    return runs.groupBy("image_id", key).agg(F.sum(F.col("xe") - F.col("xs")).alias("area"))


def tight_boxes(runs: DataFrame, key: str) -> DataFrame:
    return runs.groupBy("image_id", key).agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("xs").alias("x0"), F.max("xe").alias("x1"))


def overlaps(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """image_id, a, b, inter, area_a, area_b, iou, containment of the mask pairs that share a pixel."""
    return _measured(packs.overlapping(left, right, a, b), a, b)


def _measured(sized: DataFrame, a: str, b: str) -> DataFrame:
    return sized.select("image_id", F.col("a").alias(a), F.col("b").alias(b), "inter", "area_a", "area_b", g.ratio(F.col("inter"), F.col("area_a") + F.col("area_b") - F.col("inter")).alias("iou"), g.ratio(F.col("inter"), F.least("area_a", "area_b")).alias("containment"))


def self_overlaps(runs: DataFrame, key: str) -> DataFrame:
    """As overlaps, of the masks of one table with each other: image_id, a, b with a < b, each pair once."""
    return _measured(packs.overlapping(runs, None, key), "a", "b")


def union(runs: DataFrame, *by: str) -> DataFrame:
    """The runs of each image's union, or of each of an image's ``by``: gaps and islands along each row."""
    row = W.partitionBy("image_id", *by, "y").orderBy("xs", "xe")
    reach = F.max("xe").over(row.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(reach.isNull() | (F.col("xs") > reach), 1).otherwise(0))
    island = marked.withColumn("k", F.sum("new").over(row.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return island.groupBy("image_id", *by, "y", "k").agg(F.min("xs").alias("xs"), F.max("xe").alias("xe")).drop("k")


def covered(runs: DataFrame, region: DataFrame, key: str) -> DataFrame:
    """image_id, key, covered: the pixels of each mask that lie in its image's region (the union of the runs image_id, y, xs, xe); masks with none are left out."""
    whole = region.select("image_id", F.lit(0).cast(dict(runs.dtypes)[key]).alias("none"), "y", "xs", "xe")
    return packs.overlapping(runs, whole, key, "none", united=True).select("image_id", F.col("a").alias(key), F.col("inter").alias("covered"))


def on_grid(runs: DataFrame, key: str, images: DataFrame, rows: int, cols: int) -> DataFrame:
    """image_id, key, r, c: the cells of a grid over each image (image_id, height, width) whose centre's pixel a mask holds. A grid row meets
    the runs of one pixel row, by equality."""
    at = lambda i, side, n: F.least(F.floor((i + 0.5) * F.col(side) / n), F.col(side) - 1)
    lines = images.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r")).withColumn("y", at(F.col("r"), "height", rows))
    met = runs.select("image_id", key, "y", "xs", "xe").join(lines, ["image_id", "y"])
    cells = met.select("image_id", key, "r", "xs", "xe", "width", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c")).withColumn("x", at(F.col("c"), "width", cols)).filter("x >= xs AND x < xe")
    return cells.select("image_id", key, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()


def union_iou(left: DataFrame, right: DataFrame) -> DataFrame:
    """image_id, iou of the two unions."""
    sizes = packs.union_sizes(left, right)
    return sizes.select("image_id", g.ratio(F.col("size_a") + F.col("size_b") - F.col("size"), F.col("size")).alias("iou"))


def shift_into(runs: DataFrame, key: str, y0: int, x0: int, height: int, width: int, least: int = 1) -> DataFrame:
    """Masks cut to a window of their canvas, in the window's coordinates; those of fewer than ``least`` pixels are dropped."""
    cut = runs.filter(F.col("y").between(y0, y0 + height - 1)).select("image_id", key, (F.col("y") - y0).alias("y"), F.greatest(F.lit(0), F.col("xs") - x0).alias("xs"), F.least(F.lit(width), F.col("xe") - x0).alias("xe")).filter("xe > xs")
    return cut.join(areas(cut, key).filter(F.col("area") >= least).select("image_id", key), ["image_id", key], "left_semi")
