"""Foreground extractors and instance filters: compositions of similarities, thresholds and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import thresholds, vectors


def matched_patches(sims: DataFrame, target: int) -> DataFrame:
    """Patches whose largest similarity to an exemplar of the target is positive and whose nearest exemplar of all is the target's."""
    forward = sims.filter(F.col("class_id") == target).groupBy("image_id", "patch_id").agg(F.max("s").alias("forward"))
    back = vectors.nearest(sims).select("image_id", "patch_id", (F.col("class_id") == target).alias("back"))
    return forward.join(back, ["image_id", "patch_id"]).filter("forward > 0 AND back").select("image_id", "patch_id", "forward")


def aggregated_foreground(patches: DataFrame, sims: DataFrame, target: int, keep: float) -> DataFrame:
    """Matched patches widened to clusters: patches of clusters that hold a match and that the cluster rule keeps; in an image
    where nothing is matched, none."""
    matched = matched_patches(sims, target)
    hit = patches.join(matched.select("patch_id"), "patch_id", "left_semi").select("image_id", "class_id").distinct()
    own = patches.join(hit, ["image_id", "class_id"], "left_semi")
    kept = vectors.cluster_aggregate(own, sims.filter(F.col("class_id") == target), keep).filter("kept").select("image_id", "class_id")
    return own.join(kept, ["image_id", "class_id"], "left_semi").select("image_id", "patch_id", "r", "c")


def filter_instances(cells: DataFrame, label: str, score: str, least_area: int, least_score: float) -> DataFrame:
    """image_id, label, instance, area, score: labels of enough cells and mean score, numbered densely in their order."""
    own = cells.filter(F.col(label) > 0).groupBy("image_id", label).agg(F.count("*").alias("area"), F.avg(score).alias("score"))
    ok = own.filter((F.col("area") >= least_area) & (F.col("score") >= least_score))
    return ok.withColumn("instance", F.row_number().over(W.partitionBy("image_id").orderBy(label)).cast("long"))


def mask_scores(heat: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Per mask the mean of its cells' heat, brought from [-1, 1] to [0, 1]; 0 of no cells."""
    mean = cells.join(heat, ["image_id", "r", "c"], "left").groupBy("image_id", key).agg(F.avg("s").alias("s"))
    return mean.select("image_id", key, F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s") + 1) / 2)), F.lit(0.0)).alias("score"))


def component_scores(parts: DataFrame, border: Column) -> DataFrame:
    """A component's score, scaled by its area over the largest one's of the image where it touches the border."""
    top = F.max("area").over(W.partitionBy("image_id"))
    return parts.withColumn("score", F.when(border, F.col("score") * F.col("area") / top).otherwise(F.col("score")))


def take_ratio(areas: DataFrame, ratio: float) -> DataFrame:
    """The largest masks of each image: ceil(ratio n) of them, one at least (by id where equal)."""
    image = W.partitionBy("image_id")
    rank = F.row_number().over(image.orderBy(F.desc("area"), "ann_id"))
    n = F.count("*").over(image)
    return areas.withColumn("k", rank).withColumn("n", n).filter(F.col("k") <= F.greatest(F.lit(1), F.ceil(F.col("n") * ratio))).drop("k", "n")


def image_similarity(sims: DataFrame, target: int) -> DataFrame:
    return vectors.reid_scores(sims.filter(F.col("class_id") == target)).select("image_id", F.col("g").alias("similarity"))


def dynamic_cuts(sims: DataFrame, target: int, scale: float = 1.0, aggregate_scale: float = 0.5) -> DataFrame:
    """image_id, tau, keep from each image's similarity to the target's exemplars."""
    low, keep = thresholds.dynamic(F.col("similarity"), scale, aggregate_scale, (0.5, 0.2))
    return image_similarity(sims, target).select("image_id", low.alias("tau"), keep.alias("keep"))


def background_boxes(images: DataFrame, gt: DataFrame, tries: int, seed: int, largest: float = 0.05) -> DataFrame:
    """Boxes of hashed place and size, ``tries`` an image, that ground truth covers by less than ``largest``. gt: image_id and box."""
    from ..functions import geometry as g

    digest = F.md5(F.concat_ws(":", F.col("image_id").cast("string"), F.col("k").cast("string"), F.lit(str(seed))))
    number = lambda i: F.conv(F.substring(digest, 1 + 6 * i, 6), 16, 10).cast("long")
    tried = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("k"))
    boxes = tried.withColumn("side", 16 + number(0) % 17).withColumn("y0", number(1) % 96).withColumn("x0", number(2) % 96)
    boxes = boxes.select("image_id", F.col("k").cast("long").alias("k"), "y0", (F.col("y0") + F.col("side")).alias("y1"), "x0", (F.col("x0") + F.col("side")).alias("x1"))
    b, t = boxes.alias("b"), gt.alias("t")
    covered = b.join(t, F.col("b.image_id") == F.col("t.image_id"), "left").groupBy("b.image_id", "b.k", "b.y0", "b.y1", "b.x0", "b.x1").agg(F.coalesce(F.sum(g.intersection(g.box("b."), g.box("t."))), F.lit(0)).alias("inter"))
    return covered.filter(F.col("inter") < largest * g.area(g.box())).drop("inter")
