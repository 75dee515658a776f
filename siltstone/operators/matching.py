"""Detections against ground truth: overlaps, greedy one-to-one matches, and outcomes.

Greedy operators depend on the order of an image's detections, so they are folds over
an array of an image's candidate pairs. Only pairs that reach the lowest threshold
enter it, so its length is the number of overlapping boxes, not their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from .graph import sorted_side


SIDES = ["y0", "y1", "x0", "x1"]


def tiled_overlaps(left: DataFrame, right: DataFrame, a: str, b: str, tile: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows image_id, a, b, the columns ``carry`` of ``left`` and the boxes l_y0 ... and r_y0 ... of boxes that share area, by
    an equality join on the tiles that boxes touch; each pair comes from one tile. Everything is flat: the boxes of a pair are
    read a dozen times, and a field of a struct costs far more to reach than a column."""
    def tiles(df: DataFrame, key: str, side: str, more: tuple[str, ...]) -> DataFrame:
        own = df.filter("y1 > y0 AND x1 > x0").select("image_id", key, *more, *[F.col(c).alias(f"{side}_{c}") for c in SIDES])
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(f"{side}_{lo}") / tile), F.floor((F.col(f"{side}_{hi}") - 1) / tile)))
        return own.select("*", span("y0", "y1").alias("ty")).select("*", span("x0", "x1").alias("tx"))

    first = (F.col("ty") == F.floor(F.greatest("l_y0", "r_y0") / tile)) & (F.col("tx") == F.floor(F.greatest("l_x0", "r_x0") / tile))
    both = tiles(left, a, "l", carry).join(tiles(right, b, "r", ()), ["image_id", "ty", "tx"])
    return both.filter(g.overlap(g.box("l_"), g.box("r_")) & first).drop("ty", "tx")


def _pairs_of(both: DataFrame, least: float) -> DataFrame:
    """image_id, det_id, score, gt_id, inter, iou of the boxes l_y0 ... and r_y0 ... that overlap, of those whose IoU is ``least`` or more. A pair of
    which one box is too small for ``least`` is left out before its IoU is computed."""
    x, y = g.box("l_"), g.box("r_")
    sized = both.select("image_id", "det_id", "score", "gt_id", g.intersection(x, y).alias("inter"), (g.area(x) + g.area(y)).alias("both"))
    iou = F.col("inter").cast("double") / (F.col("both") - F.col("inter")).cast("double")
    if least > 0:  # inter / (both - inter) >= least, with a hair's breadth for the division
        sized = sized.filter(F.col("inter") * (1 + least) >= F.col("both") * (least * (1 - 1e-9)))
    pairs = sized.select("image_id", "det_id", "score", "gt_id", "inter", iou.alias("iou"))
    return pairs.filter(F.col("iou") >= least) if least > 0 else pairs


def tiled_pairs(dets: DataFrame, gt: DataFrame, tile: int = 64, least: float = 0.0) -> DataFrame:
    """image_id, det_id, score, gt_id, inter, iou of the overlapping boxes of an image whose IoU is ``least`` or more: no boxes are
    paired that share no tile."""
    return _pairs_of(tiled_overlaps(dets, gt, "det_id", "gt_id", tile, ("score",)), least)


def image_pairs(dets: DataFrame, gt: DataFrame, least: float = 0.0) -> DataFrame:
    """What tiled_pairs gives, by a join on the image alone: a box is shuffled once and not once a tile, and not at all where its table lies
    by image already, as behind a window that numbers an image's boxes. All boxes of an image are compared in one task, row by row."""
    def own(df: DataFrame, *more: str) -> DataFrame:
        side = "l" if "score" in more else "r"
        return df.filter("y1 > y0 AND x1 > x0").select("image_id", *more, *[F.col(c).alias(f"{side}_{c}") for c in SIDES])

    both = own(dets, "det_id", "score").join(sorted_side(own(gt, "gt_id")), "image_id")
    return _pairs_of(both.filter(g.overlap(g.box("l_"), g.box("r_"))), least)


def _in_order(pairs: DataFrame) -> DataFrame:
    """Per image, its detections by falling score, each with its candidates. An image's pairs are shuffled once and listed where they meet."""
    own = pairs.select("image_id", "det_id", "score", "gt_id", "iou").repartition("image_id").groupBy("image_id", "det_id", "score").agg(F.array_agg(F.struct("iou", "gt_id")).alias("c"))
    return own.groupBy("image_id").agg(F.array_sort(F.array_agg(F.struct((-F.col("score")).alias("s"), "det_id", "score", "c"))).alias("d"))


def matches_at(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """One-to-one matches (threshold, image_id, det_id, score, gt_id, iou) at each threshold: detections by falling score, then det_id,
    take the free ground truth of largest IoU (the last of equals) of at least the threshold. The thresholds are folds over the same lists."""
    ordered = _in_order(pairs.filter(F.col("iou") >= min(thresholds))).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    kept = lambda d, c: F.struct(d["det_id"].alias("det_id"), d["score"].alias("score"), c["gt_id"].alias("gt_id"), c["iou"].alias("iou"))
    none = F.slice(F.transform("d", lambda d: kept(d, d["c"][0])), 1, 0)

    def take(done: Column, d: Column) -> Column:
        free = F.filter(d["c"], lambda c: (c["iou"] >= F.col("threshold")) & ~F.exists(done, lambda x: x["gt_id"] == c["gt_id"]))
        best = F.array_max(free)
        return F.when(best.isNull(), done).otherwise(F.array_append(done, kept(d, best)))

    found = ordered.select("threshold", "image_id", F.explode(F.aggregate("d", none, take)).alias("m"))
    return found.select("threshold", "image_id", "m.det_id", "m.score", "m.gt_id", "m.iou")


def greedy_match(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The matches (image_id, det_id, gt_id, iou) at one threshold, see matches_at."""
    return matches_at(pairs, [threshold]).select("image_id", "det_id", "gt_id", "iou")


def prediction_outcomes(dets: DataFrame, pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each detection's outcome: matched (takes the free ground truth of largest IoU, the first
    of equals), duplicate (reaches the threshold, but only with taken ones), partial (overlaps), background."""
    best = pairs.groupBy("image_id", "det_id").agg(F.max("iou").alias("best"))
    flipped = pairs.withColumn("gt_id", -F.col("gt_id"))
    won = greedy_match(flipped, threshold).select("image_id", "det_id", F.lit(True).alias("won"))
    all_ = dets.select("image_id", "det_id").join(best, ["image_id", "det_id"], "left").join(won, ["image_id", "det_id"], "left")
    outcome = F.when(F.col("won"), "matched").when(F.col("best") >= threshold, "duplicate").when(F.col("best") > 0, "partial").otherwise("background")
    return all_.select("image_id", "det_id", outcome.alias("outcome"))


def miss_outcomes(gt: DataFrame, after: DataFrame, before: DataFrame, visited: DataFrame, threshold: float = 0.5, seen: float = 0.9) -> DataFrame:
    """Each ground truth's first outcome of: detected (a pair of ``after`` reaches the threshold),
    suppressed (one of ``before`` does), not_emitted (one of ``visited`` does), never_framed; and whether
    ``seen`` of its area lies in one visited box. The three are tables of tiled_pairs."""
    def reached(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.groupBy("image_id", "gt_id").agg((F.max("iou") >= threshold).alias(name))

    held = visited.groupBy("image_id", "gt_id").agg(F.max("inter").alias("held"))
    own = gt.withColumn("area", g.area(g.box()))
    for part in (reached(after, "a"), reached(before, "b"), reached(visited, "v"), held):
        own = own.join(part, ["image_id", "gt_id"], "left")
    outcome = F.when(F.col("a"), "detected").when(F.col("b"), "suppressed").when(F.col("v"), "not_emitted").otherwise("never_framed")
    return own.select("image_id", "gt_id", outcome.alias("outcome"), (g.ratio(F.coalesce("held", F.lit(0)), F.col("area")) >= seen).alias("seen"))


def oracle_merge(pairs: DataFrame) -> DataFrame:
    """Per ground truth the detection of largest IoU among those whose own best it is (first of equals)."""
    hit = pairs.filter("iou > 0")
    own = hit.withColumn("k", F.row_number().over(W.partitionBy("image_id", "det_id").orderBy(F.desc("iou"), "gt_id"))).filter("k = 1")
    best = own.withColumn("k", F.row_number().over(W.partitionBy("image_id", "gt_id").orderBy(F.desc("iou"), "det_id"))).filter("k = 1")
    return best.select("image_id", "gt_id", "det_id", "iou")
