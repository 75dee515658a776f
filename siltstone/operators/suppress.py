"""Suppression of repeated detections: hard, soft and directional, what is clipped, and fragments.

Which detections overlap is found first, as a table of pairs: of boxes by tiles they share, of masks
by runs they share (``box_pairs``, ``mask_pairs``). Greedy suppression is then a fold over an
image's detections in order, each of which carries the ids of those before it that could rule it out.
So a fold's length is the number of detections and overlaps of an image, not their product.
``merge_detections`` strings the rules together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import masks, packs
from .graph import components, sorted_side, written
from .matching import tiled_overlaps

_BOX = ["y0", "y1", "x0", "x1"]


def _both_ways(pairs: DataFrame) -> DataFrame:
    """image_id, det_id, other, inter, iou, containment, own of pairs (a, b, ..., area_a, area_b) that are there one way round."""
    ways = [F.struct(F.col(x).alias("det_id"), F.col(y).alias("other"), _own(area).alias("own")) for x, y, area in (("a", "b", "area_a"), ("b", "a", "area_b"))]
    return pairs.select("image_id", "inter", "iou", "containment", F.explode(F.array(*ways)).alias("w")).select("image_id", "w.det_id", "w.other", "inter", "iou", "containment", "w.own")


def _own(area: str) -> Column:
    return F.col("inter") / (F.col(area) + 1e-6)


def box_pairs(dets: DataFrame) -> DataFrame:
    """image_id, a, b (a < b), inter, area_a, area_b, iou, containment of overlapping boxes: a pair is joined and measured once."""
    a = dets.select("image_id", F.col("det_id").alias("a"), *_BOX)
    pairs = tiled_overlaps(a, a.withColumnRenamed("a", "b"), "a", "b").filter("a < b")
    x, y = g.box("l_"), g.box("r_")
    sized = pairs.select("image_id", "a", "b", g.intersection(x, y).alias("inter"), g.area(x).alias("area_a"), g.area(y).alias("area_b"))
    inter = F.col("inter")
    return sized.select("*", g.ratio(inter, F.col("area_a") + F.col("area_b") - inter).alias("iou"), g.ratio(inter, F.least("area_a", "area_b")).alias("containment"))


def mask_pairs(runs: DataFrame) -> DataFrame:
    """As box_pairs, of masks given as runs (image_id, det_id, y, xs, xe)."""
    return masks.self_overlaps(runs, "det_id")


def box_overlaps(dets: DataFrame) -> DataFrame:
    """image_id, det_id, other, inter, iou, containment, own (share of det_id's area) of overlapping boxes, both ways round."""
    return _both_ways(box_pairs(dets))


def mask_overlaps(runs: DataFrame) -> DataFrame:
    """As box_overlaps, of masks given as runs (image_id, det_id, y, xs, xe)."""
    return _both_ways(mask_pairs(runs))


def _ordered(dets: DataFrame, pairs: DataFrame, hit: Callable[[Column], Column], what: Column, *more: Column) -> DataFrame:
    """Per image its detections by falling score, then det_id (``d``), and ``near``: of each that is in pairs which ``hit`` (given det_id's own
    share) lets through, ``what`` of all of them. A fold in that order knows of earlier ones only, so pairs need not be turned by rank.

    Pairs (both ways round, or one way as of box_pairs) are shuffled once, by image and before they are turned round; lists are made where
    an image's pairs have met."""
    if "a" in pairs.columns:
        own = pairs.select("image_id", "a", "b", hit(_own("area_a")).alias("ab"), hit(_own("area_b")).alias("ba"), *more).filter("ab OR ba").repartition("image_id")
        ways = [F.struct(F.col(x).alias("det_id"), F.col(y).alias("other"), F.col(x + y).alias("hit")) for x, y in ("ab", "ba")]
        own = own.withColumn("w", F.explode(F.array(*ways))).filter("w.hit").select("*", "w.det_id", "w.other")
    else:
        own = pairs.filter(hit(F.col("own"))).select("image_id", "det_id", "other", *more).repartition("image_id")
    lists = own.groupBy("image_id", "det_id").agg(F.array_agg(what).alias("n"))
    near = lists.groupBy("image_id").agg(F.map_from_entries(F.array_agg(F.struct("det_id", "n"))).alias("near"))
    rows = dets.groupBy("image_id").agg(F.array_sort(F.array_agg(F.struct((-F.col("score")).alias("s"), "det_id", "score"))).alias("d"))
    return rows.join(sorted_side(near), "image_id", "left")


def _of(x: Column) -> Column:
    return F.try_element_at("near", x["det_id"])


def _greedy(dets: DataFrame, pairs: DataFrame, hit: Callable[[Column], Column]) -> DataFrame:
    """image_id, kept: det_ids of which no kept one is in a pair with an earlier kept one."""
    def step(kept: Column, x: Column) -> Column:
        return F.when(F.coalesce(F.arrays_overlap(_of(x), kept), F.lit(False)), kept).otherwise(F.array_append(kept, x["det_id"]))

    none = F.slice(F.transform("d", lambda x: x["det_id"]), 1, 0)
    return _ordered(dets, pairs, hit, F.col("other")).select("image_id", F.aggregate("d", none, step).alias("kept"))


def nms(dets: DataFrame, iou: float = 0.5, contain: float = 0.8, pairs: DataFrame | None = None) -> DataFrame:
    """Kept detections (image_id, det_id): by falling score, then det_id, those that no kept one overlaps by
    at least ``iou``, or contains (or lies in) by at least ``contain`` of the smaller. 1 and 1 keep all but copies.
    Overlaps are those of boxes unless ``pairs`` (one way round or both) gives others."""
    same = (box_pairs(dets) if pairs is None else pairs).filter((F.col("iou") >= iou) | (F.col("containment") >= contain))
    return _greedy(dets, same, lambda own: F.lit(True)).select("image_id", F.explode("kept").alias("det_id"))


def suppress_directional(dets: DataFrame, iou: float = 0.5, contain: float = 0.8, pairs: DataFrame | None = None) -> DataFrame:
    """As nms with strict bounds, containment by the detection's own area, and empty boxes dropped;
    ``rank`` is the place by score among the kept."""
    same = lambda own: (F.col("iou") > iou) | (own > contain)
    kept = _greedy(dets.filter(g.area(g.box()) > 0), box_pairs(dets) if pairs is None else pairs, same).select("image_id", F.posexplode("kept").alias("rank", "det_id"))
    return kept.select("image_id", F.col("rank").cast("long").alias("rank"), "det_id")


def soft_nms(dets: DataFrame, sigma: float = 0.5, floor: float = 0.0, contain: float = 0.9, pairs: DataFrame | None = None) -> DataFrame:
    """(image_id, det_id, score): a detection's score is multiplied by exp(-o^2 / sigma) for each kept one that it
    overlaps by o, the larger of IoU and containment; one contained by ``contain`` gets 0; kept are those that
    reach ``floor``. The order is that of the first scores."""
    o = F.greatest("iou", "containment")
    factor = F.when(F.col("containment") >= contain, 0.0).otherwise(F.exp(-(o * o) / max(sigma, 1e-9)))

    def step(kept: Column, x: Column) -> Column:
        hit = F.filter(F.coalesce(_of(x), F.array()), lambda n: F.exists(kept, lambda k: k["det_id"] == n["other"]))
        s = F.aggregate(hit, x["score"].cast("double"), lambda a, n: a * n["factor"])
        return F.when(s >= floor, F.array_append(kept, F.struct(x["det_id"].alias("det_id"), s.alias("score")))).otherwise(kept)

    none = F.slice(F.transform("d", lambda x: F.struct(x["det_id"].alias("det_id"), x["score"].cast("double").alias("score"))), 1, 0)
    pairs = box_pairs(dets) if pairs is None else pairs
    kept = _ordered(dets, pairs, lambda own: F.lit(True), F.struct("other", "factor"), factor.alias("factor")).select("image_id", F.explode(F.aggregate("d", none, step)).alias("k"))
    return kept.select("image_id", "k.det_id", "k.score")


def mask_edges(runs: DataFrame, dets: DataFrame, within_image: bool) -> DataFrame:
    """image_id, det_id of masks (runs) that reach an edge of their crop; with ``within_image`` only edges that are none
    of the image. dets: image_id, det_id, crop (a struct of a box), height, width."""
    t = masks.tight_boxes(runs, "det_id").join(dets.select("image_id", "det_id", "crop", "height", "width"), ["image_id", "det_id"])
    hit = g.clipped(g.box(), g.box("crop."), F.col("height"), F.col("width")) if within_image else g.touches(g.box(), g.box("crop."))
    return t.filter(hit).select("image_id", "det_id")


def drop_clipped_masks(dets: DataFrame, runs: DataFrame) -> DataFrame:
    """As drop_clipped, by what the masks reach."""
    return dets.join(mask_edges(runs, dets, True), ["image_id", "det_id"], "left_anti")


def drop_clipped(dets: DataFrame) -> DataFrame:
    """Detections that reach no edge of their crop but edges of the image; rows carry crop (a struct of a box), height, width."""
    return dets.filter(~g.clipped(g.box(), g.box("crop."), F.col("height"), F.col("width")))


def fragment_pairs(dets: DataFrame, gap: int) -> DataFrame:
    """Pairs (image_id, a, b) of which one at least is ``partial`` and whose boxes lie within ``gap`` pixels in either direction:
    boxes that share area once one of the two is widened by the gap."""
    wide = dets.select("image_id", F.col("det_id").alias("a"), F.col("partial").alias("pa"), (F.col("y0") - gap).alias("y0"), (F.col("y1") + gap).alias("y1"), (F.col("x0") - gap).alias("x0"), (F.col("x1") + gap).alias("x1"))
    own = dets.select("image_id", F.col("det_id").alias("b"), *_BOX)
    pairs = tiled_overlaps(wide, own, "a", "b", carry=("pa",)).filter("a <> b AND pa")
    return pairs.select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mask_fragment_pairs(runs: DataFrame, partial: DataFrame, gap: int) -> DataFrame:
    """Pairs (image_id, a, b) of masks (runs) with pixels within ``gap`` of each other in either direction, of which one
    at least is in ``partial`` (image_id, det_id)."""
    own = runs.join(partial.select("image_id", "det_id").distinct(), ["image_id", "det_id"], "left_semi")
    wide = own.select("image_id", "det_id", F.explode(F.sequence(F.col("y") - gap, F.col("y") + gap)).alias("y"), (F.col("xs") - gap).alias("xs"), (F.col("xe") + gap).alias("xe"))
    near = packs.overlapping(wide, runs, "det_id", "det_id").filter("a <> b")
    return near.select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merge_fragments(dets: DataFrame, pairs: DataFrame, runs: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """One detection a group that ``pairs`` (image_id, a, b) join (``groups``: their components, if known): the best one's det_id (the first of
    equals) and the largest score, and the union's box, which is that of the masks where ``runs`` are given; others stay."""
    groups = (components(pairs) if groups is None else groups).withColumnRenamed("node", "det_id")
    own = dets.join(sorted_side(groups), ["image_id", "det_id"], "left").withColumn("root", F.coalesce("root", "det_id"))
    if runs is not None:
        own = own.drop(*_BOX).join(masks.tight_boxes(runs, "det_id"), ["image_id", "det_id"])
    best = F.max_by("det_id", F.struct("score", -F.col("det_id")))
    size = F.count("*").alias("pieces")
    return own.groupBy("image_id", "root").agg(best.alias("det_id"), size, F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("score").alias("score")).drop("root")


def joined_masks(dets: DataFrame, runs: DataFrame, drop: bool, gap: int | None) -> tuple[DataFrame, DataFrame]:
    """Detections and their masks (runs) after what their edges say: with ``drop`` those clipped go, and with a ``gap`` those that reach an edge
    of their crop and lie by another are pieces of one object and made one. An image's detections and packed masks meet in one row, so
    each table is shuffled once, and what is done with masks later is done with those that stay. dets have crop, height and width."""
    rows = dets.groupBy("image_id").agg(F.array_agg(F.struct(*[c for c in dets.columns if c != "image_id"])).alias("own"))
    met = packs.boxed(rows.join(sorted_side(packs.by_image(runs, "det_id")), "image_id", "left").withColumn("packed", F.coalesce("packed", F.array())))
    side = lambda x, c: tuple(x[c][n] for n in _BOX)
    edges = lambda x: F.coalesce(g.touches(side(x, "tight"), side(x, "crop")), F.lit(False))
    cut = lambda x: F.coalesce(g.clipped(side(x, "tight"), side(x, "crop"), x["height"], x["width"]), F.lit(False))
    own = F.transform("own", lambda x, i: x.withField("tight", F.get("tight", i)))
    own = F.filter(own, lambda x: ~cut(x)) if drop else own
    own = F.transform(own, lambda x: x.withField("partial", edges(x)))
    held = written(packs.narrowed(met.withColumn("own", own).drop("tight"), gap), "held")
    whole = held.select("image_id", F.explode("own").alias("x"))
    if gap is None:
        none = F.array().cast(f"array<struct<det_id:{dict(dets.dtypes)['det_id']},head:{dict(dets.dtypes)['det_id']}>>")
        return whole.select("image_id", *[f"x.{c}" for c in dets.columns if c != "image_id"]), packs.loose(held.withColumn("names", none), "det_id")
    boxes = whole.filter("x.tight IS NOT NULL").select("image_id", "x.det_id", "x.score", "x.tight.*")
    roots = components(held.select("image_id", F.explode("near").alias("p")).select("image_id", "p.a", "p.b"))
    merged = written(merge_fragments(boxes, None, groups=roots), "merged")
    pieces = boxes.select("image_id", "det_id", "score").join(sorted_side(roots.withColumnRenamed("node", "det_id")), ["image_id", "det_id"])
    heads = pieces.groupBy("image_id", "root").agg(F.max_by("det_id", F.struct("score", -F.col("det_id"))).alias("head"), F.array_agg("det_id").alias("ids"))
    names = heads.groupBy("image_id").agg(F.flatten(F.array_agg(F.transform("ids", lambda i: F.struct(i.alias("det_id"), F.col("head").alias("head"))))).alias("names"))
    return merged, packs.loose(held.join(sorted_side(names), "image_id", "left").withColumn("names", F.coalesce("names", F.array())), "det_id")


def fragments(dets: DataFrame, gap: int = 1, iou: float = 0.5, contain: float = 0.8, pairs: DataFrame | None = None) -> DataFrame:
    """Fragments (``partial``) made one, then nms."""
    return nms(merge_fragments(dets, fragment_pairs(dets, gap)), iou, contain, pairs)


def oracle(dets: DataFrame, gt: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """The detection of largest IoU of each ground truth among those whose own best it is: what any rule could reach at most.
    ``pairs`` (image_id, det_id, gt_id, iou) are those of boxes with ``gt`` unless given."""
    from .matching import oracle_merge, tiled_pairs

    if gt is None and pairs is None:
        raise ValueError("the oracle needs ground truth")
    return oracle_merge(tiled_pairs(dets, gt) if pairs is None else pairs).select("image_id", "det_id")


RULES = {"none": lambda d, **_: d.select("image_id", "det_id"), "nms": nms, "soft": soft_nms, "directional": suppress_directional, "fragments": fragments, "oracle": oracle}


def merge_detections(dets: DataFrame, rule: str = "nms", **options) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {sorted(RULES)}")
    return RULES[rule](dets, **options)


def merge_chain(dets: DataFrame, rule: str = "nms", drop: bool = False, join: bool = False, gap: int = 1, runs: DataFrame | None = None, gt: DataFrame | None = None, gt_runs: DataFrame | None = None, **options) -> DataFrame:
    """What a search emits, made final: provably partial detections go (``drop``), what is left of fragments is joined (``join``), and
    ``rule`` decides over one table of overlaps, of masks where ``runs`` are given, else of boxes. ``none`` skips all of it. nms with
    bounds of 1 and more suppresses nothing. image_id, det_id, y0, y1, x0, x1, score (the rule's, if it gives one)."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {sorted(RULES)}")
    kept = ["image_id", "det_id", *_BOX, "score"]
    if rule == "none":
        return dets.select(*kept)
    joins = join or rule == "fragments"
    if runs is not None and (drop or joins):
        dets, runs = joined_masks(dets, runs, drop, gap if joins else None)
    elif runs is not None:
        runs = runs.join(dets.select("image_id", "det_id"), ["image_id", "det_id"], "left_semi")
    else:
        dets = written(drop_clipped(dets), "whole") if drop else dets
        if joins:
            own = dets if "partial" in dets.columns else dets.withColumn("partial", g.touches(g.box(), g.box("crop.")))
            dets = merge_fragments(own, fragment_pairs(own, gap))
    rule = "nms" if rule == "fragments" else rule
    if rule == "nms" and min(options.get("iou", 0.5), options.get("contain", 0.8)) >= 1:
        return dets.select(*kept)
    if rule == "oracle":
        pairs = None if gt_runs is None or runs is None else masks.overlaps(runs, gt_runs, "det_id", "gt_id")
        left = oracle(dets, gt, pairs)
    else:
        left = RULES[rule](dets, pairs=box_pairs(dets) if runs is None else mask_pairs(runs), **options)
    if "score" in left.columns:
        dets = dets.drop("score")
    return dets.join(left, ["image_id", "det_id"]).select(*kept)
