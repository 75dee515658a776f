"""Average precision, panoptic quality and other scores, as windows and aggregates."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import matching
from .graph import written

THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def by_ranges(df: DataFrame, column: str, name: str, parts: int | None = None, also: DataFrame | None = None, blank: Column | None = None) -> DataFrame:
    """Adds ``name``: the range of ``column`` that a row lies in, of about as many as there are
    shuffle partitions. Global ranks and running totals are then a range's own plus those
    of the ranges before it, so no task sees all rows. Rows of ``also``, which have a column more (``blank`` in those of
    ``df``), are in the same ranges."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    if also is not None:
        df = df.select("*", blank).unionByName(also)
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=column, outputCol=name).transform(df)


def average_precision(dets: DataFrame, won: DataFrame, n_gt: DataFrame) -> DataFrame:
    """threshold, ap: 101-point interpolated AP of detections (score, image_id, det_id) pooled over images, of which ``won`` (threshold, score,
    image_id, det_id) matched; ``n_gt`` has one row, n_gt. A detection's place by score is the same at all thresholds, so it is told
    once: those that won at any threshold are counted in among all of their range of scores (see by_ranges)."""
    none = F.lit(None).cast("double").alias("threshold")
    rows = by_ranges(dets.select("score", "image_id", "det_id"), "score", "range", also=won.select("score", "image_id", "det_id", "threshold"), blank=none)
    all_ = rows.filter("threshold IS NULL").groupBy("range").agg(F.count("*").alias("n"))
    higher = W.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)  # a row a range
    all_ = all_.select("range", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("k0"))
    place = W.partitionBy("range").orderBy(F.desc("score"), "image_id", "det_id", F.asc_nulls_first("threshold")).rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = rows.withColumn("k", F.count_if(F.col("threshold").isNull()).over(place)).filter("threshold IS NOT NULL")
    per = rows.filter("threshold IS NOT NULL").groupBy("threshold", "range").agg(F.count("*").alias("tp"))
    above = W.partitionBy("threshold").orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    per = per.select("threshold", "range", F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("t0")).join(F.broadcast(all_), "range")  # a row a threshold and range
    t = F.row_number().over(W.partitionBy("threshold", "range").orderBy("k"))
    rises = hits.withColumn("t", t).join(F.broadcast(per), ["threshold", "range"]).select("threshold", "range", (F.col("t") + F.col("t0")).alias("t"), (F.col("k") + F.col("k0")).alias("k"))
    # precision only matters where recall rises; its envelope is the maximum from there on
    rises = rises.withColumn("precision", F.col("t") / F.col("k"))
    below = W.partitionBy("threshold").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    tops = rises.groupBy("threshold", "range").agg(F.max("precision").alias("top")).select("threshold", "range", F.max("top").over(below).alias("later"))
    own = F.max("precision").over(W.partitionBy("threshold", "range").orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, W.currentRow))
    rises = rises.withColumn("own", own).join(F.broadcast(tops), ["threshold", "range"]).withColumn("envelope", F.greatest("own", "later")).crossJoin(F.broadcast(n_gt))
    # of the levels 0, 0.01, ... 1, those that this rise is the first to reach
    reached = lambda t: F.floor(t * 100 / F.col("n_gt") + 1e-9)
    levels = F.when(F.col("t") == 1, reached(F.col("t")) + 1).otherwise(reached(F.col("t")) - reached(F.col("t") - 1))
    return rises.groupBy("threshold").agg((F.sum(levels * F.col("envelope")) / 101).alias("ap"))


def coco_ap(dets: DataFrame, gt: DataFrame, thresholds: list[float] = THRESHOLDS, pairs: DataFrame | None = None) -> DataFrame:
    """threshold, ap. ``pairs`` (image_id, det_id, score, gt_id, iou) are those of boxes unless given."""
    pairs = matching.tiled_pairs(dets, gt, least=min(thresholds)) if pairs is None else pairs
    won = written(matching.matches_at(pairs, thresholds).select("threshold", "score", "image_id", "det_id"), "won")  # read twice
    found = average_precision(dets, won, gt.agg(F.count("*").alias("n_gt")))
    all_ = dets.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return all_.join(found, "threshold", "left").na.fill(0.0, ["ap"])


def summarize(ap: DataFrame) -> DataFrame:
    at = lambda t: F.max(F.when(F.col("threshold") == t, F.col("ap")))
    return ap.agg(F.avg("ap").alias("ap"), at(0.5).alias("ap50"), at(0.75).alias("ap75"))


def _quality(dets: DataFrame, gt: DataFrame, threshold: float, pairs: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, pq, sq, rq, count_abs, count_rel. A true positive counts with its detection's largest IoU over all ground truths,
    not the matched one's; both reach the threshold, so pairs below it are not needed."""
    won = matching.greedy_match(pairs, threshold).select("image_id", "det_id")
    best = pairs.groupBy("image_id", "det_id").agg(F.max("iou").alias("best"))
    hits = won.join(best, ["image_id", "det_id"]).agg(F.count("*").alias("tp"), F.coalesce(F.sum("best"), F.lit(0.0)).alias("s"))
    per = dets.groupBy("image_id").agg(F.count("*").alias("p")).join(gt.groupBy("image_id").agg(F.count("*").alias("g")), "image_id", "full").na.fill(0)
    diff = F.abs(F.col("p") - F.col("g"))
    counts = per.agg(F.sum("p").alias("np"), F.sum("g").alias("ng"), F.avg(diff).alias("count_abs"), F.avg(diff / F.greatest(F.col("g"), F.lit(1))).alias("count_rel"))
    all_ = hits.crossJoin(counts).withColumn("fp", F.col("np") - F.col("tp")).withColumn("fn", F.col("ng") - F.col("tp"))
    whole = F.col("tp") + F.col("fp") / 2 + F.col("fn") / 2
    return all_.select("tp", "fp", "fn", (F.col("s") / whole).alias("pq"), F.when(F.col("tp") > 0, F.col("s") / F.col("tp")).otherwise(0.0).alias("sq"), (F.col("tp") / whole).alias("rq"), "count_abs", "count_rel")


def panoptic(dets: DataFrame, gt: DataFrame, threshold: float = 0.5, pairs: DataFrame | None = None) -> DataFrame:
    """One row: tp, fp, fn, pq, sq, rq, count_abs, count_rel (see _quality), recovery."""
    pairs = written(matching.tiled_pairs(dets, gt), "pairs") if pairs is None else pairs  # read three times
    found = pairs.groupBy("image_id", "gt_id").agg(F.max("iou").alias("m"))
    recovery = gt.join(found, ["image_id", "gt_id"], "left").agg(F.avg(F.coalesce("m", F.lit(0.0))).alias("recovery"))
    return _quality(dets, gt, threshold, pairs).crossJoin(recovery)


def evaluate(dets: DataFrame, gt: DataFrame, det_runs: DataFrame | None = None, gt_runs: DataFrame | None = None, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """One row of all metrics: box_ap, box_ap50, box_ap75, box_ap_<threshold>, pq, sq, rq, mean_iou, count_error, count_error_rel,
    n_pred, n_gt, and with masks (runs by det_id and gt_id) ap, ap50, ap75 and ap_<threshold>; pq is of the masks where there are any.
    No metric of these looks at a pair below the lowest threshold, so none is kept."""
    masked, least = None, min(0.5, *thresholds)
    if det_runs is not None:
        from . import masks

        masked = written(masks.overlaps(det_runs, gt_runs, "det_id", "gt_id").filter(F.col("iou") >= least).join(dets.select("image_id", "det_id", "score"), ["image_id", "det_id"]), "pairs")
    boxed = written(matching.image_pairs(dets, gt, least), "pairs")

    def wide(prefix: str, pairs: DataFrame) -> DataFrame:
        per = coco_ap(dets, gt, thresholds, pairs)
        at = [F.max(F.when(F.col("threshold") == t, F.col("ap"))) for t in thresholds]
        own = [F.avg("ap").alias(f"{prefix}ap"), *[a.alias(f"{prefix}ap_{t:.2f}") for t, a in zip(thresholds, at)]]
        own += [a.alias(f"{prefix}ap{round(100 * t)}") for t, a in zip(thresholds, at) if t in (0.5, 0.75)]
        return per.agg(*own)

    p = _quality(dets, gt, 0.5, boxed if masked is None else masked)
    n = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    out = p.select("pq", "sq", "rq", F.col("sq").alias("mean_iou"), F.col("count_abs").alias("count_error"), F.col("count_rel").alias("count_error_rel"), n[0].alias("n_pred"), n[1].alias("n_gt"))
    out = out.crossJoin(wide("box_", boxed))
    return out if masked is None else out.crossJoin(wide("", masked))


def to_rows(metrics: DataFrame) -> DataFrame:
    """The columns of a row of metrics as rows (metric, value)."""
    return metrics.select(F.explode(F.create_map(*[x for c in metrics.columns for x in (F.lit(c), F.col(f"`{c}`").cast("double"))])).alias("metric", "value"))


def exemplar_recovery(pairs: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Mean over exemplars (image_id, gt_id) of the largest IoU that any detection has with one."""
    best = pairs.groupBy("image_id", "gt_id").agg(F.max("iou").alias("m"))
    return exemplars.join(best, ["image_id", "gt_id"], "left").agg(F.avg(F.coalesce("m", F.lit(0.0))).alias("recovery"))


def auroc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve of (score, positive): the Mann-Whitney statistic by average ranks, from
    counts per distinct score; those are ranked by ranges, so no task sees all. NULL if a side is empty."""
    per = scores.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    per = by_ranges(written(per, "scores"), "score", "range")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    ranges = per.groupBy("range").agg(F.sum("n").alias("own")).select("range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = per.withColumn("below", own).join(ranges, "range").withColumn("won", F.col("p") * (F.col("below") + F.col("before") + F.col("n") / 2)).agg(F.sum("won").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / F.col("p") / F.col("n")).alias("auroc"))


def exact_percentile(values: DataFrame, by: str, column: str, share: float) -> DataFrame:
    """by, value: the percentile of each group by linear interpolation. The two ranks it lies between are looked for by
    counts of distinct values in ranges, so a hot group is never in one task."""
    per = values.filter(F.col(column).isNotNull()).groupBy(by, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    per = by_ranges(written(per, "values"), "v", "range")
    size = per.groupBy(by, "range").agg(F.sum("n").alias("own"))
    size = size.select(by, "range", (F.sum("own").over(W.partitionBy(by).orderBy("range")) - F.col("own")).alias("before"), F.sum("own").over(W.partitionBy(by)).alias("all"), "own")
    at = (F.col("all") - 1) * F.lit(share)
    wanted = size.filter((F.col("before") <= F.ceil(at)) & (F.col("before") + F.col("own") > F.floor(at)))
    reach = F.sum("n").over(W.partitionBy(by, "range").orderBy("v")) + F.col("before")
    rows = per.join(wanted, [by, "range"]).withColumn("reach", reach)
    lo = F.min(F.when(F.col("reach") > F.floor(at), F.col("v")))
    hi = F.min(F.when(F.col("reach") > F.ceil(at), F.col("v")))
    found = rows.groupBy(by).agg(lo.alias("lo"), hi.alias("hi"), F.first(at - F.floor(at)).alias("part"))
    return found.select(by, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))


def runtime_summary(times: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return times.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_pop(x).alias("std"), F.sum(x).alias("total"), (F.count(x) / F.sum(x)).alias("throughput"))
