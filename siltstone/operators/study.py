"""Studies of a score along a ladder of zooms: what it does as a crop closes in on a target and goes beyond."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import ship

#: Sides of a target's crops in units of its own longer side; 1 frames it.
ZOOMS = [0.35, 0.45, 0.55, 0.7, 0.85, 1.0, 1.15, 1.3, 1.5, 1.75, 2.0, 2.5, 3.0]


def ladder(targets: DataFrame, height: Column, width: Column, zooms: list[float] = ZOOMS) -> DataFrame:
    """Targets (image_id, gt_id, box) by zoom: image_id, gt_id, step (from 0, the closest), zoom, the target's box as t_y0 ... and
    the crop's, a square around its centre within the image. Crops are rows, so a target's ladder needs no loop."""
    own = targets.select("image_id", "gt_id", *[F.col(c).alias(f"t_{c}") for c in ("y0", "y1", "x0", "x1")])
    steps = own.select("*", F.posexplode(F.array(*map(F.lit, zooms))).alias("step", "zoom"))
    t = g.box("t_")
    half = F.bround(F.greatest(t[1] - t[0], t[3] - t[2]) * F.col("zoom") / 2, 0).cast("long")
    cy, cx = F.floor((t[0] + t[1]) / 2), F.floor((t[2] + t[3]) / 2)
    zero = F.lit(0).cast("long")
    crop = F.greatest(zero, cy - half), F.least(height, cy + half), F.greatest(zero, cx - half), F.least(width, cx + half)
    return steps.select("*", *[c.cast("long").alias(n) for c, n in zip(crop, ("y0", "y1", "x0", "x1"))])


def framing(crops: DataFrame) -> DataFrame:
    """Adds what a crop shows: pure (the target's share of it) and whole (how much of the target it keeps)."""
    x, t = g.box(), g.box("t_")
    inter = g.intersection(x, t)
    return crops.withColumn("pure", g.ratio(inter, g.area(x))).withColumn("whole", g.ratio(inter, g.area(t)))


#: Scores of synthetic features, a crop's being (pure, 1 - pure, whole) and an exemplar's (1, 0, 1): by the direction of the whole crop, by the mean of
#: what is the target's, and by all parts, where what is missing counts as much.
SCORERS = {
    "cls": "(pure + whole) / (sqrt(2.0D) * sqrt(pure * pure + (1 - pure) * (1 - pure) + whole * whole))",
    "mean": "pure",
    "full": "pure * whole",
}


def scored(crops: DataFrame, scorers: dict[str, str]) -> DataFrame:
    """A row a crop and scorer (a SQL expression): scorer, g."""
    each = F.array(*[F.struct(F.lit(n).alias("scorer"), F.expr(s).alias("g")) for n, s in scorers.items()])
    return crops.select("*", F.explode(each).alias("x")).select("image_id", "gt_id", "step", "zoom", "x.scorer", "x.g")


def ladder_report(scores: DataFrame, anchor: float = 1.0, tol: float = 1e-9) -> DataFrame:
    """Per scorer: targets; refine_rise, the share of steps towards the anchor that raise the score, and overzoom_fall, of those beyond it
    that lower it; the mean rank (1 the best) of the anchor among a target's crops, the mean zoom of a target's best crop (the
    widest of equals) and the share of targets whose score has one peak. All by windows over a target's ladder."""
    own = W.partitionBy("scorer", "image_id", "gt_id")
    down = own.orderBy(F.desc("step"))  # from the widest crop to the closest
    rows = scores.withColumn("g", F.round("g", 12)).withColumn("was", F.lag("g").over(down)).withColumn("rank", F.rank().over(own.orderBy(F.desc("g"))))
    up, fell = F.col("g") > F.col("was") + tol, F.col("g") < F.col("was") - tol
    rows = rows.withColumn("fallen", F.coalesce(F.max(fell.cast("int")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    step = F.col("was").isNotNull()
    per = rows.groupBy("scorer", "image_id", "gt_id").agg(
        F.count_if(step & (F.col("zoom") >= anchor)).alias("in_n"), F.count_if(up & (F.col("zoom") >= anchor)).alias("in_up"),
        F.count_if(step & (F.col("zoom") < anchor)).alias("out_n"), F.count_if(fell & (F.col("zoom") < anchor)).alias("out_down"),
        F.max(F.when(F.col("zoom") == anchor, F.col("rank"))).alias("rank"), F.max_by("zoom", F.struct("g", "zoom")).alias("best"), (F.count_if(up & (F.col("fallen") == 1)) == 0).alias("one_peak"),
    )
    return per.groupBy("scorer").agg(
        F.count("*").alias("targets"), (F.sum("in_up") / F.sum("in_n")).alias("refine_rise"), (F.sum("out_down") / F.sum("out_n")).alias("overzoom_fall"), F.avg("rank").alias("anchor_rank"),
        F.avg("best").alias("best_zoom"), F.avg(F.col("one_peak").cast("double")).alias("one_peak"),
    )


TOTALS = "scorer string, targets long, in_n long, in_up long, out_n long, out_down long, ranked long, ranks long, best double, one_peak long"


def _totals(names: list[str], zooms: list[float], anchor: float, tol: float) -> Callable:
    """Sums over targets, a row a scorer and batch, of crops' scores (a column a scorer), of which each target's come together, from the closest on."""
    n, z = len(zooms), np.array(zooms)
    inner, frames = z[:-1] >= anchor, np.flatnonzero(z == anchor)

    def run(batches):
        rest = np.empty((0, len(names)))
        for b in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)])
            whole = len(rows) // n * n
            rest, found = rows[whole:], []
            for name, own in zip(names, rows[:whole].T):
                x = own.reshape(-1, n)
                was, now = x[:, 1:], x[:, :-1]  # from the widest to the closest, one step each
                step, up, fell = ~np.isnan(was), now > was + tol, now < was - tol
                fallen = np.cumsum(fell[:, ::-1], axis=1)[:, ::-1] - fell > 0
                rank = 1 + (x > x[:, frames[:1]]).sum(axis=1) if len(frames) else np.empty(0, int)
                best = z[n - 1 - np.argmax(np.where(np.isnan(x), -np.inf, x)[:, ::-1], axis=1)]  # the widest of equals
                found.append((name, len(x), step[:, inner].sum(), up[:, inner].sum(), step[:, ~inner].sum(), fell[:, ~inner].sum(), len(rank), rank.sum(), best.sum(), (~(up & fallen).any(axis=1)).sum()))
            if whole:
                kinds = [pa.string()] + [pa.float64() if k == 8 else pa.int64() for k in range(1, 10)]
                yield pa.RecordBatch.from_arrays([pa.array([v if k == 0 else float(v) if k == 8 else int(v) for v in c], t) for k, (c, t) in enumerate(zip(zip(*found), kinds))], [f.split()[0] for f in TOTALS.split(", ")])

    return run


def report(targets: DataFrame, height: Column, width: Column, scorers: dict[str, str] = SCORERS, zooms: list[float] = ZOOMS, anchor: float = 1.0, tol: float = 1e-9) -> DataFrame:
    """ladder_report of the ladders of targets (a row each), straight from them: a target's crops are made in one place and stay there, and only
    sums leave a task. ``zooms`` rise."""
    if sorted(zooms) != list(zooms):
        raise ValueError("zooms must rise")
    ship(targets.sparkSession)
    crops = framing(ladder(targets, height, width, zooms)).select(*[F.round(F.expr(s).cast("double"), 12).alias(n) for n, s in scorers.items()])
    per = crops.mapInArrow(_totals(list(scorers), list(zooms), anchor, tol), TOTALS).groupBy("scorer").agg(*[F.sum(f.split()[0]).alias(f.split()[0]) for f in TOTALS.split(", ")[1:]])
    share = lambda a, b, name: F.try_divide(F.col(a), F.col(b)).alias(name)
    return per.select("scorer", "targets", share("in_up", "in_n", "refine_rise"), share("out_down", "out_n", "overzoom_fall"), share("ranks", "ranked", "anchor_rank"), share("best", "targets", "best_zoom"), share("one_peak", "targets", "one_peak"))
