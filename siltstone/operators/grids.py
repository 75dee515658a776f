"""Operators on grids of cells, in long form: (image_id, r, c, ...). Neighbours are found by
equality joins on shifted coordinates, so a grid's size does not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as a
from .graph import components

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = FOUR + [(-1, -1), (-1, 1), (1, -1), (1, 1)]
AHEAD = {4: [(1, 0), (0, 1)], 8: [(1, 0), (0, 1), (1, 1), (1, -1)]}


def offsets(connectivity: int) -> list[tuple[int, int]]:
    """4 is four neighbours, anything else eight."""
    return FOUR if connectivity == 4 else EIGHT


def neighbours(cells: DataFrame, steps: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """image_id, r, c, the cell's ``keep`` columns, and those of each neighbour with n_ before."""
    step = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in steps])).alias("step")
    out = cells.select("image_id", "r", "c", *keep, step).select("image_id", "r", "c", *keep, (F.col("r") + F.col("step.y")).alias("n_r"), (F.col("c") + F.col("step.x")).alias("n_c"))
    other = cells.select("image_id", F.col("r").alias("n_r"), F.col("c").alias("n_c"), *[F.col(k).alias(f"n_{k}") for k in keep])
    return out.join(other, ["image_id", "n_r", "n_c"])


def cell_id(width: int) -> Column:
    return F.col("r") * width + F.col("c")


def connected(cells: DataFrame, width: int, connectivity: int = 4, label: str | None = None) -> DataFrame:
    """Cells with ``component``, numbered from 1 in raster order per image. With ``label``, only cells of equal labels connect."""
    own = cells.withColumn("cell", cell_id(width))
    keep = ["cell"] + ([label] if label else [])
    pairs = neighbours(own, AHEAD[4 if connectivity == 4 else 8], keep)
    if label:
        pairs = pairs.filter(F.col(label) == F.col(f"n_{label}"))
    roots = components(pairs.select("image_id", F.col("cell").alias("a"), F.col("n_cell").alias("b")))
    joined = own.join(roots.withColumnRenamed("node", "cell"), ["image_id", "cell"], "left").withColumn("root", F.coalesce("root", "cell"))
    number = F.dense_rank().over(W.partitionBy("image_id").orderBy("root")).cast("long")
    return joined.withColumn("component", number).drop("root", "cell")


def hysteresis(cells: DataFrame, width: int, low: Column, high: Column, connectivity: int = 8) -> DataFrame:
    """Cells of components of ``low`` cells that hold a ``high`` one."""
    weak = connected(cells.withColumn("strong", high).filter(low | high), width, connectivity)
    seeds = weak.filter("strong").select("image_id", "component").distinct()
    return weak.join(seeds, ["image_id", "component"], "left_semi").drop("strong")


def adjacency(cells: DataFrame, label: str) -> DataFrame:
    """image_id, a, b (a < b, both positive), border: the number of neighbouring cells of two regions."""
    pairs = neighbours(cells, AHEAD[4], [label]).filter((F.col(label) != F.col(f"n_{label}")) & (F.col(label) > 0) & (F.col(f"n_{label}") > 0))
    return pairs.groupBy("image_id", F.least(label, f"n_{label}").alias("a"), F.greatest(label, f"n_{label}").alias("b")).agg(F.count("*").alias("border"))


def seams(cells: DataFrame, label: str) -> DataFrame:
    """Cells that one of eight neighbours with another positive label touches."""
    pairs = neighbours(cells, EIGHT, [label]).filter((F.col(label) != F.col(f"n_{label}")) & (F.col(label) > 0) & (F.col(f"n_{label}") > 0))
    return pairs.select("image_id", "r", "c").distinct()


def feature_boundary(patches: DataFrame, digits: int = 9) -> DataFrame:
    """image_id, r, c, boundary: 1 less the mean similarity to four neighbours, at least 0, over its largest in the image."""
    pairs = neighbours(patches, FOUR, ["feat"]).withColumn("s", F.round(a.dot(F.col("feat"), F.col("n_feat")), digits))
    own = pairs.groupBy("image_id", "r", "c").agg(F.greatest(F.lit(0.0), 1 - F.avg("s")).alias("b"))
    top = F.max("b").over(W.partitionBy("image_id"))
    return own.select("image_id", "r", "c", F.when(top > 1e-12, F.col("b") / top).otherwise(F.col("b")).alias("boundary"))


def merge_regions(patches: DataFrame, label: str, similarity: float = 0.6, border: float = 0.5) -> DataFrame:
    """image_id, region, merged: neighbouring regions whose prototypes are alike and whose common border is weak become one,
    numbered densely in the order of their least region."""
    from .vectors import prototypes

    own = patches.withColumn("region", F.col(label))
    protos = prototypes(own, ["image_id", "region"])
    weak = own.join(feature_boundary(patches), ["image_id", "r", "c"])
    pairs = neighbours(weak, AHEAD[4], ["region", "boundary"]).filter("region <> n_region")
    edges = pairs.groupBy("image_id", F.least("region", "n_region").alias("a"), F.greatest("region", "n_region").alias("b")).agg(F.avg("boundary").alias("mean"))
    x = protos.select("image_id", F.col("region").alias("a"), F.col("proto").alias("pa"))
    y = protos.select("image_id", F.col("region").alias("b"), F.col("proto").alias("pb"))
    joined = edges.join(x, ["image_id", "a"]).join(y, ["image_id", "b"])
    alike = joined.filter((F.round(a.dot(F.col("pa"), F.col("pb")), 9) >= similarity) & (F.col("mean") <= border))
    roots = components(alike.select("image_id", "a", "b"))
    all_ = own.select("image_id", "region").distinct().join(roots.withColumnRenamed("node", "region"), ["image_id", "region"], "left").withColumn("root", F.coalesce("root", "region"))
    return all_.select("image_id", "region", F.dense_rank().over(W.partitionBy("image_id").orderBy("root")).cast("long").alias("merged"))


def sample_index(target: Column, size: int, cells: int) -> Column:
    """The source cell that the centre of a target cell falls in, of ``size`` source cells for ``cells`` target ones."""
    return F.least(F.lit(size - 1), F.greatest(F.lit(0), F.floor((target + 0.5) * size / cells)))


def resample(cells: DataFrame, size: int, to: int, keep: list[str]) -> DataFrame:
    """A square grid of ``size`` cells a side, read at the centres of one of ``to`` a side."""
    grid = cells.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias("tr")).select("*", F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias("tc"))
    at = grid.withColumn("r", sample_index(F.col("tr"), size, to)).withColumn("c", sample_index(F.col("tc"), size, to))
    return at.join(cells.select("image_id", "r", "c", *keep), ["image_id", "r", "c"]).select("image_id", F.col("tr").cast("long").alias("r"), F.col("tc").cast("long").alias("c"), *keep)


def grid_iou(left: DataFrame, right: DataFrame) -> DataFrame:
    """image_id, iou of two sets of cells of the same lattice, 0 of two empty ones."""
    both = left.select("image_id", "r", "c", F.lit(1).alias("a")).join(right.select("image_id", "r", "c", F.lit(1).alias("b")), ["image_id", "r", "c"], "full")
    return both.groupBy("image_id").agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("iou"))


def top_points(heat: DataFrame, k: int, least: float) -> DataFrame:
    """Per image the k hottest cells that reach ``least`` (raster order of equals)."""
    rank = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("s"), "r", "c")).cast("long")
    return heat.filter(F.col("s") >= least).withColumn("rank", rank).filter(F.col("rank") <= k)
