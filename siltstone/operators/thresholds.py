"""Adaptive thresholds over a map of scores: rows (by, s)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import minmax


def otsu(scores: DataFrame, by: list[str], column: str = "s", bins: int = 256) -> DataFrame:
    """by, tau: the centre of the bin after which the between-class variance is largest (the first of
    equals); the least value where all are equal."""
    x = F.col(column)
    ends = scores.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    wide = F.col("hi") - F.col("lo")
    bin_ = F.when(wide < 1e-9, 0).otherwise(F.least(F.floor((x - F.col("lo")) / wide * bins), F.lit(bins - 1)))
    counts = scores.join(ends, by).groupBy(*by, "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("n"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * wide / bins
    counts = counts.withColumn("m", centre)
    so_far, all_ = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy(*by)
    sums = counts.withColumn("total", F.sum("n").over(all_)).withColumn("w", F.sum("n").over(so_far) / F.col("total")).withColumn("mu", F.sum(F.col("n") * F.col("m")).over(so_far) / F.col("total")).withColumn("mt", F.sum(F.col("n") * F.col("m")).over(all_) / F.col("total"))
    rest = F.col("w") * (1 - F.col("w"))
    between = F.when(rest > 1e-12, F.round((F.col("mt") * F.col("w") - F.col("mu")) * (F.col("mt") * F.col("w") - F.col("mu")) / rest, 12)).otherwise(0.0)
    best = sums.withColumn("v", between).groupBy(*by, "lo", "hi").agg(F.max_by("m", F.struct("v", -F.col("bin"))).alias("m"))
    return best.select(*by, F.when(wide < 1e-9, F.col("lo")).otherwise(F.col("m")).alias("tau"))


def separability(scores: DataFrame, taus: DataFrame, by: list[str], column: str = "s") -> DataFrame:
    """by, eta: between-class over total variance of the cut at tau; 0 where a side is empty or nothing varies."""
    x, high = F.col(column), F.col(column) >= F.col("tau")
    cut = scores.join(taus, by).groupBy(*by).agg(F.avg(high.cast("double")).alias("w"), F.avg(F.when(high, x)).alias("a"), F.avg(F.when(~high, x)).alias("b"), F.var_pop(x).alias("v"))
    gap = F.col("a") - F.col("b")
    eta = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.col("v") < 1e-12), 0.0).otherwise(F.least(F.lit(1.0), F.col("w") * (1 - F.col("w")) * gap * gap / F.col("v")))
    return cut.select(*by, eta.alias("eta"))


def percentile_cut(scores: DataFrame, by: list[str], percent: float, column: str = "s") -> DataFrame:
    """by, tau by linear interpolation."""
    return scores.groupBy(*by).agg(F.percentile(column, percent / 100).alias("tau"))


def minmax_map(scores: DataFrame, by: list[str], column: str = "s") -> DataFrame:
    own = W.partitionBy(*by)
    return scores.withColumn(column, minmax(F.col(column), F.min(column).over(own), F.max(column).over(own)))


def foreground(scores: DataFrame, taus: DataFrame, by: list[str], column: str = "s") -> DataFrame:
    return scores.join(taus, by).withColumn("fg", F.col(column) >= F.col("tau")).drop("tau")


def gmm2_threshold(x: np.ndarray, rounds: int = 50) -> float:
    """Where the upper of two normal components, fitted by EM from the quartiles, first is the likelier one on a grid
    of 256 points between their means; the middle of these if it never is."""
    if len(x) == 0 or x.max() - x.min() < 1e-9:
        return float(x.min()) if len(x) else float("nan")
    mean, var, share = np.percentile(x, [25, 75]), np.full(2, x.var() + 1e-6), np.full(2, 0.5)

    def density(v: np.ndarray) -> np.ndarray:
        return share * np.exp(-((v[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var)

    for _ in range(rounds):
        d = density(x)
        r = d / (d.sum(axis=1, keepdims=True) + 1e-12)
        n = r.sum(axis=0) + 1e-12
        mean = (r * x[:, None]).sum(axis=0) / n
        var = (r * (x[:, None] - mean) ** 2).sum(axis=0) / n + 1e-6
        share = n / len(x)
    grid = np.linspace(mean.min(), mean.max(), 256)
    d, high = density(grid), int(np.argmax(mean))
    wins = np.flatnonzero(d[:, high] >= d[:, 1 - high])
    return float(grid[wins[0]]) if len(wins) else float(mean.mean())


def gmm2(scores: DataFrame, by: str, column: str = "s") -> DataFrame:
    """by, tau; a group is one map of scores."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [rows[by].iloc[0]], "tau": [gmm2_threshold(rows[column].to_numpy(dtype=float))]})

    return scores.select(by, column).groupBy(by).applyInPandas(run, f"{by} long, tau double")


def dynamic(similarity, scale: float, aggregate_scale: float, static: tuple[float, float]):
    """(cut, aggregation cut) from a crop's exemplar similarity; the static ones where it is NULL."""
    low = F.coalesce(F.greatest(F.lit(0.05), F.least(F.lit(0.95), scale * (1 - similarity))), F.lit(static[0]))
    return low, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(0.95), aggregate_scale * similarity)), F.lit(static[1]))
