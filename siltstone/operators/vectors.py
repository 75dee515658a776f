"""Similarities of patch vectors to exemplars, prototypes and re-identification scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as a
from ..session import ship

#: An exemplar bank of at most so many numbers is sent to every task; a larger one is joined in blocks of rows.
BANK_NUMBERS = 4_000_000


def similarities(patches: DataFrame, exemplars: DataFrame, digits: int = 9) -> DataFrame:
    """image_id, patch_id, r, c, class_id, ex_id, s: the dot product of every patch with every exemplar.

    The bank is checked to be small and then sent to all tasks; beyond the bound, patches meet
    blocks of it by a salted equality join, so that no side is ever sent whole."""
    size = exemplars.select(F.count("*").alias("n"), F.sum(F.size("feat")).alias("d")).first()
    bank = exemplars.select(F.col("class_id"), F.col("ex_id"), F.col("feat").alias("e"))
    s = F.round(a.dot(F.col("feat"), F.col("e")), digits).alias("s")
    if (size.d or 0) <= BANK_NUMBERS:
        both = patches.drop("class_id").crossJoin(F.broadcast(bank))
    else:
        blocks = -(-size.d // BANK_NUMBERS)
        bank = bank.withColumn("block", F.pmod(F.xxhash64("ex_id"), F.lit(blocks)))
        both = patches.drop("class_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(bank, "block")
    return both.select("image_id", "patch_id", "r", "c", "class_id", "ex_id", s)


def nearest_exemplars(patches: DataFrame, bank: np.ndarray, ids: list[int], k: int, digits: int = 9) -> DataFrame:
    """patch_id, ex_id, s, rank of each patch's k most similar exemplars (the lower id of equals): a matrix product a batch, so that
    the n x m similarities are never rows. The bank (a row an exemplar, ids rising) must be of at most ``BANK_NUMBERS`` numbers."""
    if bank.size > BANK_NUMBERS:
        raise ValueError("the bank is too large to be sent to all tasks")
    ship(patches.sparkSession)
    most, of = min(max(1, k), len(ids)), np.array(ids)

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.iloc[at : at + 4096]
                s = np.round(np.stack(part["feat"].to_numpy()) @ bank.T, digits)
                order = np.argsort(-s, axis=1, kind="stable")[:, :most]
                yield pd.DataFrame({"patch_id": np.repeat(part["patch_id"].to_numpy(), most), "ex_id": of[order].ravel(), "s": np.take_along_axis(s, order, axis=1).ravel(), "rank": np.tile(np.arange(1, most + 1), len(part))})

    return patches.select("patch_id", "feat").mapInPandas(run, "patch_id long, ex_id long, s double, rank long")


def top_k(patches: DataFrame, exemplars: DataFrame, k: int) -> DataFrame:
    """As top_exemplars of all similarities; with a bank of at most ``BANK_NUMBERS`` numbers without ever listing them."""
    size = exemplars.select(F.sum(F.size("feat")).alias("d")).first().d or 0
    if not size or size > BANK_NUMBERS:
        return top_exemplars(similarities(patches, exemplars), k)
    rows = exemplars.orderBy("ex_id").collect()
    return nearest_exemplars(patches, np.array([r.feat for r in rows]), [r.ex_id for r in rows], k)


def dimension_means(rows: DataFrame, by: list[str], column: str = "feat") -> DataFrame:
    """by, mean: the vector of means."""
    long = rows.select(*by, F.posexplode(column).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.array_agg(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))


def prototypes(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, proto: the normalised mean vector."""
    return dimension_means(rows, by).select(*by, a.l2_normalize(F.col("mean")).alias("proto"))


def standardized(patches: DataFrame) -> DataFrame:
    """Per image, each dimension less its mean over its sample deviation (1e-8 added), then normalised."""
    long = patches.select("image_id", "patch_id", F.posexplode("feat").alias("i", "x"))
    stats = long.groupBy("image_id", "i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("d"))
    per = stats.groupBy("image_id").agg(F.array_sort(F.array_agg(F.struct("i", "m", "d"))).alias("p"))
    z = F.zip_with("feat", "p", lambda x, p: (x - p["m"]) / (F.coalesce(p["d"], F.lit(0.0)) + a.EPS))
    return patches.join(per, "image_id").withColumn("feat", z).withColumn("feat", a.l2_normalize(F.col("feat"))).drop("p")


def stacked(patches: DataFrame, cells: DataFrame) -> DataFrame:
    """The patches (image_id, r, c, ...) that any of the masks' ``cells`` (image_id, r, c) covers, each once however many do."""
    return patches.join(cells.select("image_id", "r", "c"), ["image_id", "r", "c"], "left_semi")


def top_exemplars(sims: DataFrame, k: int) -> DataFrame:
    """Per patch its k most similar exemplars (the lower id of equals), k at least 1: patch_id, ex_id, s, rank."""
    rank = F.row_number().over(W.partitionBy("patch_id").orderBy(F.desc("s"), "ex_id")).cast("long")
    return sims.withColumn("rank", rank).filter(F.col("rank") <= max(1, k)).select("patch_id", "ex_id", "s", "rank")


def nearest(sims: DataFrame) -> DataFrame:
    """Per patch the nearest exemplar (the first of equals) and its class."""
    best = F.max_by(F.struct("ex_id", "class_id", "s"), F.struct("s", -F.col("ex_id")))
    return sims.groupBy("image_id", "patch_id").agg(best.alias("b")).select("image_id", "patch_id", "b.ex_id", "b.class_id", "b.s")


def heatmap(sims: DataFrame) -> DataFrame:
    """Per patch the largest similarity to any exemplar."""
    return sims.groupBy("image_id", "patch_id", "r", "c").agg(F.max("s").alias("s"))


def reid_scores(sims: DataFrame, top_k: int = 0, target: str = "image_id") -> DataFrame:
    """Per target and class: the mean over the target's vectors of the largest similarity to an exemplar's
    vectors, averaged over the ``top_k`` best exemplars (0, or more than there are: over all)."""
    per = sims.groupBy(target, "class_id", "ex_id", "patch_id").agg(F.max("s").alias("s")).groupBy(target, "class_id", "ex_id").agg(F.avg("s").alias("s"))
    rank = F.row_number().over(W.partitionBy(target, "class_id").orderBy(F.desc("s"), "ex_id"))
    chosen = per.withColumn("rank", rank).filter(F.col("rank") <= top_k) if top_k else per
    return chosen.groupBy(target, "class_id").agg(F.avg("s").alias("g"))


def score_modes(sims: DataFrame, inside) -> DataFrame:
    """Per image five readings of one pass: mean and maximum over all patches, over those ``inside``, and their share."""
    own = sims.groupBy("image_id", "patch_id", "r", "c").agg(F.max("s").alias("s")).withColumn("in", inside)
    masked = F.when(F.col("in"), F.col("s"))
    return own.groupBy("image_id").agg(F.avg("s").alias("mean_all"), F.max("s").alias("max_all"), F.avg(masked).alias("mean_in"), F.max(masked).alias("max_in"), F.avg(F.col("in").cast("double")).alias("share_in"))


def cluster_aggregate(patches: DataFrame, sims: DataFrame, keep: float) -> DataFrame:
    """Per image and cluster (class_id of the patch): area share, mean forward similarity (cross), similarity of its
    prototype to the seed cluster's (intra; the seed is the one of largest cross), their product, and whether it is kept."""
    best = sims.groupBy("image_id", "patch_id").agg(F.max("s").alias("s"))
    own = patches.join(best, ["image_id", "patch_id"])
    stats = own.groupBy("image_id", "class_id").agg(F.count("*").alias("n"), F.avg("s").alias("cross"))
    whole = W.partitionBy("image_id")
    stats = stats.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("seed", F.max_by("class_id", F.struct("cross", -F.col("class_id"))).over(whole) == F.col("class_id"))
    protos = prototypes(patches, ["image_id", "class_id"])
    stats = stats.join(protos, ["image_id", "class_id"])
    seeds = stats.filter("seed").select("image_id", F.col("proto").alias("seed_proto"))
    intra = F.round(a.dot(F.col("proto"), F.col("seed_proto")), 9)
    scored = stats.join(seeds, "image_id").withColumn("intra", intra).withColumn("combined", F.col("cross") * F.col("intra") * F.when(F.col("seed"), 1.0).otherwise(F.col("share")))
    return scored.select("image_id", "class_id", "share", "cross", "intra", "combined", "seed", ((F.col("combined") > keep) | F.col("seed")).alias("kept"))


def gram(rows: DataFrame, column: str = "feat", centred: bool = True) -> DataFrame:
    """i, j (from 1), value: the sums of products of all pairs of dimensions, of vectors less their mean if ``centred``. A partition adds
    up its vectors' outer products, so D * D numbers leave it whatever it holds; a 1 behind each vector gives the sums and their number."""
    ship(rows.sparkSession)

    def outer(batches):
        total = None
        for b in batches:
            for at in range(0, len(b), 8192):
                x = np.stack(b["x"].iloc[at : at + 8192].to_numpy()).astype(float)
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"d": [len(total) - 1], "s": [total.ravel()]})

    parts = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("x")).mapInPandas(outer, "d int, s array<double>")
    cells = parts.select("d", F.posexplode("s").alias("at", "s")).groupBy("d", "at").agg(F.sum("s").alias("s"))
    i, j = F.expr("at div (d + 1)"), F.col("at") % (F.col("d") + 1)
    cells = cells.select("d", (i + 1).alias("i"), (j + 1).cast("long").alias("j"), "s")
    own = cells.filter("i <= d AND j <= d")
    if not centred:
        return own.select("i", "j", F.col("s").alias("value"))
    sums = cells.filter("j = d + 1 AND i <= d").select(F.col("i").alias("k"), F.col("s").alias("sum"))  # a row a dimension
    n = cells.filter("i = d + 1 AND j = d + 1").select(F.col("s").alias("n"))
    both = own.join(F.broadcast(sums.toDF("i", "si")), "i").join(F.broadcast(sums.toDF("j", "sj")), "j").crossJoin(F.broadcast(n))
    return both.select("i", "j", (F.col("s") - F.col("si") * F.col("sj") / F.col("n")).alias("value"))


def positional_basis(noise: DataFrame, size: int, column: str = "feat") -> list[list[float]]:
    """The first right singular vectors of centred features, from their Gram matrix (D * D numbers, whatever the rows): what
    patches of noise have in common is their place. Each vector's largest part is positive."""
    cells = gram(noise, column).collect()
    d = max((r.i for r in cells), default=0)
    g = np.zeros((d, d))
    for r in cells:
        g[r.i - 1, r.j - 1] = r.value
    values, found = np.linalg.eigh((g + g.T) / 2)
    top = found[:, np.argsort(-values, kind="stable")[:size]].T
    return [(v * np.sign(v[np.argmax(np.abs(v))])).tolist() for v in top]
