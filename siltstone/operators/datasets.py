"""Dataset preparation: metadata joins, filters, pools, known/unknown splits and evaluation items.

Random choices are orders by md5 of an id and the seed: the same on any engine and cluster,
with no generator whose state would tie images to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffled(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))))


def image_scan(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with their annotations; images without any stay."""
    return images.join(annotations, "image_id", "left").select("image_id", "height", "width", "ann_id", "category_id", F.when(F.col("ann_id").isNotNull(), F.coalesce("area", F.lit(0.0))).alias("area"))


def file_name(info: Column) -> Column:
    """file_name, else the last part of coco_url, else of flickr_url, else an error."""
    last = lambda c: F.substring_index(c, "/", -1)
    filled = lambda n: F.when(F.length(info[n]) > 0, info[n])
    return F.coalesce(filled("file_name"), last(filled("coco_url")), last(filled("flickr_url")), F.raise_error(F.lit("an image has no file name")))


def of_categories(annotations: DataFrame, ids: list[int]) -> DataFrame:
    """Annotations of the categories, class_id their place in the list from 1 on."""
    if not ids:
        return annotations.withColumn("class_id", F.col("category_id"))
    spark = annotations.sparkSession
    remap = spark.createDataFrame([(c, i + 1) for i, c in enumerate(ids)], "category_id long, class_id long")
    return annotations.join(F.broadcast(remap), "category_id")


def filtered(images: DataFrame, annotations: DataFrame, ids: list[int]) -> DataFrame:
    """All images, each with its annotations of the categories (class_id from 1 on); images without any stay."""
    return images.join(of_categories(annotations, ids), "image_id", "left")


def with_instances(annotations: DataFrame, least: int) -> DataFrame:
    """image_id, n of images with at least ``least`` annotations."""
    return annotations.groupBy("image_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def some(rows: DataFrame, what: str) -> DataFrame:
    """The rows, or an error if there are none."""
    if rows.isEmpty():
        raise ValueError(f"no {what} is left")
    return rows


def pair_stats(images: DataFrame, annotations: DataFrame, image_size: int = 768, patch: int = 16) -> DataFrame:
    """Per image and category: n, and the square root of the median area in patches of the resized image."""
    own = annotations.groupBy("image_id", "category_id").agg(F.count("*").alias("n"), F.median("area").alias("m"))
    side = F.sqrt("m") / F.greatest("width", "height") * image_size / patch
    return own.join(images, "image_id").select("image_id", "category_id", "n", side.alias("patches"))


def slice_pairs(pairs: DataFrame, n_images: int, min_instances: int, max_patches: float | None, seed: int = 0) -> DataFrame:
    """A sampled slice: ``n_images`` images with an eligible pair, in shuffled order, and one shuffled category of each."""
    ok = pairs.filter((F.col("n") >= min_instances) & (F.lit(True) if max_patches is None else F.col("patches") <= max_patches))
    pick = F.row_number().over(W.partitionBy("image_id").orderBy(shuffled(seed, "image_id", "category_id")))
    one = ok.withColumn("k", pick).filter("k = 1").drop("k")
    return one.orderBy(shuffled(seed, "image_id"), "image_id").limit(n_images).select("image_id", "category_id", "n")


def image_order(images: DataFrame, strategy: str, seed: int = 0) -> list[Column]:
    if strategy == "first":
        return [F.col("image_id")]
    if strategy == "densest":
        return [F.desc("n"), F.col("image_id")]
    if strategy == "random":
        return [shuffled(seed, "image_id"), F.col("image_id")]
    raise ValueError(f"strategy {strategy!r} is none of densest, first, random")


def global_rank(df: DataFrame, order: str, digits: int = 3) -> DataFrame:
    """Adds ``rank`` from 1 by a column of hexadecimal text, by ranges of its first ``digits`` (four bits a digit: more for tables
    beyond some hundred million rows): a range's size plus those before it."""
    own = df.withColumn("range", F.substring(order, 1, digits))
    per = own.groupBy("range").agg(F.count("*").alias("n"))
    before = per.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("range").orderBy(order, "image_id"))
    return own.withColumn("k", rank).join(before, "range").withColumn("rank", (F.col("k") + F.col("before")).cast("long")).drop("k", "before", "range")


def pools(counted: DataFrame, n_train: int, n_inter: int, seed: int = 0) -> DataFrame:
    """image_id, pool: the first n_train of a shuffle are train, the next n_inter inter (-1: all that are left). Asking for more
    images than there are is an error."""
    asked = max(0, n_train) + max(0, n_inter)
    if asked and (there := counted.count()) < asked:
        raise ValueError(f"{asked} images are asked for, there are {there}")
    ranked = global_rank(counted.withColumn("key", shuffled(seed, "image_id")), "key")
    last = F.lit(True) if n_inter < 0 else F.col("rank") <= n_train + n_inter
    pool = F.when(F.lit(n_train < 0) | (F.col("rank") <= n_train), "train").when(last, "inter")
    return ranked.select("image_id", pool.alias("pool")).filter("pool IS NOT NULL")


def pu_split(annotations: DataFrame, ratio: float, seed: int = 0, stratified: bool = True) -> DataFrame:
    """image_id, ann_id, part: known are ceil(ratio n) of an image's instances, stratified first one of each category."""
    order = shuffled(seed, "image_id", "ann_id")
    image = W.partitionBy("image_id")
    first = F.row_number().over(W.partitionBy("image_id", "category_id").orderBy(order, "ann_id")) == 1
    own = annotations.withColumn("first", first if stratified else F.lit(False)).withColumn("o", order)
    own = own.withColumn("n", F.count("*").over(image)).withColumn("classes", F.sum(F.col("first").cast("int")).over(image))
    rank = F.row_number().over(image.orderBy(F.desc("first"), "o", "ann_id"))
    known = F.greatest(F.lit(1), F.col("classes"), F.ceil(F.col("n") * ratio))
    return own.withColumn("rank", rank).select("image_id", "ann_id", F.when(F.col("rank") <= known, "known").otherwise("unknown").alias("part"))


def split_collisions(split: DataFrame) -> DataFrame:
    """image_id, n_splits, n_distinct known sets, of rows (seed, image_id, ann_id, part)."""
    sets = split.filter("part = 'known'").groupBy("image_id", "seed").agg(F.array_join(F.array_sort(F.collect_list("ann_id")).cast("array<string>"), ",").alias("s"))
    return sets.groupBy("image_id").agg(F.count("*").alias("n_splits"), F.countDistinct("s").alias("n_distinct"))


def recommended_min_instances(ratio: float, n_splits: int, limit: int = 500) -> int | None:
    """The least N below ``limit`` with at least ``n_splits`` ways to choose ceil(N ratio) of N."""
    from math import ceil, comb

    return next((n for n in range(1, limit) if comb(n, min(n, ceil(n * ratio))) >= n_splits), None)


def support_best(known: DataFrame, shots: int) -> DataFrame:
    """Per category the image with most known instances (the first of equals) and its first ``shots`` of them."""
    counts = known.groupBy("category_id", "image_id").agg(F.count("*").alias("n"))
    best = counts.groupBy("category_id").agg(F.max_by(F.struct("image_id", "n"), F.struct("n", -F.col("image_id"))).alias("b")).select("category_id", "b.image_id", "b.n")
    rank = F.row_number().over(W.partitionBy("category_id").orderBy("ann_id")).cast("long")
    return known.join(best, ["category_id", "image_id"]).withColumn("shot", rank).filter(F.col("shot") <= shots).select("category_id", "image_id", "n", "shot", "ann_id")


def intra_items(annotations: DataFrame, split: DataFrame, most: int) -> DataFrame:
    """Per image the category most common among its known instances (the least of equals), its exemplars (at most
    ``most``) and all its instances, prompts included. What the split does not name is unknown."""
    own = annotations.join(split, ["image_id", "ann_id"], "left")
    per = own.groupBy("image_id", "category_id").agg(F.count_if(F.col("part") == "known").alias("k"), F.count("*").alias("n_gt"))
    best = per.filter("k > 0").groupBy("image_id").agg(F.max_by(F.struct("category_id", "k", "n_gt"), F.struct("k", -F.col("category_id"))).alias("b"))
    return best.select("image_id", "b.category_id", F.least(F.col("b.k"), F.lit(most)).alias("n_exemplars"), "b.n_gt")


def inter_items(annotations: DataFrame, support: DataFrame) -> DataFrame:
    """Per novel image the most frequent category that has support (the least of equals), and its support image."""
    per = annotations.groupBy("image_id", "category_id").agg(F.count("*").alias("n_gt"))
    has = support.select("category_id", F.col("image_id").alias("support_image_id")).distinct()
    ok = per.join(has, "category_id").filter("image_id <> support_image_id")
    best = ok.groupBy("image_id").agg(F.max_by(F.struct("category_id", "support_image_id", "n_gt"), F.struct("n_gt", -F.col("category_id"))).alias("b"))
    return best.select("image_id", "b.category_id", "b.support_image_id", "b.n_gt")


def named(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Items with their category's class_name (from category_id, class_name); the id as text where it has none. Categories are few: a row a class."""
    names = classes.groupBy("category_id").agg(F.min("class_name").alias("class_name"))
    return items.join(names, "category_id", "left").withColumn("class_name", F.coalesce("class_name", F.col("category_id").cast("string")))


def largest_exemplar(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Per category the image of largest area (the least id of equals) that holds it, and its largest instance there."""
    best = F.max_by(F.struct("image_id", "ann_id"), F.struct("pixels", -F.col("image_id"), "area", -F.col("ann_id")))
    own = annotations.join(images.select("image_id", (F.col("height") * F.col("width")).alias("pixels")), "image_id")
    return own.groupBy("category_id").agg(best.alias("b")).select("category_id", "b.image_id", "b.ann_id")


def slice_summary(pairs: DataFrame) -> DataFrame:
    """Of a slice (image_id, category_id, n): images, instances, the fewest and most an image, classes."""
    return pairs.agg(F.countDistinct("image_id").alias("n_images"), F.sum("n").alias("n_instances"), F.min("n").alias("least"), F.max("n").alias("most"), F.countDistinct("category_id").alias("n_classes"))


def samples(images: DataFrame, annotations: DataFrame, split: DataFrame) -> DataFrame:
    """One row an image: its instances as an array (ann_id, category_id, known), and how many are known and unknown. An instance that the
    split does not name is unknown; images without instances have an empty array."""
    part = F.coalesce(F.col("part") == "known", F.lit(False))
    own = annotations.join(split, ["image_id", "ann_id"], "left").groupBy("image_id").agg(F.array_sort(F.array_agg(F.struct("ann_id", "category_id", part.alias("known")))).alias("instances"))
    out = images.join(own, "image_id", "left").withColumn("instances", F.coalesce("instances", F.array().cast("array<struct<ann_id:bigint,category_id:bigint,known:boolean>>")))
    known = F.size(F.filter("instances", lambda i: i["known"]))
    return out.withColumn("n_known", known.cast("long")).withColumn("n_unknown", (F.size("instances") - known).cast("long"))
