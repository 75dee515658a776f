"""Connected components of an edge table, distributed: star rounds of joins and minima."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        app = spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _OWN.setdefault(app, _OWN.get(app) or tempfile.mkdtemp(prefix="siltstone-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read back: cuts the lineage for good."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: never broadcast. Narrow tables of ids take a byte or two a row in files, and what is
    exploded from a table is planned at the table's size, so estimates send to the driver what does not fit there."""
    return df.hint("merge")


def components(edges: DataFrame, by: str = "image_id") -> DataFrame:
    """(by, node, root) of every node of the edges (by, a, b): root is its component's least node.

    The least label of a node's neighbours is taken over, then the label's own label (pointer
    jumping), until nothing changes."""
    both = edges.select(by, "a", "b").unionByName(edges.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(by, F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(sorted_side(labels), (both[by] == labels[by]) & (both["b"] == labels["node"])).groupBy(both[by], both["a"]).agg(F.min("root").alias("m")).withColumnRenamed("a", "node")
        moved = labels.join(sorted_side(near), [by, "node"]).select(by, "node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = moved.select(by, F.col("node").alias("root"), F.col("root").alias("up"))
        now = written(moved.join(sorted_side(up), [by, "root"], "left").select(by, "node", "old", F.coalesce(F.least("root", "up"), "root").alias("root")), "labels")
        changed = now.filter("root <> old").limit(1).count()
        labels = now.drop("old")
        if not changed:
            return labels
