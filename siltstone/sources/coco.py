"""Instance metadata from COCO-style JSON: images, annotations and categories as tables, and masks as runs.

The metadata scan never decodes a mask; masks are decoded where they are asked for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.datasets import file_name
from ..session import ship

_IMAGE = "struct<id:long,height:int,width:int,file_name:string,coco_url:string,flickr_url:string,not_exhaustive_category_ids:array<long>>"
_ANNOTATION = "struct<id:long,image_id:long,category_id:long,area:double,iscrowd:int,bbox:array<double>,segmentation:string>"
SCHEMA = f"struct<images:array<{_IMAGE}>,annotations:array<{_ANNOTATION}>,categories:array<struct<id:long,name:string>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a file. A missing file is an error at once."""
    return spark.read.schema(T._parse_datatype_string(SCHEMA)).option("multiLine", True).json(path)


def images(doc: DataFrame) -> DataFrame:
    """image_id as text, in numeric order of the file's ids."""
    rows = doc.select(F.explode("images").alias("i")).select("i.*", file_name(F.col("i")).alias("name"))
    return rows.select(F.col("id").cast("string").alias("image_id"), F.col("id").alias("order"), "height", "width", F.col("name").alias("file_name"), F.coalesce("not_exhaustive_category_ids", F.array().cast("array<bigint>")).alias("not_exhaustive"))


def annotations(doc: DataFrame) -> DataFrame:
    """Annotations that are no crowds (a missing mark is none); a missing area is 0."""
    rows = doc.select(F.explode("annotations").alias("a")).select("a.*").filter(F.coalesce("iscrowd", F.lit(0)) == 0)
    return rows.select(F.col("image_id").cast("string").alias("image_id"), F.col("id").alias("ann_id"), "category_id", F.coalesce("area", F.lit(0.0)).alias("area"), "bbox", "segmentation")


def exhaustive(annotations_: DataFrame, images_: DataFrame) -> DataFrame:
    """Without the pairs of an image and a category that it is not fully annotated for."""
    own = annotations_.join(images_.select("image_id", "not_exhaustive"), "image_id")
    return own.filter(~F.array_contains("not_exhaustive", F.col("category_id"))).drop("not_exhaustive")


def category_ids(doc: DataFrame, names: list[str | int], any_case: bool = False) -> list[int]:
    """Ids of names or ids, in order; of none, all. Unknown ones are an error that lists what there is."""
    known = {(c.name.lower() if any_case else c.name): c.id for c in doc.select(F.explode("categories").alias("c")).select("c.*").collect()}
    ids = set(known.values())
    out = [n if isinstance(n, int) else known.get(n.lower() if any_case else n) for n in names]
    if any(o not in ids for o in out):
        raise ValueError(f"unknown category among {names}; there are {sorted(known)}")
    return out or sorted(ids)


def polygon_runs(points: list[float], height: int, width: int) -> list[tuple[int, int, int]]:
    """(y, xs, xe) of the pixels whose centres lie in a polygon (even-odd)."""
    p = np.array(points, dtype=float).reshape(-1, 2)
    q, out = np.roll(p, -1, axis=0), []
    for y in range(max(0, int(np.floor(p[:, 1].min()))), min(height, int(np.ceil(p[:, 1].max())) + 1)):
        c = y + 0.5
        cut = (p[:, 1] <= c) != (q[:, 1] <= c)
        xs = np.sort(p[cut, 0] + (c - p[cut, 1]) * (q[cut, 0] - p[cut, 0]) / (q[cut, 1] - p[cut, 1]))
        for a, b in zip(xs[::2], xs[1::2]):
            a, b = max(0, int(np.ceil(a - 0.5))), min(width, int(np.ceil(b - 0.5)))
            if b > a:
                out.append((y, a, b))
    return out


def rle_runs(counts: list[int], height: int, width: int) -> list[tuple[int, int, int]]:
    """Runs by row of column-major run lengths that begin with zeros."""
    flat = np.repeat(np.arange(len(counts)) % 2, counts)[: height * width]
    m = np.pad(np.pad(flat, (0, height * width - len(flat))).reshape(width, height).T, ((0, 0), (1, 1)))
    d = np.diff(m.astype(int), axis=1)
    ys, xs = np.nonzero(d == 1)
    _, xe = np.nonzero(d == -1)
    return list(zip(ys.tolist(), xs.tolist(), xe.tolist()))


def rle_counts(text: str) -> list[int]:
    """The run lengths of the compressed form: numbers of five bits a character (from 48 on), the sixth bit for more to
    come, the last one's fifth bit a sign; from the fourth number on each is less the one two before."""
    out, at = [], 0
    while at < len(text):
        x, shift, more = 0, 0, True
        while more:
            c = ord(text[at]) - 48
            x |= (c & 31) << shift
            more, shift, at = bool(c & 32), shift + 5, at + 1
            if not more and c & 16:
                x -= 1 << shift
        out.append(x + (out[-2] if len(out) > 2 else 0))
    return out


def instances(doc: DataFrame) -> DataFrame:
    """image_id, file_name, height, width, ann_id, bbox, area, segmentation of instances with polygons, no crowds."""
    own = annotations(doc).filter(F.substring(F.ltrim("segmentation"), 1, 1) == "[")
    return own.join(images(doc).drop("order", "not_exhaustive"), "image_id").select("image_id", "file_name", "height", "width", "ann_id", "bbox", "area", "segmentation")


def class_names(doc: DataFrame) -> DataFrame:
    """category_id, class_name."""
    return doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("class_name"))


def masks(annotations_: DataFrame, images_: DataFrame) -> DataFrame:
    """image_id, ann_id, y, xs, xe. Without a segmentation the rounded, clipped box is the mask; polygons are merged."""
    import json

    ship(annotations_.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                seg = json.loads(r.segmentation) if r.segmentation else None
                if not seg:
                    x, y, w, h = r.bbox
                    x0, y0, x1, y1 = max(0, round(x)), max(0, round(y)), min(r.width, round(x + w)), min(r.height, round(y + h))
                    runs = [(yy, x0, x1) for yy in range(y0, y1)] if x1 > x0 else []
                elif isinstance(seg, list):
                    runs = [u for poly in seg for u in polygon_runs(poly, r.height, r.width)]
                elif isinstance(seg, dict) and isinstance(seg.get("counts"), (list, str)):
                    counts = seg["counts"]
                    runs = rle_runs(rle_counts(counts) if isinstance(counts, str) else counts, r.height, r.width)
                else:
                    raise ValueError(f"annotation {r.ann_id} has a segmentation of an unknown kind")
                rows += [(r.image_id, r.ann_id, *u) for u in runs]
            yield pd.DataFrame(rows, columns=["image_id", "ann_id", "y", "xs", "xe"])

    own = annotations_.join(images_.select("image_id", "height", "width"), "image_id")
    return own.select("image_id", "ann_id", "bbox", "segmentation", "height", "width").mapInPandas(run, "image_id string, ann_id long, y int, xs int, xe int")
