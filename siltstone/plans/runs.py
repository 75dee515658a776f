"""Runs of experiments: configurations with overrides, and sinks for what they measure."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .strategies import Settings, build_method
from .sweeps import configs, flatten, set_dotted


@dataclass
class SearchConfig:
    """Settings of a search of squares: what is looked for, and all knobs of ``strategies.Settings``. Unknown keys are left out,
    None keeps the default, and old names still work."""

    target: int = 1
    categories: int = 2
    settings: Settings = field(default_factory=lambda: Settings(where="bank", grouping="cc"))

    ALIASES = {
        "embed_budget": "budget", "max_total_embeds": "budget", "min_crop": "min_side", "crop_sim_floor": "floor", "shrink_stop": "shrink", "foreground_extractor": "where",
        "instance_extractor": "grouping", "split_mode": "grouping", "stop_rule": "stop", "merge_rule": "merge", "pad_frac": "pad", "crop_dilate": "dilate", "marker_mode": "markers",
        "elevation_alpha": "alpha", "elevation_beta": "beta", "marker_min_distance": "marker_distance", "boundary_smooth_sigma": "sigma", "cluster_tau": "cluster",
        "extract_connectivity": "connectivity", "merge_boundary": "merge_border", "oracle_coverage": "coverage", "oracle_isolation": "isolation",
        "oracle_isolation_select": "isolation_select", "cascade_min_instance_area": "least_area", "stop_fixed_point_iou": "fixed",
    }

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> SearchConfig:
        named = {cls.ALIASES.get(k, k): v for k, v in values.items() if v is not None}
        knobs = {f.name for f in fields(Settings)}
        own = cls(**{k: named[k] for k in ("target", "categories") if k in named})
        own.settings = own.settings.with_(**{k: v for k, v in named.items() if k in knobs})
        return own

    def to_dict(self) -> dict[str, Any]:
        return {"target": self.target, "categories": self.categories} | {f.name: getattr(self.settings, f.name) for f in fields(Settings)}


@dataclass
class DataConfig:
    """A dataset's description; keys that it does not know are kept in ``options``."""

    source: str = "synthetic"
    label: str | None = None
    root: str | None = None
    categories: list = field(default_factory=list)
    min_instances: int = 1
    n_train: int = -1
    n_inter: int = 0
    known_ratio: float = 0.5
    seed: int = 0
    options: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> DataConfig:
        known = {f.name for f in fields(cls)} - {"options"}
        return cls(**{k: v for k, v in values.items() if k in known}, options={k: v for k, v in values.items() if k not in known})

    @property
    def name(self) -> str:
        return self.label or (Path(self.root).name if self.root else self.source)


def overridden(config: dict, overrides: list[str]) -> dict:
    """``a.b=value`` entries applied to a copy; values are JSON, or else text."""
    own = json.loads(json.dumps(config))
    for entry in overrides:
        path, _, text = entry.partition("=")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        set_dotted(own, path, value)
    return own


def read_config(path: Path) -> dict:
    """A JSON or YAML file (the latter where a YAML package is there)."""
    text = path.read_text()
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path}: reading YAML needs a YAML package") from e
    return yaml.safe_load(text) or {}


def run_folder(folder: str, run: Callable[[str, dict], Any], overrides: list[str] = ()) -> dict[str, str | None]:  # type: ignore[assignment]
    """Every configuration below a folder, in the order of its path, each with its sweep; a failed run does not stop the others. Name to error, or None."""
    out: dict[str, str | None] = {}
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".json", ".yaml", ".yml")):
        base = overridden(read_config(path), list(overrides))
        for name, config in configs(base, base.pop("sweep", {}), base.get("run_name", path.stem)):
            try:
                run(name, config)
                out[name] = None
            except Exception as e:
                out[name] = f"{type(e).__name__}: {e}"
    return out


def run_experiment(spark: SparkSession, folder: str, name: str, config: dict, images: DataFrame, gt: DataFrame, gt_runs: DataFrame | None = None) -> DataFrame:
    """One experiment: the method that ``config`` names, on ``images``, against boxes of ``gt`` (image_id, gt_id, box) and, where the method gives
    masks (cells), its masks too, against ``gt_runs`` (the boxes' pixels unless given). Its detections, parameters and metrics go
    to ``folder``; the metrics are given as rows."""
    from ..operators import masks, metrics
    from ..operators.graph import written
    from . import cascade

    found = written(build_method(config)(images), "detections")
    write_predictions(found, folder, name, config.get("protocol", "intra"))
    own, runs = found.select("image_id", "det_id", "y0", "y1", "x0", "x1", "score"), None
    if "cells" in found.columns:
        runs = written(cascade.mask_runs(found), "mask-runs")
        gt_runs = masks.box_runs(gt, "gt_id") if gt_runs is None else gt_runs
    rows = metrics.to_rows(metrics.evaluate(own, gt, runs, gt_runs if runs is not None else None)).collect()
    log_run(spark, folder, name, config, {r.metric: r.value for r in rows})
    return spark.createDataFrame([(r.metric, r.value) for r in rows], "metric string, value double")


def log_run(spark: SparkSession, folder: str, name: str, params: dict[str, Any], metrics: dict[str, float]) -> None:
    """Appends to the tables params and metrics, a partition a run; metrics that are no number are left out."""
    p = [(name, k, str(v)) for k, v in flatten(params).items()]
    m = [(name, k, float(v)) for k, v in metrics.items() if v is not None and not math.isnan(v)]
    spark.createDataFrame(p, "run string, key string, value string").coalesce(1).write.mode("append").partitionBy("run").parquet(f"{folder}/params")
    spark.createDataFrame(m, "run string, key string, value double").coalesce(1).write.mode("append").partitionBy("run").parquet(f"{folder}/metrics")


def write_predictions(found: DataFrame, folder: str, run: str, protocol: str) -> None:
    found.withColumn("run", F.lit(run)).withColumn("protocol", F.lit(protocol)).write.mode("append").partitionBy("run", "protocol").parquet(f"{folder}/predictions")


def write_slice(pairs: DataFrame, folder: str) -> None:
    """A slice as JSON lines, and its image ids as text."""
    pairs.write.mode("overwrite").json(f"{folder}/pairs")
    pairs.select(F.col("image_id").cast("string")).distinct().write.mode("overwrite").text(f"{folder}/ids")


# --- dataset files


@dataclass
class DatasetFile:
    """A dataset in one file: where it comes from, which images and categories it covers, which instances of an image are known, and how its
    images are prepared. ``split`` has an image's parts (train, val, unlabelled) as lists of places among its instances."""

    root: str
    category_ids: list[int]
    image_ids: list[str]
    type: str = "coco"
    annotation_file: str | None = None
    images_dir: str | None = None
    split: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    target_size: tuple[int, int] | None = None
    channels: int = 3

    @classmethod
    def read(cls, path: str | Path) -> DatasetFile:
        doc = read_config(Path(path))
        own, pre = doc["dataset"], doc.get("preprocessing") or {}
        side = pre.get("target_size")
        split = {str(i): {part: list(places) for part, places in parts.items()} for i, parts in (doc.get("pu_split") or {}).items()}
        return cls(
            own["root"], list(own["category_ids"]), [str(i) for i in doc["image_ids"]], own.get("type", "coco"), own.get("annotation_file"), own.get("images_dir"), split,
            None if side is None else (int(side[0]), int(side[1])), int(pre.get("image_channels", 3)),
        )

    def write(self, path: str | Path) -> None:
        own = {"type": self.type, "root": self.root, "annotation_file": self.annotation_file, "images_dir": self.images_dir, "category_ids": self.category_ids}
        doc = {"dataset": {k: v for k, v in own.items() if v is not None}, "image_ids": self.image_ids, "pu_split": self.split}
        doc["preprocessing"] = {"target_size": None if self.target_size is None else list(self.target_size), "image_channels": self.channels}
        if Path(path).suffix == ".json":
            Path(path).write_text(json.dumps(doc, indent=1))
        else:
            import yaml

            Path(path).write_text(yaml.safe_dump(doc, sort_keys=False))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """images (order: their place in the file), annotations (class_id from 1 on, known, place among the image's) and classes. An instance that
        the split does not name is unlabelled, and so is every one of an image that it leaves out."""
        from ..operators import datasets
        from ..sources import coco_split
        from pyspark.sql import Window as W

        path = self.annotation_file or f"{self.root}/annotations.json"
        planned = coco_split.plan(spark, path if "/" in path else f"{self.root}/{path}")
        wanted = spark.createDataFrame([(i, k) for k, i in enumerate(self.image_ids)], "image_id string, order long")
        images = coco_split.images(spark, path, planned).drop("order").join(F.broadcast(wanted), "image_id")
        if self.target_size is not None:
            scale = F.least(F.lit(float(self.target_size[0])) / F.col("height"), F.lit(float(self.target_size[1])) / F.col("width"))
            images = images.withColumn("scale", scale)
        ann = datasets.of_categories(coco_split.annotations(spark, path, planned), self.category_ids).join(wanted.select("image_id"), "image_id", "left_semi")
        ann = ann.withColumn("place", (F.row_number().over(W.partitionBy("image_id").orderBy("ann_id")) - 1).cast("int"))
        parts = [(i, p, part) for i, own in self.split.items() for part, places in own.items() for p in places]
        named = spark.createDataFrame(parts, "image_id string, place int, part string")
        ann = ann.join(named, ["image_id", "place"], "left").withColumn("part", F.coalesce("part", F.lit("unlabelled")))
        classes = coco_split.class_names(spark, path, planned)
        return {"images": images, "annotations": ann.join(classes, "category_id", "left"), "classes": classes}
