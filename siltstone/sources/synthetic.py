"""Images made on the fly, as a Python data source ("synthetic_instances"), and the registry of sources."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Source names to data-source classes.
SOURCES: dict[str, type[DataSource]] = {}


def register(name: str) -> Callable[[type[DataSource]], type[DataSource]]:
    def put(cls: type[DataSource]) -> type[DataSource]:
        SOURCES[name] = cls
        return cls

    return put


def source(name: str) -> type[DataSource]:
    if name not in SOURCES:
        raise KeyError(f"no source {name!r}; there are {sorted(SOURCES)}")
    return SOURCES[name]


def enable(spark: SparkSession) -> None:
    for cls in SOURCES.values():
        spark.dataSource.register(cls)


def scene(index: int, seed: int, size: int, instances: int, categories: int) -> list[tuple[int, int, int, int, int, int]]:
    """(ann_id, category_id, y0, y1, x0, x1) of an image's squares, from its own generator."""
    rng = np.random.default_rng(seed * 10_000 + index)
    out = []
    for k in range(instances):
        side = int(rng.integers(max(4, size // 10), max(5, size // 4)))
        y, x = (int(v) for v in rng.integers(0, size - side, 2))
        out.append((k, int(rng.integers(1, categories + 1)), y, y + side, x, x + side))
    return out


class _Range(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda k, d: int(options.get(k, d))
        self.n, self.seed, self.size, self.instances, self.categories = get("n_images", 6), get("seed", 0), get("image_size", 96), get("n_instances", 4), get("n_categories", 2)
        self.parts = get("partitions", 4)

    def partitions(self):
        cuts = [self.n * i // self.parts for i in range(self.parts + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]

    def read(self, partition):
        for i in range(partition.begin, partition.end):
            for row in scene(i, self.seed, self.size, self.instances, self.categories):
                yield (i, self.size, self.size, *row)


@register("synthetic")
class SyntheticInstances(DataSource):
    """Rows of squares: image_id, height, width, ann_id, category_id and the box."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_instances"

    def schema(self) -> str:
        return "image_id long, height int, width int, ann_id int, category_id int, y0 int, y1 int, x0 int, x1 int"

    def reader(self, schema):
        return _Reader(self.options)


class _Arrays(DataSourceReader):
    def __init__(self, options: dict):
        self.folders = [f for f in options.get("path", "").split(",") if f]
        self.step = int(options.get("images_per_task", 64))

    def partitions(self):
        out = []
        for k, folder in enumerate(self.folders):
            n = np.load(f"{folder}/masks.npy", mmap_mode="r").shape[0]
            out += [_Fold(k, a, min(n, a + self.step)) for a in range(0, n, self.step)]
        return out

    def read(self, partition):
        masks = np.load(f"{self.folders[partition.fold]}/masks.npy", mmap_mode="r")
        for i in range(partition.begin, partition.end):
            for cat in range(5):
                channel = np.asarray(masks[i, :, :, cat]).astype(int)
                for raw in np.unique(channel[channel > 0]).tolist():
                    padded = np.pad((channel == raw).astype(int), ((0, 0), (1, 1)))
                    d = np.diff(padded, axis=1)
                    ys, xs = np.nonzero(d == 1)
                    _, xe = np.nonzero(d == -1)
                    for y, a, b in zip(ys.tolist(), xs.tolist(), xe.tolist()):
                        yield (f"{partition.fold}_{i}", cat * 1_000_000 + raw, cat, y, a, b)


class _Fold(InputPartition):
    def __init__(self, fold: int, begin: int, end: int):
        self.fold, self.begin, self.end = fold, begin, end


@register("arrays")
class ArrayMasks(DataSource):
    """Mask runs of folders with masks.npy, [image, y, x, channel]: in channels 0 to 4 each number above 0 is an instance."""

    @classmethod
    def name(cls) -> str:
        return "array_masks"

    def schema(self) -> str:
        return "image_id string, ann_id long, category_id int, y int, xs int, xe int"

    def reader(self, schema):
        return _Arrays(self.options)
