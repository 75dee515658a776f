"""A stand-in encoder of images: pooled colours through a frozen random projection. It has the interface of a
learned one (features by patch, and one for the image), so a learned one can take its place."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, by pixel centres."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def pool(image: np.ndarray, grid: int) -> np.ndarray:
    """Means of grid x grid cells, whose borders are rounded outwards."""
    h, w = image.shape[:2]
    sums = np.pad(image.astype(float).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0), (0, 0)))
    i = np.arange(grid)
    y0, y1, x0, x1 = i * h // grid, -(-(i + 1) * h // grid), i * w // grid, -(-(i + 1) * w // grid)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    return total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])[..., None]


class MockBackbone:
    def __init__(self, image_size: int = 224, patch_size: int = 14, dim: int = 32, seed: int = 0):
        self.image_size, self.patch_size, self.grid = image_size, patch_size, image_size // patch_size
        self.projection = np.random.default_rng(seed).normal(size=(3, dim))

    def features(self, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(grid, grid, dim) projected mean colours of an RGB image of bytes, and their mean."""
        x = pool(resize(image / 255.0, self.image_size, self.image_size), self.grid) @ self.projection
        return x, x.reshape(-1, x.shape[-1]).mean(axis=0)

    def __call__(self, image: np.ndarray, standardize: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Unit features, each dimension first less its mean over its sample deviation unless told otherwise, and the unit mean."""
        x, mean = self.features(image)
        if standardize:
            flat = x.reshape(-1, x.shape[-1])
            x = (x - flat.mean(axis=0)) / (flat.std(axis=0, ddof=1) + 1e-8)
        return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-8), mean / (np.linalg.norm(mean) + 1e-8)


class Remembered:
    """A backbone that keeps what it has seen of each image, the last ``most`` of them: for exemplars used many times."""

    def __init__(self, backbone, most: int = 64):
        self.backbone, self.most, self.known = backbone, most, {}
        self.grid = backbone.grid

    def __call__(self, image: np.ndarray, **options) -> tuple[np.ndarray, np.ndarray]:
        key = (image.shape, hashlib.sha1(np.ascontiguousarray(image).tobytes()).digest(), *sorted(options.items()))
        if key not in self.known:
            while len(self.known) >= self.most:
                self.known.pop(next(iter(self.known)))
            self.known[key] = self.backbone(image, **options)
        return self.known[key]


def embed(images: DataFrame, backbone: MockBackbone) -> DataFrame:
    """Patches (image_id, r, c, patch_id, feat) of images (image_id, height, width, pixels: RGB bytes). One image of a batch is
    unpacked at a time."""
    ship(images.sparkSession)

    def run(batches):
        for b in batches:
            for i, h, w, px in zip(b["image_id"], b["height"], b["width"], b["pixels"]):
                x, _ = backbone(np.frombuffer(px, np.uint8).reshape(h, w, 3))
                r, c = np.divmod(np.arange(backbone.grid**2), backbone.grid)
                yield pd.DataFrame({"image_id": i, "r": r, "c": c, "patch_id": i * backbone.grid**2 + np.arange(len(r)), "feat": list(x.reshape(len(r), -1))})

    return images.select("image_id", "height", "width", "pixels").mapInPandas(run, "image_id long, r long, c long, patch_id long, feat array<double>")
