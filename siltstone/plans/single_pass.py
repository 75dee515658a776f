"""One pass over an image without recursion: features, foreground, atoms, watershed from hybrid markers, merging of
basins, filtering; and the crop-and-embed-again refinement of a foreground."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators import clustering
from ..operators.backbone import MockBackbone, resize
from ..operators.thresholds import gmm2_threshold
from ..session import ship
from . import strategies as st

FOUND = "image_id long, det_id long, y0 long, y1 long, x0 long, x1 long, area long, score double"


def instances(x: np.ndarray, bank: np.ndarray, tau: float | None = None, least_area: int = 1, least_score: float = 0.0, settings: st.Settings = st.Settings()) -> list[tuple[np.ndarray, float]]:
    """(cells, mean score) of each instance: similarity to the bank is cut at ``tau`` (by two normal components without it), the
    foreground over-segmented into atoms, flooded from their centres and the peaks of distance, and basins that are alike
    joined again."""
    s = (x @ bank.T).max(axis=-1)
    fg = s >= (gmm2_threshold(s.ravel()) if tau is None else tau)
    atoms = clustering.oversegment(x, fg, settings.cluster)
    border = clustering.feature_border(x) * fg
    parts = clustering.individuate(fg, border, settings.alpha, settings.beta, settings.sigma, atoms, settings.markers, settings.marker_distance)
    parts = clustering.merge_basins(x, parts, border, settings.merge_similarity, settings.merge_border)
    out = []
    for k in range(1, parts.max(initial=0) + 1):
        m = parts == k
        if m.sum() >= least_area and s[m].mean() >= least_score:
            out.append((m, float(s[m].mean())))
    return out


def run(images: DataFrame, bank: np.ndarray, backbone: MockBackbone, tau: float | None = None, least_area: int = 1, find: Callable | None = None) -> DataFrame:
    """Detections of images (image_id, height, width, pixels); boxes are the cells' pixels. ``find`` gives (cells, score) of an image's
    features (``instances`` unless given)."""
    ship(images.sparkSession)
    find = find or (lambda x: instances(x, bank, tau, least_area))

    def detect(batches):
        for b in batches:
            rows = []
            for i, h, w, px in zip(b["image_id"], b["height"], b["width"], b["pixels"]):
                x, _ = backbone(np.frombuffer(px, np.uint8).reshape(h, w, 3))
                n = backbone.grid
                for k, (m, score) in enumerate(find(x)):
                    r, c = np.nonzero(m)
                    rows.append((i, k + 1, r.min() * h // n, -(-(r.max() + 1) * h // n), c.min() * w // n, -(-(c.max() + 1) * w // n), int(m.sum()), score))
            yield pd.DataFrame(rows, columns=["image_id", "det_id", "y0", "y1", "x0", "x1", "area", "score"])

    return images.select("image_id", "height", "width", "pixels").mapInPandas(detect, FOUND)


def foreground_box(fg: np.ndarray, box: tuple[int, int, int, int], pad: float = 0.06) -> tuple[int, int, int, int] | None:
    """Pixels of the foreground cells of a crop, padded and clipped to it; None of no cells."""
    if not fg.any():
        return None
    y0, y1, x0, x1 = box
    r, c = np.nonzero(fg)
    out = []
    for lo, hi, a, b, n in ((r.min(), r.max() + 1, y0, y1, fg.shape[0]), (c.min(), c.max() + 1, x0, x1, fg.shape[1])):
        lo, hi = a + int(np.floor(lo * (b - a) / n)), a + int(np.ceil(hi * (b - a) / n))
        extra = round((hi - lo) * pad)
        out += [max(a, lo - extra), min(b, hi + extra)]
    return tuple(out)


def refine(image: np.ndarray, foreground: Callable[[np.ndarray], np.ndarray], exemplars: list[np.ndarray] = (), rounds: int = 4, least_side: int = 24, trivial: float = 0.98) -> list[tuple[int, int, int, int]]:  # type: ignore[assignment]
    """The crops that are embedded, the whole image first, ``rounds`` at most: each is the box of the foreground found in the one
    before. It ends when the box is nearly all of its crop on both sides, or small, or loses one of the exemplars (masks)."""
    crops = [(0, image.shape[0], 0, image.shape[1])]
    while len(crops) < rounds:
        y0, y1, x0, x1 = crops[-1]
        box = foreground_box(foreground(image[y0:y1, x0:x1]), crops[-1])
        if box is None or min(box[1] - box[0], box[3] - box[2]) < least_side:
            break
        if box[1] - box[0] >= trivial * (y1 - y0) and box[3] - box[2] >= trivial * (x1 - x0):
            break
        if any(not m[box[0] : box[1], box[2] : box[3]].any() for m in exemplars):
            break
        crops.append(box)
    return crops


def upsample(mask: np.ndarray, height: int, width: int, smooth: bool = False) -> np.ndarray:
    """A grid mask in pixels: by the cell that a pixel lies in, or bilinear and cut at a half."""
    if smooth:
        return resize(mask[..., None].astype(float), height, width)[..., 0] >= 0.5
    return mask[(np.arange(height) * mask.shape[0] // height)[:, None], (np.arange(width) * mask.shape[1] // width)[None, :]]


def parts(x: np.ndarray, bank: np.ndarray, settings: st.Settings, mean: bool = True) -> list[tuple[np.ndarray, float]]:
    """(cells, score) of the connected components of the foreground: ``where`` of the settings cuts it out (what reaches ``tau``), components
    by ``connectivity`` of at least ``least_area`` cells count, with the mean of their cells' confidence as score, or 1."""
    crop = st.Crop(x, (0, x.shape[0], 0, x.shape[1]))
    region, score = st.chosen(st.WHERE, settings.where, "where")(crop, st.Bank.of_target(bank), settings)
    found = st.chosen(st.GROUPING, "cc", "grouping")(crop, region, settings)
    return [(m, float(score[m].mean()) if mean else 1.0) for m in found if m.sum() >= max(1, settings.least_area)]


@st.register(st.METHODS, "components")
def components_method(backbone: dict | None = None, bank: list | None = None, score: str = "mean", **settings):
    """images of pixels -> detections: connected components of the foreground, without recursion. ``score`` is mean or one."""
    if score not in ("mean", "one"):
        raise ValueError(f"score {score!r} is neither mean nor one")
    encoder, vectors = st.build_backbone(backbone), np.array(bank if bank is not None else [], float)
    own = st.Settings(**{"where": "bank"} | settings)
    return lambda images: run(images, vectors, encoder, find=lambda x: parts(x, vectors, own, score == "mean"))


@st.register(st.METHODS, "basins")
def basins_method(backbone: dict | None = None, bank: list | None = None, tau: float | None = None, least_score: float = 0.0, **settings):
    """images of pixels -> detections: atoms, watershed and merging (see ``instances``), without recursion."""
    encoder, vectors = st.build_backbone(backbone), np.array(bank if bank is not None else [], float)
    own = st.Settings(**{"markers": "geometric"} | settings)
    return lambda images: run(images, vectors, encoder, find=lambda x: instances(x, vectors, tau, own.least_area, least_score, own))
