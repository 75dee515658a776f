"""Clustering kernels in NumPy, for one image's grid or one group of vectors at a time."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; a zero row points along the first axis."""
    x = np.array(x, dtype=float)
    n = np.linalg.norm(x, axis=1)
    x[n < 1e-12, 0] = 1.0
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def average_linkage(x: np.ndarray, threshold: float, pairs: set[tuple[int, int]] | None = None) -> np.ndarray:
    """Labels from 1 on, in order of first rows: the closest two clusters by mean cosine distance are joined while it is
    at most 1 - threshold; with ``pairs``, only clusters that touch. Distances of joined clusters are weighted means."""
    n = len(x)
    if n < 2:
        return np.ones(n, dtype=int)
    u = unit(x)
    d = 1 - u @ u.T
    size, alive, parent = np.ones(n), set(range(n)), np.arange(n)
    touch = {i: set() for i in range(n)}
    for i, j in pairs if pairs is not None else ((i, j) for i in range(n) for j in range(i)):
        touch[i].add(j)
        touch[j].add(i)
    heap = [(d[i, j], i, j) for i in range(n) for j in touch[i] if i < j]
    heapq.heapify(heap)
    while heap:
        far, i, j = heapq.heappop(heap)
        if i not in alive or j not in alive or far != d[i, j]:
            continue
        if far > 1 - threshold:
            break
        alive.discard(j)
        parent[j] = i
        near = (touch[i] | touch[j]) - {i, j}
        d[i] = d[:, i] = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        touch[i] = near & alive
        for k in touch[i]:
            touch[k].discard(j)
            touch[k].add(i)
            heapq.heappush(heap, (d[min(i, k), max(i, k)], min(i, k), max(i, k)))

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    names: dict[int, int] = {}
    return np.array([names.setdefault(root(k), len(names) + 1) for k in range(n)])


def kmeans2(x: np.ndarray, rounds: int = 50) -> np.ndarray:
    """A split in two (0, 1): Lloyd from the vector farthest from the mean and the one farthest from that; fewer than two rows, or a
    split with an empty side, stay whole."""
    if len(x) < 2:
        return np.zeros(len(x), dtype=int)
    a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    centres = np.stack([a, x[np.argmax(((x - a) ** 2).sum(axis=1))]])
    label = None
    for _ in range(rounds):
        new = np.argmin(((x[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
        if label is not None and (new == label).all():
            break
        label = new
        if label.min() == label.max():
            return np.zeros(len(x), dtype=int)
        centres = np.stack([x[label == k].mean(axis=0) for k in (0, 1)])
    return label if label[0] == 0 else 1 - label


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 25, seed: int = 0) -> np.ndarray:
    """k unit centres by largest cosine; an empty one keeps its place."""
    u = unit(x)
    k = max(1, min(k, len(u)))
    if k == 1:
        return unit(u.mean(axis=0, keepdims=True))
    centres = u[np.random.default_rng(seed).choice(len(u), k, replace=False)]
    for _ in range(rounds):
        label = np.argmax(u @ centres.T, axis=1)
        centres = unit(np.stack([u[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)]))
    return centres


def farthest_points(x: np.ndarray, k: int) -> list[int]:
    """Rows chosen greedily from the first on, each the farthest (by cosine) from those before."""
    u = unit(x)
    if k >= len(u):
        return list(range(len(u)))
    chosen, near = [0], 1 - u @ u[0]
    while len(chosen) < k:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, 1 - u @ u[chosen[-1]])
    return chosen


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each set cell to the nearest unset one, by a pass along columns and one along rows."""
    h, w = mask.shape
    far = float(h + w) ** 2
    col = np.where(mask, far, 0.0)
    for y in range(1, h):
        col[y] = np.minimum(col[y], np.where(mask[y], (np.sqrt(col[y - 1]) + 1) ** 2, 0))
    for y in range(h - 2, -1, -1):
        col[y] = np.minimum(col[y], (np.sqrt(col[y + 1]) + 1) ** 2)
    x = np.arange(w)
    return np.sqrt((col[:, None, :] + (x[None, :, None] - x[None, None, :]) ** 2).min(axis=2))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return x
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        x = np.apply_along_axis(lambda v: np.convolve(v, k, mode="valid"), axis, np.pad(x, pad, mode="symmetric"))
    return x


def peaks(x: np.ndarray, distance: int = 1) -> np.ndarray:
    """Cells that are positive and the largest within ``distance``."""
    h, w = x.shape
    p = np.pad(x, distance, constant_values=-np.inf)
    top = np.max([p[dy : dy + h, dx : dx + w] for dy in range(2 * distance + 1) for dx in range(2 * distance + 1)], axis=0)
    return (x == top) & (x > 0)


def label_cells(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Components numbered from 1 in raster order. A line's runs are joined with those of the line above that they touch."""
    framed = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    framed[:, 1:-1] = mask
    edge = framed[:, 1:] - framed[:, :-1]
    (line, start), stop = (x.tolist() for x in np.nonzero(edge == 1)), np.nonzero(edge == -1)[1].tolist()
    head, reach = list(range(len(line))), int(connectivity != 4)

    def first(k: int) -> int:
        while head[k] != k:
            head[k] = k = head[head[k]]
        return k

    above = 0  # the first run that may touch those to come
    for k, (y, a, b) in enumerate(zip(line, start, stop)):
        while line[above] < y - 1 or line[above] == y - 1 and stop[above] + reach <= a:
            above += 1
        j = above
        while line[j] == y - 1 and start[j] < b + reach:
            p, q = first(j), first(k)
            head[max(p, q)] = min(p, q)
            j += 1
    names: dict[int, int] = {}
    number = [names.setdefault(first(k), len(names) + 1) for k in range(len(line))]
    out = np.zeros(mask.shape, dtype=int)
    out[mask.astype(bool)] = np.repeat(np.array(number, dtype=int), np.subtract(stop, start).astype(int))
    return out


def watershed(elevation: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Markers flood the mask from low to high; equal heights in the order they were reached."""
    out, order, heap = np.where(mask, markers, 0), 0, []
    for y, x in zip(*np.nonzero(out)):
        heap.append((elevation[y, x], order, y, x))
        order += 1
    heapq.heapify(heap)
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            v, u = y + dy, x + dx
            if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not out[v, u]:
                out[v, u] = out[y, x]
                heapq.heappush(heap, (elevation[v, u], order, v, u))
                order += 1
    return out


def oversegment(features: np.ndarray, cells: np.ndarray, threshold: float) -> np.ndarray:
    """Labels from 1 on of the set cells of a grid (h, w, dim): neighbours joined by average linkage; 0 elsewhere."""
    out = np.zeros(cells.shape, dtype=int)
    r, c = np.nonzero(cells)
    out[r, c] = average_linkage(features[r, c], threshold, touching(r, c)) if len(r) else 0
    return out


def feature_border(features: np.ndarray) -> np.ndarray:
    """1 less the mean similarity to four neighbours, at least 0, over its largest."""
    total, n = np.zeros(features.shape[:2]), np.zeros(features.shape[:2])
    for axis in (0, 1):
        size = features.shape[axis]
        s = (np.take(features, range(1, size), axis) * np.take(features, range(size - 1), axis)).sum(axis=-1)
        for part in (slice(1, None), slice(None, -1)):
            at = (part, slice(None)) if axis == 0 else (slice(None), part)
            total[at] += s
            n[at] += 1
    out = np.maximum(0, 1 - total / np.maximum(n, 1))
    return out / out.max() if out.max() > 1e-12 else out


def markers(mask: np.ndarray, distance: np.ndarray, atoms: np.ndarray | None, mode: str, least: int) -> np.ndarray:
    """Seeds of a watershed: peaks of the distance from the edge (geometric), one at the centre of each atom, or at its first cell
    where the centre is outside (feature), or both (hybrid); without any, the farthest cell."""
    if mode not in ("geometric", "feature", "hybrid"):
        raise ValueError(f"markers {mode!r} are none of geometric, feature, hybrid")
    seeds = np.zeros(mask.shape, bool)
    if mode != "feature":
        seeds |= peaks(distance, max(1, least)) & mask
    if mode != "geometric" and atoms is not None:
        for k in np.unique(atoms[atoms > 0]):
            r, c = np.nonzero(atoms == k)
            y, x = int(round(r.mean())), int(round(c.mean()))
            seeds[(y, x) if mask[y, x] else (r[0], c[0])] = True
    if not seeds.any():
        seeds.flat[int(np.argmax(distance))] = True
    return label_cells(seeds, 4)


def individuate(mask: np.ndarray, boundary: np.ndarray, alpha: float = 0.5, beta: float = 0.5, sigma: float = 0.0, atoms: np.ndarray | None = None, mode: str = "geometric", least: int = 1) -> np.ndarray:
    """Instances of a foreground: a watershed of feature border and distance from the edge, from the seeds of ``markers``."""
    if not mask.any():
        return np.zeros(mask.shape, dtype=int)
    d = distance_transform(np.pad(mask, 1))[1:-1, 1:-1]
    smooth = gaussian(d, sigma)
    elevation = alpha * gaussian(boundary, sigma) + beta * (1 - d / max(d.max(), 1e-12))
    return watershed(elevation, markers(mask, d, atoms, mode, least) if sigma <= 0 else markers(mask, smooth, atoms, mode, least), mask)


def merge_basins(features: np.ndarray, labels: np.ndarray, border: np.ndarray, similarity: float, weak: float) -> np.ndarray:
    """Neighbouring basins whose prototypes are alike and whose common border is weak become one; numbered densely."""
    ids = [int(k) for k in np.unique(labels) if k]
    proto = {k: unit(features[labels == k].mean(axis=0, keepdims=True))[0] for k in ids}
    root = {k: k for k in ids}

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    met: dict[tuple[int, int], list[float]] = {}
    for a, b, u, v in ((labels[1:], labels[:-1], border[1:], border[:-1]), (labels[:, 1:], labels[:, :-1], border[:, 1:], border[:, :-1])):
        for y, x in zip(*np.nonzero((a != b) & (a > 0) & (b > 0))):
            met.setdefault((min(a[y, x], b[y, x]), max(a[y, x], b[y, x])), []).append((u[y, x] + v[y, x]) / 2)
    for (a, b), strength in sorted(met.items()):
        if proto[a] @ proto[b] >= similarity and np.mean(strength) <= weak:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    dense = {r: i + 1 for i, r in enumerate(sorted({find(k) for k in ids}))}
    out = np.zeros(labels.shape, dtype=int)
    for k in ids:
        out[labels == k] = dense[find(k)]
    return out


def reduced(patches: list[np.ndarray], reduction: str = "all", budget: int = 64, least: int = 1, per: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, the exemplar each is of or -1) of exemplars' patches: ``mean`` one an exemplar; ``cluster`` up to ``per`` centres an
    exemplar; ``all``, or, beyond ``budget``, the patches farthest from each other; ``kmeans`` at least ``least`` centres an
    exemplar and centres of all patches up to ``budget``."""
    pooled, of = np.concatenate(patches), np.repeat(np.arange(len(patches)), [len(p) for p in patches])
    if reduction == "mean":
        return np.stack([unit(p.mean(axis=0, keepdims=True))[0] for p in patches]), np.arange(len(patches))
    if reduction == "cluster":
        parts = [spherical_kmeans(p, per) for p in patches]
        return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    if reduction == "all":
        if len(pooled) <= budget:
            return pooled, of
        return pooled[farthest_points(pooled, budget)], np.full(budget, -1)
    if reduction != "kmeans":
        raise ValueError(f"reduction {reduction!r} is none of all, cluster, kmeans, mean")
    parts = [spherical_kmeans(p, least) for p in patches] if least > 0 else []
    own = [np.full(len(p), i) for i, p in enumerate(parts)]
    left = max(0, budget - sum(map(len, parts)))
    if left:
        more = spherical_kmeans(pooled, left) if len(pooled) > left else pooled
        parts.append(more)
        own.append(np.full(len(more), -1) if len(pooled) > left else of)
    return np.concatenate(parts), np.concatenate(own)


def bank(rows: DataFrame, reduction: str = "all", budget: int = 64, least: int = 1, per: int = 4) -> DataFrame:
    """class_id, place, ex_id (-1 of none), feat: each class's bank, from its exemplars' patches (class_id, ex_id, patch_id, feat).
    One class's exemplar patches are one task's; means are the engine's."""
    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["ex_id", "patch_id"])
        ids = own["ex_id"].unique()
        vectors, of = reduced([np.stack(own.loc[own["ex_id"] == e, "feat"].to_numpy()) for e in ids], reduction, budget, least, per)
        return pd.DataFrame({"class_id": own["class_id"].iloc[0], "place": np.arange(len(vectors)), "ex_id": [int(ids[k]) if k >= 0 else -1 for k in of], "feat": list(vectors)})

    if reduction == "mean":
        from .vectors import prototypes

        place = F.row_number().over(W.partitionBy("class_id").orderBy("ex_id")) - 1
        return prototypes(rows, ["class_id", "ex_id"]).select("class_id", place.cast("long").alias("place"), "ex_id", F.col("proto").alias("feat"))
    return rows.select("class_id", "ex_id", "patch_id", "feat").groupBy("class_id").applyInPandas(run, "class_id long, place long, ex_id long, feat array<double>")


def per_image(patches: DataFrame, kernel, name: str) -> DataFrame:
    """``kernel`` (features of an image's patches in raster order, r, c) gives a number for each: image_id, patch_id, <name>."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["r", "c"])
        x = np.stack(rows["feat"].to_numpy())
        return pd.DataFrame({"image_id": rows["image_id"], "patch_id": rows["patch_id"], name: np.asarray(kernel(x, rows["r"].to_numpy(), rows["c"].to_numpy()), dtype=np.int64)})

    return patches.select("image_id", "patch_id", "r", "c", "feat").groupBy("image_id").applyInPandas(run, f"image_id long, patch_id long, {name} long")


def touching(r: np.ndarray, c: np.ndarray) -> set[tuple[int, int]]:
    at = {(int(y), int(x)): i for i, (y, x) in enumerate(zip(r, c))}
    return {(i, at[y + dy, x + dx]) for (y, x), i in at.items() for dy, dx in ((0, 1), (1, 0)) if (y + dy, x + dx) in at}
