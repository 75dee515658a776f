"""Box and score arithmetic as column expressions. Boxes are half-open (y0, y1, x0, x1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """Columns of a box; ``prefix`` may be an alias with its dot."""
    return tuple(F.col(f"{prefix}{n}") for n in ("y0", "y1", "x0", "x1"))  # type: ignore[return-value]


def area(b: Box) -> Column:
    return (b[1] - b[0]) * (b[3] - b[2])


def intersection(a: Box, b: Box) -> Column:
    high = F.greatest(F.lit(0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))
    wide = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[2], b[2]))
    return high * wide


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is nothing."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    return ratio(inter, area(a) + area(b) - inter)


def containment(a: Box, b: Box) -> Column:
    """Shared area over the smaller area."""
    return ratio(intersection(a, b), F.least(area(a), area(b)))


def overlap(a: Box, b: Box) -> Column:
    """Whether two boxes share area."""
    return (a[0] < b[1]) & (b[0] < a[1]) & (a[2] < b[3]) & (b[2] < a[3])


def padded(b: Box, pad: float, height: Column, width: Column) -> Box:
    """Each side moved out by the whole part of ``pad`` times the extent, within the image."""
    py, px = ((b[1] - b[0]) * pad).cast("long"), ((b[3] - b[2]) * pad).cast("long")
    zero = F.lit(0)
    return F.greatest(zero, b[0] - py), F.least(height, b[1] + py), F.greatest(zero, b[2] - px), F.least(width, b[3] + px)


def child_box(cells: Box, parent: Box, grid: int, pad: float, dilate: float = 0.0) -> Box:
    """Pixels of a box of grid cells within its parent: widened by ``dilate`` cells within the grid,
    rounded outwards, padded by the rounded ``pad`` of its extent, clipped to the parent."""
    out = []
    for lo, hi, p0, p1 in ((cells[0], cells[1], parent[0], parent[1]), (cells[2], cells[3], parent[2], parent[3])):
        if dilate:
            lo, hi = F.greatest(F.lit(0.0), lo - dilate), F.least(F.lit(float(grid)), hi + dilate)
        size = (p1 - p0).cast("double") / grid
        a, b = p0 + F.floor(lo * size), p0 + F.ceil(hi * size)
        extra = F.bround((b - a) * F.lit(pad), 0).cast("long")
        out += [F.greatest(p0, a - extra), F.least(p1, b + extra)]
    return tuple(out)  # type: ignore[return-value]


def letterbox(b: Box, height: Column, width: Column, side: int) -> Box:
    """A box of an image that is shrunk (never enlarged) to fit a square, padded below and to the right."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(height, width))
    return tuple(x * scale for x in b)  # type: ignore[return-value]


def clipped(b: Box, crop: Box, height: Column, width: Column) -> Column:
    """Whether a box reaches an edge of its crop that is not an edge of the image."""
    return (
        ((crop[0] > 0) & (b[0] <= crop[0])) | ((crop[1] < height) & (b[1] >= crop[1]))
        | ((crop[2] > 0) & (b[2] <= crop[2])) | ((crop[3] < width) & (b[3] >= crop[3]))
    )


def touches(b: Box, crop: Box) -> Column:
    """Whether a box reaches any edge of its crop."""
    return (b[0] <= crop[0]) | (b[1] >= crop[1]) | (b[2] <= crop[2]) | (b[3] >= crop[3])


def square_crop(b: Box, factor: float, height: Column, width: Column) -> Box:
    """The square around a box's centre, ``factor`` times its longer side, clamped to the image."""
    half = F.bround(F.greatest(b[1] - b[0], b[3] - b[2]) * (factor / 2), 0).cast("long")
    cy, cx = F.floor((b[0] + b[1]) / 2), F.floor((b[2] + b[3]) / 2)
    return F.greatest(F.lit(0), cy - half), F.least(height, cy + half), F.greatest(F.lit(0), cx - half), F.least(width, cx + half)


def size_bin(side: Column, unit: float) -> Column:
    """Crop size in multiples of the encoder's input."""
    r = side / unit
    return F.when(r >= 4, "ge4x").when(r >= 2, "2-4x").when(r >= 1, "1-2x").when(r >= 0.5, "0.5-1x").otherwise("lt0.5x")


def minmax(x: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-12, 0.0).otherwise((x - low) / (high - low))
