"""Masks met in memory: the runs of a mask travel as one short row, and all masks of an image are measured where they come together.

Joined as rows, each pair of masks is a row a line of pixels that both have, and all of them are shuffled. Here runs are packed before the
only shuffle, by image, as differences from one run to the next, those of an image's masks in one compressed row (a few bytes a mask),
and a task takes one image after the other, many in one go. What leaves it is a row a pair of masks that share a pixel, or a row an image. A task holds the masks of at least one image.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship

#: Images are measured together up to so many bytes of packed runs, candidates and lines of pixels up to so many at a time.
TOGETHER, CANDIDATES, LINES = 1 << 20, 1 << 20, 1 << 22
#: Packed rows, each of which holds the runs of a batch at most, that are unpacked at a time.
UNPACKED = 32


def _changes(a: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    return np.r_[True, pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows next to each other that are runs of one image's masks, as one: of each mask its first run, the number of its runs and the
    differences of the others. Images and masks whose runs come apart are several rows and entries."""
    for b in batches:
        if not b.num_rows:
            continue
        image, side, key = b.column(0), b.column(1), b.column(2)
        own = _changes(image)
        starts = np.flatnonzero(own | _changes(side) | _changes(key))
        runs = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5)], axis=1).astype(np.int64)
        step = np.diff(runs, axis=0, prepend=runs[:1])
        step[starts] = 0
        most = max(-int(step.min()), int(step.max()))
        width = 1 if most < 1 << 7 else 4 if most < 1 << 31 else 8
        step, sides = step.astype(f"<i{width}"), side.to_numpy(zero_copy_only=False)[starts].astype("<i4")
        count, first = np.diff(np.r_[starts, len(runs)]).astype("<i4"), runs[starts].astype("<i8")
        heads = np.r_[np.flatnonzero(own[starts]), len(starts)]
        at, data = np.r_[starts, len(runs)], []
        for p, q in zip(heads[:-1].tolist(), heads[1:].tolist()):
            parts = first[p:q].T, count[p:q], sides[p:q], step[at[p] : at[q]].T  # column by column, which compresses best
            data.append(zlib.compress(b"".join([x.tobytes() for x in parts]), 1))
        n = np.diff(heads).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), key.take(pa.array(starts)))
        yield pa.RecordBatch.from_arrays([image.take(pa.array(starts[heads[:-1]])), pa.array(n), pa.array(np.full(len(n), width, np.int32)), ids, pa.array(data, pa.binary())], ["image_id", "n", "width", "ids", "data"])


def _unpack(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Packed rows as a row a mask: image_id, side, id, its first run, the width of differences, and these."""
    for start in range(0, b.num_rows, UNPACKED):
        own = b.slice(start, UNPACKED)
        n, width = own.column(1).to_numpy(), own.column(2).to_numpy()
        first, count, sides, steps = [], [], [], []
        for k, w, data in zip(n.tolist(), width.tolist(), own.column(4).to_pylist()):
            raw = zlib.decompress(data)
            first.append(np.frombuffer(raw, "<i8", 3 * k).reshape(3, k))
            count.append(np.frombuffer(raw, "<i4", k, 24 * k).astype(np.int64) * 3 * w)
            sides.append(np.frombuffer(raw, "<i4", k, 28 * k))
            steps.append(np.frombuffer(raw, f"<i{w}", offset=32 * k).reshape(3, -1).T.tobytes())
        ends = np.r_[0, np.cumsum(np.concatenate(count))].astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(steps))])
        run = [pa.array(x) for x in np.concatenate(first, axis=1)]
        image = own.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.RecordBatch.from_arrays([image, pa.array(np.concatenate(sides)), own.column(3).flatten(), *run, pa.array(np.repeat(width, n)), data], ["image_id", "side", "id", "y", "xs", "xe", "width", "data"])


class Masks:
    """Whole images' masks in order of image, side and id. ``row`` is a mask's first packed row; runs are by mask, y and xs."""

    def __init__(self, t: pa.Table):
        image = _changes(t.column("image_id").combine_chunks())
        side = t.column("side").to_numpy()
        mask = image | np.r_[True, side[1:] != side[:-1]] | _changes(t.column("id").combine_chunks())
        self.table, self.row = t, np.flatnonzero(mask)
        self.image, self.side = (np.cumsum(image) - 1)[self.row], side[self.row]
        own, width, parts = np.cumsum(mask) - 1, t.column("width").to_numpy(), []
        first = np.stack([t.column(c).to_numpy() for c in ("y", "xs", "xe")], axis=1)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            data = t.column("data").combine_chunks().take(pa.array(at))
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] // (3 * w)
            step = np.frombuffer(data.buffers()[2], f"<i{w}").reshape(-1, 3)[offsets[0] : offsets[-1]].astype(np.int64)
            total, n = np.cumsum(step, axis=0), np.diff(offsets)
            parts.append((np.repeat(own[at], n), total + np.repeat(first[at] - total[offsets[:-1] - offsets[0]], n, axis=0)))
        m, runs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        self.set_runs(m, runs[:, 0], runs[:, 1], runs[:, 2])

    def set_runs(self, m: np.ndarray, y: np.ndarray, xs: np.ndarray, xe: np.ndarray) -> None:
        back = (m[1:] < m[:-1]) | (m[1:] == m[:-1]) & ((y[1:] < y[:-1]) | (y[1:] == y[:-1]) & (xs[1:] < xs[:-1]))
        if back.any():
            order = np.lexsort((xs, y, m))
            m, y, xs, xe = m[order], y[order], xs[order], xe[order]
        self.m, self.y, self.xs, self.xe = m, np.ascontiguousarray(y), np.ascontiguousarray(xs), np.ascontiguousarray(xe)

    def boxes(self) -> tuple[np.ndarray, ...]:
        """Where each mask's runs begin (and the last one's end), and its box."""
        ptr = np.searchsorted(self.m, np.arange(len(self.row) + 1))
        return ptr, self.y[ptr[:-1]], self.y[ptr[1:] - 1] + 1, np.minimum.reduceat(self.xs, ptr[:-1]), np.maximum.reduceat(self.xe, ptr[:-1])

    def unite(self, which: np.ndarray) -> None:
        """Makes the masks ``which`` of each image one, the first of them, of disjoint runs."""
        head = np.full(self.image[-1] + 1, len(self.row))
        np.minimum.at(head, self.image[which], np.flatnonzero(which))
        hit = which[self.m]
        m, y, xs, xe = head[self.image[self.m[hit]]], self.y[hit], self.xs[hit], self.xe[hit]
        if len(m):
            order = np.lexsort((xs, y, m))
            m, y, xs, xe = m[order], y[order], xs[order], xe[order]
            begin, end, _ = swept(m, y, xs, xe)
            new = np.flatnonzero(begin)
            m, y, xs, xe = m[new], y[new], xs[new], np.maximum.reduceat(xe, new)
        self.set_runs(np.r_[self.m[~hit], m], np.r_[self.y[~hit], y], np.r_[self.xs[~hit], xs], np.r_[self.xe[~hit], xe])
        kept = np.unique(self.m)
        self.m = np.searchsorted(kept, self.m)
        self.row, self.image, self.side = self.row[kept], self.image[kept], self.side[kept]


def swept(group: np.ndarray, y: np.ndarray, xs: np.ndarray, xe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs in order of group, y and xs: whether each begins an island of its line, how far the line is covered up to it, and the pixels it adds."""
    line = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (y[1:] != y[:-1])])
    wide = int(xe.max() - xs.min()) + 2
    begin, end = line * wide + (xs - xs.min()), line * wide + (xe - xs.min())
    reach = np.maximum.accumulate(end)
    before = np.r_[0, reach[:-1]]
    return (begin > before) | np.r_[True, line[1:] != line[:-1]], reach, np.maximum(0, end - np.maximum(before, begin))


def _expanded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: which count each unit belongs to, and its place within."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _chunks(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of counts that add up to ``most`` at the most (or are of one count)."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def shared_pixels(k: Masks, both: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(p, q, inter) of the masks of an image that share a pixel; with ``both`` p is of side 0 and q of side 1, else p comes first."""
    n = len(k.row)
    ptr, y0, y1, x0, x1 = k.boxes()
    again = np.r_[False, (k.m[1:] == k.m[:-1]) & (k.y[1:] == k.y[:-1])]
    plain = (np.diff(ptr) == y1 - y0) & (np.bincount(k.m[again], minlength=n) == 0)  # one run a line, so that a line is found by its place
    low = y0.min()
    span = int(y1.max() - low) + 1
    by_line = k.m * span + (k.y - low)
    order = np.lexsort((y0, k.image))
    place = (k.image * span + (y0 - low))[order]
    stop = np.searchsorted(place, (k.image * span + (y1 - low))[order])
    follow = np.maximum(stop - np.arange(n) - 1, 0)
    small = np.int32 if max(abs(int(k.xs.min())), abs(int(k.xe.max()))) < 1 << 30 else np.int64
    xs, xe = k.xs.astype(small), k.xe.astype(small)
    for part in _chunks(follow, CANDIDATES):
        of, at = _expanded(follow[part])
        a, b = order[of + part.start], order[of + part.start + 1 + at]
        p, q = np.minimum(a, b), np.maximum(a, b)
        near = (x0[p] < x1[q]) & (x0[q] < x1[p])
        if both:
            near &= k.side[p] != k.side[q]
        p, q = p[near], q[near]
        top = np.maximum(y0[p], y0[q])
        high = np.minimum(y1[p], y1[q]) - top
        quick = plain[p] & plain[q]
        for which, count in ((quick, high), (~quick, np.diff(ptr)[p])):
            which = np.flatnonzero(which)
            for c in _chunks(count[which], LINES):
                i = which[c]
                u, v, h, t = p[i], q[i], high[i], top[i]
                if quick[i[0]]:
                    begin = np.cumsum(h) - h
                    first, second = ptr[u] + t - y0[u], ptr[v] + t - y0[v]
                    r = np.arange(int(h.sum())) + np.repeat(first - begin, h)
                    s = r + np.repeat(second - first, h)
                    wide = np.minimum(xe[r], xe[s]) - np.maximum(xs[r], xs[s])
                    inter = np.add.reduceat(np.maximum(wide, 0), begin, dtype=np.int64)
                else:
                    lo = np.searchsorted(by_line, u * span + (t - low))
                    of, at = _expanded(np.searchsorted(by_line, u * span + (t + h - low)) - lo)
                    r = lo[of] + at
                    line = v[of] * span + (k.y[r] - low)
                    lo = np.searchsorted(by_line, line)
                    more, at = _expanded(np.searchsorted(by_line, line, "right") - lo)
                    s, r, of = lo[more] + at, r[more], of[more]
                    wide = np.maximum(0, np.minimum(k.xe[r], k.xe[s]) - np.maximum(k.xs[r], k.xs[s]))
                    inter = np.bincount(of, wide, len(i)).astype(np.int64)
                hit = inter > 0
                if hit.any():
                    yield u[hit], v[hit], inter[hit]


def _areas(k: Masks) -> np.ndarray:
    return np.add.reduceat(k.xe - k.xs, np.searchsorted(k.m, np.arange(len(k.row))))


def _pairs(both: bool, united: bool) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    def run(t: pa.Table):
        k = Masks(t)
        if united:
            k.unite(k.side == 1)
        area, image, ids = _areas(k), t.column("image_id").combine_chunks(), t.column("id").combine_chunks()
        for p, q, inter in shared_pixels(k, both):
            a, b = pa.array(k.row[p]), pa.array(k.row[q])
            yield pa.RecordBatch.from_arrays([image.take(a), ids.take(a), ids.take(b), pa.array(inter), pa.array(area[p]), pa.array(area[q])], ["image_id", "a", "b", "inter", "area_a", "area_b"])

    return run


def _unions(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Per image the pixels of each side's union, and of both."""
    k = Masks(t)
    n, image, side = int(k.image[-1]) + 1, k.image[k.m], k.side[k.m]
    size = []
    for own in (side == 0, side == 1, side >= 0):
        g, y, xs, xe = image[own], k.y[own], k.xs[own], k.xe[own]
        order = np.lexsort((xs, y, g))
        size.append(np.bincount(g[order], swept(g[order], y[order], xs[order], xe[order])[2], n).astype(np.int64) if len(g) else np.zeros(n, np.int64))
    first = pa.array(k.row[np.searchsorted(k.image, np.arange(n))])
    yield pa.RecordBatch.from_arrays([t.column("image_id").combine_chunks().take(first), *map(pa.array, size)], ["image_id", "size_a", "size_b", "size"])


def _ordered(t: pa.Table) -> pa.Table:
    return t.take(pc.sort_indices(t, [(c, "ascending") for c in ("image_id", "side", "id", "y", "xs")])).combine_chunks()


def _by_images(act: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """``act`` on tables of whole images, their masks in order."""
    def run(batches):
        held, size, most = [], 0, TOGETHER
        for b in (u for packed in batches for u in _unpack(packed)):
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size > most:
                t = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(_changes(t.column("image_id").combine_chunks()))[-1])
                if cut:
                    yield from act(_ordered(t.slice(0, cut)))
                held = t.slice(cut).combine_chunks().to_batches()
                size = sum(h.nbytes for h in held)
                most = max(TOGETHER, 2 * size)
        if held:
            yield from act(_ordered(pa.Table.from_batches(held)))

    return run


def _packed(runs: DataFrame, key: str, side: int = 0) -> DataFrame:
    own = runs.select("image_id", F.lit(side).alias("side"), F.col(key).alias("id"), *[F.col(c).cast("long").alias(c) for c in ("y", "xs", "xe")]).dropna()
    types = dict(own.dtypes)
    ship(own.sparkSession)
    return own.mapInArrow(_pack, f"image_id {types['image_id']}, n int, width int, ids array<{types['id']}>, data binary")


def _together(sides: list[tuple[DataFrame, str]]) -> tuple[DataFrame, str, str]:
    """The packed runs of one or two tables of masks, an image's in one partition and in order; the types of image_id and id."""
    out = None
    for i, (runs, key) in enumerate(sides):
        packed = _packed(runs, key, i)
        out = packed if out is None else out.unionByName(packed)
    types = dict(out.dtypes)  # of both sides together, one of which may have narrower ids
    return out.repartition("image_id").sortWithinPartitions("image_id"), types["image_id"], types["ids"].removeprefix("array<").removesuffix(">")


def overlapping(left: DataFrame, right: DataFrame | None, a: str, b: str = "", united: bool = False) -> DataFrame:
    """image_id, a, b, inter, area_a, area_b of the masks (image_id, a, y, xs, xe) of ``left`` that share pixels with those of ``right``, or without
    ``right`` with each other (a < b, each pair once). With ``united`` those of ``right`` are one mask an image, their union."""
    rows, image, kind = _together([(left, a)] if right is None else [(left, a), (right, b)])
    return rows.mapInArrow(_by_images(_pairs(right is not None, united)), f"image_id {image}, a {kind}, b {kind}, inter long, area_a long, area_b long")


def union_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """image_id, size_a, size_b, size: the pixels of the union of each table's runs (image_id, y, xs, xe), and of both together."""
    one = F.lit(0).alias("id")
    rows, image, _ = _together([(x.select("image_id", "y", "xs", "xe", one), "id") for x in (left, right)])
    return rows.mapInArrow(_by_images(_unions), f"image_id {image}, size_a long, size_b long, size long")


# --- a row an image: what is decided about its masks meets them there, and only what stays goes on

#: Masks of images' rows that are unpacked at a time.
MASKS = 1 << 11


def by_image(runs: DataFrame, key: str) -> DataFrame:
    """image_id, packed: an image's masks (image_id, key, y, xs, xe), shuffled once and packed."""
    return _packed(runs, key).groupBy("image_id").agg(F.array_agg(F.struct("n", "width", "ids", "data")).alias("packed"))


def _opened(rows: pa.RecordBatch) -> pa.Table | None:
    """The masks of images' rows, whose number stands for the image."""
    packed = rows.column("packed")
    own = pa.RecordBatch.from_arrays([pc.list_parent_indices(packed).cast(pa.int64()), *packed.flatten().flatten()], ["image_id", "n", "width", "ids", "data"])
    return _ordered(pa.Table.from_batches(list(_unpack(own)))) if own.num_rows else None


def _kept(t: pa.Table, names: dict) -> tuple[pa.Table, list]:
    """The masks that are in ``names`` (by row and id), and what stands there."""
    found = [names.get(x) for x in zip(t.column("image_id").to_pylist(), t.column("id").to_pylist())]
    at = [i for i, x in enumerate(found) if x is not None]
    return t.take(pa.array(at, pa.int64())).combine_chunks(), [found[i] for i in at]


def _listed(row: np.ndarray, n: int, fields: dict[str, pa.Array]) -> pa.ListArray:
    """A list of structs for each of n rows, from entries in order of ``row``."""
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of so many images' rows that few masks are unpacked at a time."""
    for b in batches:
        packed, n = b.column("packed"), np.zeros(b.num_rows, np.int64)
        np.add.at(n, pc.list_parent_indices(packed).to_numpy(), packed.flatten().flatten()[0].to_numpy())
        for part in _chunks(n, MASKS):
            yield b.slice(part.start, part.stop - part.start)


def _entries(rows: pa.RecordBatch, column: str, *fields: str) -> list[tuple]:
    """(row, *fields) of a column of lists of structs."""
    of, own = pc.list_parent_indices(rows.column(column)), rows.column(column).flatten()
    return list(zip(of.to_pylist(), *[pc.struct_field(own, f).to_pylist() for f in fields]))


def _with(rows: DataFrame, column: str) -> StructType:
    return StructType([*rows.schema.fields, *StructType.fromDDL(column).fields])


def boxed(rows: DataFrame) -> DataFrame:
    """Adds tight to rows with packed and own (structs with det_id): of each of own the box of its mask, NULL where it has none."""
    def act(b: pa.RecordBatch) -> pa.RecordBatch:
        own, t = _entries(b, "own", "det_id"), _opened(b)
        box, at = [np.empty(0, np.int64)] * 4, {}
        if t is not None:
            k = Masks(t)
            first = t.take(pa.array(k.row))
            at = {x: i for i, x in enumerate(zip(first.column("image_id").to_pylist(), first.column("id").to_pylist()))}
            box = k.boxes()[1:]
        place = pa.array([at.get(x) for x in own], pa.int64())
        inner = pa.StructArray.from_arrays([pa.array(x, pa.int64()).take(place) for x in box], ["y0", "y1", "x0", "x1"], mask=place.is_null())
        offsets = np.r_[0, np.cumsum(np.bincount([r for r, _ in own], minlength=b.num_rows))].astype(np.int32)
        return b.append_column("tight", pa.ListArray.from_arrays(pa.array(offsets), inner))

    return rows.mapInArrow(lambda batches: map(act, _few(batches)), _with(rows, "tight array<struct<y0:bigint,y1:bigint,x0:bigint,x1:bigint>>"))


def narrowed(rows: DataFrame, gap: int | None) -> DataFrame:
    """Rows with the masks of those in own (structs with det_id and partial) only, and near: the pairs (a < b) of them with pixels within ``gap``
    of each other in either direction, of which one at least is partial (none without a gap)."""
    kind = rows.schema["packed"].dataType.elementType["ids"].dataType.elementType.simpleString()

    def act(b: pa.RecordBatch) -> pa.RecordBatch:
        t, pieces, pairs, ids = _opened(b), [], np.empty((0, 2), np.int64), None
        if t is not None:
            t, flags = _kept(t, {(r, i): bool(p) for r, i, p in _entries(b, "own", "det_id", "partial")})
        if t is not None and t.num_rows:
            k = Masks(t)
            row, ids = t.column("image_id").to_numpy()[k.row], t.column("id").combine_chunks().take(pa.array(k.row))
            runs = [pa.array(row[k.m]), pa.array(np.zeros(len(k.m), np.int32)), ids.take(pa.array(k.m)), pa.array(k.y), pa.array(k.xs), pa.array(k.xe)]
            pieces = list(_pack(iter([pa.RecordBatch.from_arrays(runs, ["image_id", "side", "id", "y", "xs", "xe"])])))
            if gap is not None:
                pairs = near(k, np.array(flags)[k.row], gap)
        entries = pa.Table.from_batches(pieces).combine_chunks() if pieces else None
        fields = b.schema.field("packed").type.value_type
        values = {f.name: entries.column(f.name).combine_chunks().cast(f.type) if pieces else pa.array([], f.type) for f in fields}
        packed = _listed(entries.column("image_id").to_numpy() if pieces else np.empty(0, np.int64), b.num_rows, values)
        ends = {c: pa.array([], fields.field("ids").type.value_type) if ids is None else ids.take(pa.array(pairs[:, i])) for i, c in enumerate("ab")}
        met = _listed(row[pairs[:, 0]] if ids is not None else np.empty(0, np.int64), b.num_rows, ends)
        i = b.schema.get_field_index("packed")
        return b.set_column(i, "packed", packed).append_column("near", met)

    return rows.mapInArrow(lambda batches: map(act, _few(batches)), _with(rows, f"near array<struct<a:{kind},b:{kind}>>"))


def near(k: Masks, partial: np.ndarray, gap: int) -> np.ndarray:
    """Pairs of masks (the first one first) with pixels within ``gap`` of each other in either direction, one of which at least is partial."""
    own = np.flatnonzero(partial)
    if not len(own):
        return np.empty((0, 2), np.int64)
    hit = np.flatnonzero(partial[k.m])
    place, n = np.searchsorted(own, k.m[hit]), len(own)
    steps = np.arange(-gap, gap + 1)
    again = lambda x: np.repeat(x, len(steps))
    m, y, xs, xe = again(place), (k.y[hit][:, None] + steps).ravel(), again(k.xs[hit] - gap), again(k.xe[hit] + gap)
    order = np.lexsort((xs, y, m))
    m, y, xs, xe = m[order], y[order], xs[order], xe[order]
    begin, end, _ = swept(m, y, xs, xe)
    new = np.flatnonzero(begin)
    wide = Masks.__new__(Masks)  # the widened ones, then all
    wide.row, wide.image, wide.side = np.r_[k.row[own], k.row], np.r_[k.image[own], k.image], np.r_[np.zeros(n, int), np.ones(len(k.row), int)]
    wide.set_runs(np.r_[m[new], k.m + n], np.r_[y[new], k.y], np.r_[xs[new], k.xs], np.r_[np.maximum.reduceat(xe, new), k.xe])
    found = [np.stack([own[p], q - n], axis=1) for p, q, _ in shared_pixels(wide, True)]
    pairs = np.sort(np.concatenate(found), axis=1) if found else np.empty((0, 2), np.int64)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def loose(rows: DataFrame, key: str) -> DataFrame:
    """The runs (image_id, key, y, xs, xe) of rows with packed and names (structs of det_id and head): masks of one head are one, their
    union, under its name; others have their own."""
    image, kind = rows.schema["image_id"].dataType.simpleString(), rows.schema["packed"].dataType.elementType["ids"].dataType.elementType.simpleString()

    def run(batches):
        for own in _few(batches):
            t = _opened(own)
            if t is None:
                continue
            heads, ids = {(r, i): h for r, i, h in _entries(own, "names", "det_id", "head")}, t.column("id").to_pylist()
            named = pa.array([heads.get(x, x[1]) for x in zip(t.column("image_id").to_pylist(), ids)], t.schema.field("id").type)
            t = _ordered(t.set_column(t.schema.get_field_index("id"), "id", named))
            k = Masks(t)
            begin, end, _ = swept(k.m, k.y, k.xs, k.xe)
            new = np.flatnonzero(begin)
            first = pa.array(k.row[k.m[new]])
            of = t.column("image_id").combine_chunks().take(first)
            yield pa.RecordBatch.from_arrays([own.column("image_id").take(of), t.column("id").combine_chunks().take(first), pa.array(k.y[new]), pa.array(k.xs[new]), pa.array(np.maximum.reduceat(k.xe, new))], ["image_id", key, "y", "xs", "xe"])

    return rows.select("image_id", "packed", "names").mapInArrow(run, f"image_id {image}, {key} {kind}, y long, xs long, xe long")
