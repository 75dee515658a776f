"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are normalised (lower case, anything but letters and
digits becomes one blank). An item of m characters that occurs with at most e
edits shares at least m + 1 - Q (e + 1) of its q-grams with the place, on
diagonals that differ by at most e. So, for each document:

1. its q-grams are looked up in the items' (a bit table, then the sorted grams);
   stretches with too few hits for any item of their length are left out;
2. hits are counted by item in bands of diagonals, 2 (e + 1) wide, each
   overlapping half of the next; a band with fewer than the lemma's bound is out;
3. what remains is verified by a banded alignment within the edit budget.

The budget is ``RATE`` of an item's characters, less where the lemma would
allow no filter; items shorter than a q-gram must occur as whole words. The
q-grams are of characters' low bytes, which can only add hits; alignment
compares characters. Items are used in blocks of about ``BLOCK_CHARS`` characters, one pass over
the documents a block, whose matches are written before the next block is gathered: so what
the driver holds and a task is sent is bounded whatever the benchmark's size. Hits are counted
``COUNTED`` at a time, however many items share a q-gram.

Defined results: null and empty texts have no matches; items that are null or hold
no letter or digit match nothing; repeated items and rows each match; of
several places of an item the one with fewest edits, the first of these, is told.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

Q, RATE = 8, 0.08
BLOCK_CHARS = 4_000_000
COUNTED = 1 << 20
#: Codes of (item, band of diagonals): bands of texts of up to 2^40 characters.
BAND_BITS, BAND_ZERO = 42, 1 << 41
OTHER = re.compile(r"[\W_]+")
STEP = 16
TABLE_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)
MATCH = "array<struct<item_id:long,start:long,edits:int>>"


def normalise(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def low_bytes(text: str) -> bytes:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint8).tobytes()


def grams(data: bytes) -> np.ndarray:
    """Every Q bytes of data as a number."""
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, strides=(1,)).copy() if len(data) >= Q else np.empty(0, np.uint64)


def slot(g: np.ndarray) -> np.ndarray:
    return ((g * MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


def budget(m: int, rate: float) -> int:
    """Edits allowed in an item of m characters: a quarter of its q-grams at least must be left to count."""
    return max(0, min(int(rate * m), (m + 1 - max(1, (m + 1 - Q) // 4)) // Q - 1))


def banded(item: str, text: str, low: int, high: int, limit: int) -> tuple[int, int] | None:
    """(edits, start) of item in text, on diagonals from low to high and ``limit`` beyond:
    the text around these diagonals is cut out and only cells of the band are computed."""
    a = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), "<u4")
    low, high = low - limit, high + limit
    width = high - low + 1
    begin, end = low, high + len(a)
    part = text[max(0, begin) : max(0, end)]
    b = np.zeros(end - begin, np.int64) - 1  # -1 stands outside the text
    lead = max(0, begin) - begin
    b[lead : lead + len(part)] = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(end - begin + 1, bool)
    inside[lead : lead + len(part) + 1] = True
    far = len(a) + len(b) + 1
    at = np.arange(width)
    row = np.where(inside[:width], 0, far)  # column k of row i is place begin + i + k
    origin = at.copy()
    for i in range(1, len(a) + 1):
        across = row + (b[i - 1 : i - 1 + width] != a[i - 1])
        down = np.append(row[1:] + 1, far)
        new = np.where(down < across, down, across)
        start = np.where(down < across, np.append(origin[1:], 0), origin)
        new = np.where(inside[i : i + width], new, far)
        slid = new - at
        run = np.minimum.accumulate(slid)
        first = np.maximum.accumulate(np.where(slid == run, at, 0))
        row, origin = run + at, start[first]
        if row.min() > limit:
            return None
    best = int(row.min())
    return (best, begin + int(origin[int(np.argmin(row))])) if best <= limit else None


@dataclass
class Index:
    """q-grams of a block of items."""

    items: list[tuple[int | None, str]]
    rate: float = RATE

    def __post_init__(self):
        own = [(k, normalise(t)) for k, t in self.items]
        self.short = [(k, t) for k, t in own if t and len(t) < Q]
        self.long = [(k, t) for k, t in own if len(t) >= Q]
        m = np.array([len(t) for _, t in self.long], np.int64)
        self.edits = np.array([budget(n, self.rate) for n in m.tolist()], np.int64)
        self.bound = m + 1 - Q * (self.edits + 1)
        g = [grams(low_bytes(t)) for _, t in self.long]
        all_ = np.concatenate(g) if g else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.empty(0, np.int64)
        order = np.argsort(all_, kind="stable")
        self.keys, first, self.many = np.unique(all_[order], return_index=True, return_counts=True)
        self.first, self.item, self.place = first, item[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slot(self.keys)] = True
        groups: dict[int, list[int]] = {}
        for i, n in enumerate(m.tolist()):
            groups.setdefault(int(np.log(n) / np.log(1.2)), []).append(i)
        #: (steps that a place of such an item touches at most, hits it has at least)
        self.groups = [(int(max(m[i] + self.edits[i] for i in x)) // STEP + 2, int(min(self.bound[i] for i in x))) for x in groups.values()]

    def __getstate__(self):
        return {"items": self.items, "rate": self.rate}

    def __setstate__(self, state):
        self.__init__(**state)

    def _dense(self, hit: np.ndarray) -> np.ndarray:
        """Of the hits, those in a stretch with enough for some item."""
        steps = -(-len(hit) // STEP)
        sums = np.concatenate([[0], np.cumsum(np.concatenate([hit, np.zeros(steps * STEP - len(hit), bool)]).reshape(steps, STEP).sum(axis=1))])
        live = np.zeros(steps + 1, np.int64)
        for width, least in self.groups:
            if sums[-1] < least:
                continue
            begin = np.arange(steps)
            end = np.minimum(begin + width, steps)
            full = np.flatnonzero(sums[end] - sums[begin] >= least)
            np.add.at(live, full, 1)
            np.subtract.at(live, end[full], 1)
        kept = np.flatnonzero(np.cumsum(live)[:steps] > 0)
        if not len(kept):
            return kept
        at = (kept[:, None] * STEP + np.arange(STEP)).ravel()
        at = at[at < len(hit)]
        return at[hit[at]]

    def _counted(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) codes and their hits, for text places ``at`` that hold the q-grams ``k``."""
        # a q-gram with more places than COUNTED comes in slices of them
        slices = -(-self.many[k] // COUNTED)
        nth = np.arange(slices.sum()) - np.repeat(np.cumsum(slices) - slices, slices)
        at, k = np.repeat(at, slices), np.repeat(k, slices)
        first, many = self.first[k] + nth * COUNTED, np.minimum(self.many[k] - nth * COUNTED, COUNTED)
        parts = np.flatnonzero(np.diff(np.cumsum(many) // COUNTED, prepend=0)) + 1
        bands, hits = np.empty(0, np.int64), np.empty(0, np.int64)
        for lo, hi in zip([0, *parts.tolist()], [*parts.tolist(), len(at)]):
            n = many[lo:hi]
            if not len(n):
                continue
            which = np.repeat(first[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, diagonal = self.item[which], np.repeat(at[lo:hi], n) - self.place[which]
            code = item * (1 << BAND_BITS) + np.floor_divide(diagonal, self.edits[item] + 1) + BAND_ZERO
            found, count = np.unique(np.concatenate([code, code + 1]), return_counts=True)
            if len(bands):
                found, back = np.unique(np.concatenate([bands, found]), return_inverse=True)
                count = np.bincount(back, np.concatenate([hits, count])).astype(np.int64)
            bands, hits = found, count
        return bands, hits

    def matches(self, text: str | None) -> list[dict]:
        norm = normalise(text) if text else ""
        found: dict[int, tuple[int, int]] = {}
        if self.long and len(norm) >= Q:
            g = grams(low_bytes(norm))
            at = self._dense(self.table[slot(g)])
            if len(at):
                k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
                same = self.keys[k] == g[at]
                at, k = at[same], k[same]
                bands, hits = self._counted(at, k)
                item, band = bands >> BAND_BITS, (bands & ((1 << BAND_BITS) - 1)) - BAND_ZERO
                for i, j in zip(item[hits >= self.bound[item]].tolist(), band[hits >= self.bound[item]].tolist()):
                    e, t = int(self.edits[i]), self.long[i][1]
                    low, high = (j - 1) * (e + 1), (j + 1) * (e + 1)
                    if i in found and found[i][0] == 0:
                        continue
                    whole = norm.find(t, max(0, low), max(0, high) + len(t))
                    place = (0, whole) if whole >= 0 else banded(t, norm, low, high, e) if e else None
                    if place and (i not in found or place < found[i]):
                        found[i] = place
        out = [{"item_id": self.long[i][0], "start": s, "edits": e} for i, (e, s) in sorted(found.items())]
        if self.short and norm:
            padded = f" {norm} "
            out += [{"item_id": k, "start": padded.find(f" {t} "), "edits": 0} for k, t in self.short if f" {t} " in padded]
        return out


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text", rate: float = RATE) -> tuple[int, Iterator[Index]]:
    """How many blocks of about BLOCK_CHARS characters the benchmark has, and these one by one."""
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    part = F.pmod(F.xxhash64("k", "t"), F.lit(max(1, n)))
    return n, (Index(sorted(((r.k, r.t) for r in rows.filter(part == i).collect()), key=lambda x: (x[0] is None, x)), rate) for i in range(n))


def matcher(index: Index):
    """A column function: the items that a text column holds, with place and edits."""

    @F.pandas_udf(MATCH)
    def held(texts: pd.Series) -> pd.Series:
        shared.begin("decontaminate")
        return pd.Series([index.matches(t) for t in texts], dtype=object)

    return held


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """A row for each item that a document holds: doc_id, item_id, start (in the normalised text), edits."""
    n, blocks = indexes(benchmark, rate=rate)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = []
    for index in blocks:
        part = rows.select("doc_id", F.explode(matcher(index)(F.col("text"))).alias("m")).select("doc_id", "m.item_id", "m.start", "m.edits")
        found.append(shared.staged(part, "matches") if n > 1 else part)
    none = rows.select("doc_id", F.explode(F.array().cast(MATCH)).alias("m")).select("doc_id", "m.item_id", "m.start", "m.edits")
    return functools.reduce(DataFrame.unionByName, found) if found else none


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    n, blocks = indexes(benchmark, rate=rate)
    for i, index in enumerate(blocks):
        docs = docs.filter(F.size(matcher(index)(F.col(text))) == 0)
        docs = shared.staged(docs, "uncontaminated") if i + 1 < n else docs
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
