"""Best-two-fit packing of token sequences into bins of a fixed size.

A piece's length is all that packing needs to know of it, and lengths are whole
numbers up to the bin's size. So bins are planned on the histogram of lengths
(at most ``size`` numbers, whatever the corpus): a bin takes the longest piece
left, is filled greedily by the longest that fits, and then its smallest piece
gives way to two unpacked ones if these fill the widened gap more tightly. This is
done twice, first with the pieces longer than a sixth of a bin, then with the others,
which go into the gaps that are left (narrowest first) and then into bins of their
own. A plan that can be repeated is repeated at once. Pieces then take their places
by rank among those of their length; full pieces need no rank.

Defined results: a null text is empty (its end id alone); null keys are kept;
rows with equal keys are packed each on its own (``row`` tells them apart);
``pack`` replaces columns called sequence_id and offset; an empty table gives no rows. No piece is dropped and none is cut
but those of documents longer than a bin.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .tokens import SPECIAL_END, default_tokenizer, encoder

SIZE = 1024
#: Documents encoded together, and pieces of text that a process remembers the ids of.
TOGETHER, REMEMBER = 256, 1_200_000
#: Pieces of up to this part of a bin come second.
SMALL = 6
#: Pieces of one length and salt that are ranked together, about.
RANKED = 2_000


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: only a document longer than ``size`` is cut, its first piece takes the remainder."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Bins for ``counts`` pieces of each length: (how many bins, their lengths, longest first)."""
    counts = {n: c for n, c in counts.items() if c > 0}
    if counts and (min(counts) < 1 or max(counts) > size):
        raise ValueError("a length is below 1 or above the size of a bin")
    begun = _two_fit([], {n: c for n, c in counts.items() if n > size // SMALL}, size)
    return _two_fit(begun, {n: c for n, c in counts.items() if n <= size // SMALL}, size)


def _two_fit(begun: list[tuple[int, list[int]]], left: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Puts the pieces ``left`` into the bins ``begun``, those with the narrowest gap first, and into new ones."""
    have = sum(1 << n for n in left)
    begun = sorted(begun, key=lambda p: (sum(p[1]), p[1]))
    plans = []

    def longest(limit: int) -> int:
        """The longest length of at most ``limit`` that is left, or 0."""
        return (have & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and have & ((1 << (limit + 1)) - 1) else 0

    def take(n: int, by: int = 1) -> None:
        nonlocal have
        left[n] = left.get(n, 0) - by
        have = have | (1 << n) if left[n] else have & ~(1 << n)

    while have:
        times, old = begun.pop() if begun else (0, [])
        new, gap = [], size - sum(old)
        while n := longest(gap):
            take(n)
            new.append(n)
            gap -= n
        if gap and new and len(old) + len(new) > 1:
            small = new[-1]
            room, best = gap + small, (small, 0, 0)
            a = longest(room - 1)
            while a and 2 * a > best[0] and best[0] < room:
                b = longest(min(room - a, a))
                if b == a and left[a] < 2:
                    b = longest(a - 1)
                best = max(best, (a + b, a, b)) if b else best
                a = longest(a - 1)
            if best[0] > small:
                take(small, -1)
                take(best[1])
                take(best[2])
                new = [*new[:-1], best[1], best[2]]
        need = Counter(new)
        more = min([left[n] // k for n, k in need.items()] + ([times - 1] if times else [])) if new else times - 1
        for n, k in need.items():
            if more:
                take(n, k * more)
        plans.append((1 + more, sorted([*old, *new], reverse=True)))
        if times > 1 + more:
            begun.append((times - 1 - more, old))
    return plans + begun


def places(plans: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, how many a bin, first bin, offset), sorted: of the
    pieces of a length, those from ``first rank`` on lie in these bins."""
    rows, ranked, at = [], Counter(), 0
    for times, lengths in plans:
        offset = 0
        for n, k in Counter(lengths).items():  # longest first, equal ones together
            rows.append((n, ranked[n], k, at, offset))
            ranked[n] += k * times
            offset += n * k
        at += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = SIZE, end_id: int = SPECIAL_END) -> DataFrame:
    """Encode whole texts and cut them: doc_id, row, piece, start, length, ids_crc32."""
    tokenizer = tokenizer or default_tokenizer()
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        e, tail = encoder(tokenizer, REMEMBER), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = shared.rows_buffer(names)
            for at in range(0, len(b["k"]), TOGETHER):
                part = slice(at, at + TOGETHER)
                for k, r, ids in zip(b["k"][part], b["r"][part], e.encode_all([t or "" for t in b["t"][part]])):
                    ids += tail
                    for p, (s, n) in enumerate(cut_pieces(len(ids) // 4, size)):
                        rows.add(k, r, p, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield rows.take()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.monotonically_increasing_id().alias("r"), F.col(text).alias("t"))
    return shared.map_columns(rows, run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to rows with ``row``, ``piece`` and ``length`` (1 to ``size``)."""
    pieces = shared.staged(pieces.drop("sequence_id", "offset"), "pieces")
    counts = {int(r.length): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    full = counts.pop(size, 0)
    runs = places(best_two_fit(counts, size))
    whole = pieces.filter(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not counts:
        return whole
    rest = pieces.filter(F.col("length") < size)
    salt, nth_, before = (shared.free_name(pieces.columns, n) for n in ("salt", "rank", "before"))
    salts = F.element_at(F.lit([-(-counts.get(n, 1) // RANKED) for n in range(size)]), F.col("length").cast("int") + 1)
    rest = rest.withColumn(salt, F.pmod(F.xxhash64("row", "piece"), salts))
    ahead = F.sum("n").over(W.partitionBy("length").orderBy(salt).rowsBetween(W.unboundedPreceding, -1))
    starts = rest.groupBy("length", salt).agg(F.count("*").alias("n")).select("length", salt, F.coalesce(ahead, F.lit(0)).alias(before))
    rank = F.row_number().over(W.partitionBy("length", salt).orderBy("row", "piece")) - 1
    ranked = rest.withColumn(nth_, rank.cast("long")).join(starts, ["length", salt]).withColumn(nth_, F.col(nth_) + F.col(before)).drop(before, salt)
    names = [*pieces.columns]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    index = runs[:, 0] * (1 << 44) + runs[:, 1]

    def run(batches):
        for b in batches:
            n, rank = np.array(b["length"], dtype=np.int64), np.array(b[nth_], dtype=np.int64)
            r = runs[np.searchsorted(index, n * (1 << 44) + rank, side="right") - 1]
            nth = rank - r[:, 1]
            yield {c: b[c] for c in names} | {"sequence_id": r[:, 3] + nth // r[:, 2], "offset": r[:, 4] + nth % r[:, 2] * n}

    placed = shared.map_columns(ranked.select(*names, nth_), run, f"{kinds}, sequence_id long, offset long")
    return placed.unionByName(whole) if full else placed


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, tokenizer: str | None = None, end_id: int = SPECIAL_END) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, key, text, tokenizer, size, end_id), size).drop("row")


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(shared.table(spark, sf_dir, "documents"))
