"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within ``max_bits`` of each other are found without comparing all:
a fingerprint is cut into m = ceil((max_bits + 1) / 2) segments, so that of two
linked ones some segment differs by at most one bit. Each distinct segment value
is indexed under its variants with one bit wildcarded, and an equality join of
variants gives the pairs of neighbouring values (a variant has two at most).
Fingerprints of equal or neighbouring segment values are then compared in blocks.

Hot groups: equal fingerprints are one node however many documents share them;
a segment value with many fingerprints is split into blocks of ``BLOCK``, whose
pairs are separate tasks, and a task gives the links that connect (a spanning
forest), not every pair. Components are joined up by ``components``.

Defined results: a null or empty text has fingerprint 0 and is linked like any
other; null keys get the component of their fingerprint, and count for no
component's least key; repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components

SEED = 42
BLOCK = 2048
#: Shingles whose bits are summed at once.
SUMMED = 1 << 16
#: Bytes of a text whose words are Python objects at once, about.
SLICE = 1 << 20
SPACE = re.compile(rb"[ \x09-\x0d]")


def _sliced(data: bytes):
    """Parts of about SLICE bytes, cut at white space."""
    at = 0
    while len(data) - at > SLICE:
        cut = SPACE.search(data, at + SLICE)
        if not cut:
            break
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:] if at else data


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every ``words``-word shingle, repeats included; of a shorter text, of the
    whole. A-Z are lower-cased, and ASCII white space separates words."""
    h, out, w = xxhash.xxh64_intdigest, [], []
    for part in _sliced((text or "").encode("utf-8", "surrogatepass").lower()):
        w = w + part.split() if w else part.split()
        if len(w) < words:
            continue
        joined = b" ".join(w)
        ends = list(accumulate(map(len, w), lambda a, n: a + 1 + n))
        starts = [0, *[e + 1 for e in ends[:-words]]]
        out.append(np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])], np.uint64))
        w = w[len(w) - words + 1 :]
    if out:
        return out[0] if len(out) == 1 else np.concatenate(out)
    return np.array([h(b" ".join(w), SEED)] if w else [], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half of the hashes; signed."""
    n = len(hashes)
    if not n:
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, n, SUMMED):
        part = hashes[at : at + SUMMED]
        count += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    def run(batches):
        for b in batches:
            yield {"doc_id": b["k"], "fp": [fingerprint(shingle_hashes(t, words)) for t in b["t"]]}

    return shared.map_columns(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), run, "doc_id long, fp long")


def segments(bits: int, max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of as few segments as leave one with at most one differing bit."""
    m = (max_bits + 2) // 2
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` of ``nodes`` as the
    links of at most ``max_bits`` differing bits do."""
    if not 0 <= max_bits <= 31:
        raise ValueError("max_bits must be from 0 to 31")
    cut = segments(64, max_bits)
    value = [F.when(F.lit(w == 64), F.col("fp")).otherwise(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << min(w, 63)) - 1))) for s, w in cut]
    parts = nodes.select("fp", F.posexplode(F.array(*value)).alias("seg", "val"))
    sizes = shared.staged(parts.groupBy("seg", "val").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "simhash-sizes")

    width = F.element_at(F.lit([w for _, w in cut]), F.col("seg") + 1)
    # dealt anew, for each row becomes as many as its segment has bits
    parts_ = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = sizes.repartition(parts_).select("seg", "val", F.explode(F.sequence(F.lit(0), width - 1)).alias("pos"))
    bit = F.expr("shiftleft(1L, pos)")
    held = F.when(F.col("val").bitwiseAND(bit) != 0, 2).otherwise(1).cast("byte")
    masked = variants.select((F.col("seg") * 64 + F.col("pos")).cast("short").alias("code"), F.col("val").bitwiseAND(F.bitwise_not(bit)).alias("rest"), held.alias("held"))
    # of the two values of a variant, which are there: neighbours are where both are
    both = masked.groupBy("code", "rest").agg(F.bit_or("held").alias("held")).filter("held = 3")
    both = both.select((F.col("code") / 64).cast("int").alias("seg"), F.col("rest").alias("va"), F.expr("rest | shiftleft(1L, code % 64)").alias("vb"))
    near = both.join(sizes.select("seg", F.col("val").alias("va"), F.col("blocks").alias("na")), ["seg", "va"]).join(sizes.select("seg", F.col("val").alias("vb"), F.col("blocks").alias("nb")), ["seg", "vb"])
    across = near.select("seg", "va", "vb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ba"), "nb").select("seg", "va", "vb", "ba", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bb"))
    inner = sizes.filter("n > 1").select("seg", F.col("val").alias("va"), F.col("val").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ba"), "blocks")
    inner = inner.select("seg", "va", "vb", "ba", F.explode(F.sequence(F.col("ba"), F.col("blocks") - 1)).alias("bb"))
    work = shared.staged(inner.unionByName(across), "simhash-work")

    # only values that are in some work item are gathered
    wanted = work.select("seg", F.col("va").alias("val")).union(work.select("seg", "vb")).distinct()
    placed = parts.join(wanted, ["seg", "val"], "left_semi").join(sizes.select("seg", "val", "blocks"), ["seg", "val"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = shared.staged(placed.groupBy("seg", "val", "block").agg(F.collect_list("fp").alias("fps")), "simhash-blocks")
    left = blocks.select("seg", F.col("val").alias("va"), F.col("block").alias("ba"), F.col("fps").alias("fa"))
    right = blocks.select("seg", F.col("val").alias("vb"), F.col("block").alias("bb"), F.col("fps").alias("fb"))
    items = work.join(left, ["seg", "va", "ba"]).join(right, ["seg", "vb", "bb"])

    def run(batches):
        for b in batches:
            ea, eb = [], []
            for x, y in zip(b["fa"], b["fb"]):
                for p, q in connect(np.array(x, np.int64), np.array(y, np.int64), max_bits):
                    ea.append(p)
                    eb.append(q)
            yield {"a": ea, "b": eb}

    return shared.map_columns(items.select("fa", "fb"), run, "a long, b long")


def connect(x: np.ndarray, y: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints of x and those of y."""
    if len(x) == 1 and len(y) == 1:
        p, q = int(x[0]), int(y[0])
        return [(p, q)] if p != q and ((p ^ q) & ((1 << 64) - 1)).bit_count() <= max_bits else []
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    label, ix, iy = np.arange(len(nodes)), at[: len(x)], at[len(x) :]
    out = []
    for i in range(len(x)):
        hit = iy[np.bitwise_count((y ^ x[i]).view(np.uint64)) <= max_bits]
        if not len(hit):
            continue
        own = label[ix[i]]
        for other in np.unique(label[hit]).tolist():
            if other != own:
                j = hit[label[hit] == other][0]
                out.append((int(x[i]), int(nodes[j])))
                label[label == other] = own
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """A row a document: doc_id, fp (signed 64 bits), component_id, the least doc_id
    that links of at most ``max_bits`` bits reach."""
    rows = shared.staged(fingerprints(docs, key, text, words), "simhash-fingerprints")
    nodes = shared.staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    found = components(links(nodes.select("fp"), max_bits), "simhash-components")
    linked = found.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    named = nodes.join(linked.join(least, "root").select("fp", "component"), "fp", "left").select("fp", "n", F.coalesce("component", "first").alias("component_id"))
    named = shared.staged(named, "simhash-named")
    return shared.looked_up(rows, named, "fp", "n").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
