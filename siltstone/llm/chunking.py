"""Document fingerprints from content-defined chunks.

A gear hash rolls over the text's UTF-8 bytes; where its leading bits are zero, a
chunk ends. Normalised: up to the usual length more bits must be zero than beyond
it, so chunks keep near that length, and no chunk is shorter than ``LEAST`` (the
last of a text aside) or longer than ``MOST``. A border depends on the ``WINDOW``
bytes before it, so an insertion moves borders only nearby. The fingerprint is
the set of chunk digests with their lengths; the share of one's length that lies
in chunks of the other measures containment.

Defined results: a null text is empty; the empty fingerprint is contained in any
(likeness 1 to another empty one, else 0); null ids come after all others in
descending order; rows with equal ids follow each other by text; of one row, it
is its own next; an empty table gives no rows. Whole texts are read, in slices of
``SLICE`` bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW, SLICE = 16, 1 << 20
LEAST, USUAL, MOST = 16, 48, 192
#: Bytes of text of a range of keys, ranges dealt to a task, keys looked at to cut one, and the most ranges.
RANGE, DEALT, LOOKED, RANGES = 4 << 20, 4, 40, 50_000
STRICT, LOOSE = np.uint32(0b111111 << 10), np.uint32(0b1111 << 12)
DIGEST_BITS = 40


def _gear() -> np.ndarray:
    """256 numbers from SplitMix64."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


GEAR = _gear()


def gear_hashes(data: bytes, begin: int, end: int) -> np.ndarray:
    """At each byte of [begin, end): the sum of GEAR of the last WINDOW bytes, each shifted left by its distance."""
    lead = min(begin, WINDOW - 1)
    h = GEAR[np.frombuffer(data, np.uint8, end - begin + lead, begin - lead)]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    return h[lead:]


def borders(data: bytes) -> list[int]:
    """Where chunks end, the text's end included."""
    strict, loose = [], []
    for at in range(0, len(data), SLICE):
        h = gear_hashes(data, at, min(len(data), at + SLICE))
        strict += (np.flatnonzero((h & STRICT) == 0) + (at + 1)).tolist()
        loose += (np.flatnonzero((h & LOOSE) == 0) + (at + 1)).tolist()
    strict.append(len(data) + MOST)
    loose.append(len(data) + MOST)
    out, start, i, j, n = [], 0, 0, 0, len(data)
    while n - start > LEAST:
        i = bisect_left(strict, start + LEAST, i)
        cut = strict[i]
        if cut > start + USUAL:
            j = bisect_left(loose, start + USUAL, j)
            cut = min(loose[j], start + MOST)
        if cut >= n:
            break
        out.append(cut)
        start = cut
    return [*out, n] if n else out


def chunk_set(text: str) -> dict[int, int]:
    """Length by digest, of the text's distinct chunks."""
    data, start, out, h = text.encode("utf-8", "surrogatepass"), 0, {}, xxhash.xxh3_64_intdigest
    for end in borders(data):
        out[h(data[start:end]) >> (64 - DIGEST_BITS)] = end - start
        start = end
    return out


def as_text(chunks: dict[int, int]) -> str:
    """A digest in ten hexadecimal digits and its length in two, in ascending order."""
    return "".join(["%010x%02x" % c for c in sorted(chunks.items())])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's length that is in b too."""
    if not a:
        return 0.0 if b else 1.0
    return sum([a[d] for d in a.keys() & b.keys()]) / sum(a.values())


def followed(docs: DataFrame, key: str, text: str, parts: int | None) -> DataFrame:
    """Rows k, t, bucket, tail, dealt so that a task reads each document followed by
    the next one in descending order of its key: ranges of keys, each with the next
    range's first document (``tail`` 1) behind it."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("bytes"), F.count("k").alias("n")).first()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(tasks, min(RANGES, 1 + (size.bytes or 0) // RANGE))
    # keys by which only the ranges are cut: every row falls into one
    keys = rows.filter("k IS NOT NULL").select(F.col("k").cast("double")).sample(min(1.0, LOOKED * parts / max(1, size.n)), 1) if parts > 1 else None
    keys = np.sort(keys.toPandas()["k"].to_numpy()) if keys else np.empty(0)
    cuts = np.unique(keys[[len(keys) * i // parts for i in range(1, parts)]]).tolist() if len(keys) else []
    split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="d", outputCol="bucket", handleInvalid="keep") if cuts else None
    own = split.transform(rows.withColumn("d", F.col("k").cast("double"))).drop("d") if cuts else rows.withColumn("bucket", F.lit(0.0))
    rows = own.withColumn("bucket", F.when(F.col("k").isNull(), -1).otherwise(F.col("bucket")).cast("int"))
    heads = rows.groupBy("bucket").agg(F.max("k").alias("k")).collect()  # a row a range
    heads = sorted([(r.bucket, r.k) for r in heads], key=lambda x: x[0])
    above = [(k, heads[(i + 1) % len(heads)][0]) for i, (_, k) in enumerate(heads)]
    to = docs.sparkSession.createDataFrame(above, "hk long, above int")
    own = rows.withColumn("tail", F.lit(0))
    first = rows.join(F.broadcast(to), F.col("k").eqNullSafe(F.col("hk"))).select("k", "t", F.col("above").alias("bucket"), F.lit(1).alias("tail"))
    return own.unionByName(first).repartition(max(tasks, parts // DEALT), "bucket").sortWithinPartitions(F.desc("bucket"), "tail", F.desc_nulls_last("k"), "t")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited form (its last half replaced by the next document's beginning)."""

    def run(batches):
        before, rows = None, shared.rows_buffer(NAMES, 512)
        for b in batches:
            for k, t, bucket, tail in zip(b["k"], b["t"], b["bucket"], b["tail"]):
                t = t or ""
                chunks = chunk_set(t)
                if before and before[2] == bucket and not before[3]:
                    k0, t0, _, _, own = before
                    e = edited(t0, t)
                    changed = chunk_set(e)
                    rows.add(k0, len(t0), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(changed), containment(own, changed), containment(own, chunks))
                before = (k, t, bucket, tail, chunks)
                if rows.full():
                    yield rows.take()
        if rows:
            yield rows.take()

    return shared.map_columns(followed(docs, key, text, parts), run, SCHEMA)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, and the digests and lengths of its distinct chunks in ascending order."""

    def run(batches):
        for b in batches:
            sets = [sorted(chunk_set(t or "").items()) for t in b["t"]]
            yield {"doc_id": b["k"], "digests": [[d for d, _ in s] for s in sets], "lengths": [[n for _, n in s] for s in sets]}

    return shared.map_columns(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), run, "doc_id long, digests array<long>, lengths array<int>")


def op5_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(shared.table(spark, sf_dir, "documents"))
