"""Token-id shards: every document's ids, compressed one by one with one shared dictionary.

A shard is: header (magic, SHA-256 of the dictionary, bytes an id), the
documents' Zstandard frames, the index (id, place, tokens of each), footer. A
reader fetches one document by its index entry and refuses another dictionary.

Defined results: a null text is the empty text (its end id alone); null
document ids come first; rows with equal ids are all kept, next to each other;
an empty table gives no rows. The dictionary is trained on a bounded sample
(about ``DICT_DOCS`` documents by a hash of their id, twice as many at most, those
of over ``DICT_CHARS`` characters aside); everything else covers all rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .tokens import SPECIAL_END, default_tokenizer, encoder

MAGIC = b"TOKSHRD1"
HEADER = struct.Struct("<8s32sB7x")
FOOTER = struct.Struct("<QQ8s")
DICT_DOCS, DICT_CHARS, DICT_BYTES = 1500, 20_000, 65_536
#: Pieces of text that a process remembers with their ids.
REMEMBER = 1_200_000
#: Documents that are encoded together.
GROUP = 256
MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long"


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of few samples, their own bytes as one; of none, nothing."""
    samples = [s for s in samples if s]
    total = sum(map(len, samples))
    if len(samples) >= 20 and total > 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 10)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    """Gives the bytes of a shard: chunks from add(), the rest from close()."""

    def __init__(self, dictionary: bytes, width: int, level: int = 3):
        d = as_dictionary(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=d) if d else zstandard.ZstdCompressor(level=level)
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.head = HEADER.pack(MAGIC, hashlib.sha256(dictionary).digest(), width)
        self.at, self.keys, self.null, self.places, self.tokens = HEADER.size, [], [], [], []

    def add(self, key: int | None, ids: np.ndarray) -> bytes:
        frame = self.compressor.compress(ids.astype(self.kind).tobytes())
        self.keys.append(0 if key is None else key)
        self.null.append(key is None)
        self.places.append(self.at)
        self.tokens.append(len(ids))
        self.at += len(frame)
        return frame

    def close(self) -> bytes:
        index = b"".join(np.array(x, dtype=t).tobytes() for x, t in ((self.keys, "<i8"), (self.null, "<u1"), (self.places, "<u8"), (self.tokens, "<u8")))
        return index + FOOTER.pack(self.at, len(self.keys), MAGIC)


class ShardReader:
    """Random access to a shard: len(), keys, n_tokens, ids(k), find(key)."""

    def __init__(self, path: str, dictionary: bytes):
        self.file = shared.open_file(path)
        self.file.seek(0)
        magic, digest, width = HEADER.unpack(self.file.read(HEADER.size))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: not a shard of this dictionary")
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        self.end, n, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: no whole shard")
        self.file.seek(self.end)
        index = self.file.read(size - FOOTER.size - self.end)
        self.keys = np.frombuffer(index, "<i8", n, 0)
        self.null = np.frombuffer(index, "<u1", n, 8 * n)
        self.places = np.frombuffer(index, "<u8", n, 9 * n)
        self.n_tokens = np.frombuffer(index, "<u8", n, 17 * n)
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        d = as_dictionary(dictionary)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.keys)

    def key(self, k: int) -> int | None:
        return None if self.null[k] else int(self.keys[k])

    def ids(self, k: int) -> np.ndarray:
        at, to = int(self.places[k]), int(self.places[k + 1]) if k + 1 < len(self) else self.end
        self.file.seek(at)
        return np.frombuffer(self.decompressor.decompress(self.file.read(to - at)), self.kind).astype("<u4")

    def find(self, key: int) -> np.ndarray | None:
        live = np.flatnonzero((self.keys == key) & (self.null == 0))
        return self.ids(int(live[0])) if len(live) else None

    def close(self) -> None:
        self.file.close()


def sample_dictionary(docs: DataFrame, key: str, text: str, tokenizer: str) -> bytes:
    """A dictionary of the ids of a bounded sample of whole documents."""
    every = max(1, docs.count() // DICT_DOCS)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.pmod(F.xxhash64("k"), F.lit(every)) == 0)
    chosen = rows.filter(F.length("t").between(1, DICT_CHARS)).select("t").limit(2 * DICT_DOCS)
    ids = shared.map_columns(chosen, _serialized(tokenizer), "ids binary")
    return train_dictionary([bytes(r.ids) for r in ids.collect()])


def _serialized(tokenizer: str):
    def run(batches):
        e = encoder(tokenizer, REMEMBER)
        kind = "<u2" if id_width(e.tokenizer.get_vocab_size()) == 2 else "<u4"
        for b in batches:
            yield {"ids": [np.frombuffer(i, "<u4").astype(kind).tobytes() for i in e.encode_all(b["t"])]}

    return run


def write_token_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = SPECIAL_END, shards: int | None = None) -> tuple[DataFrame, bytes]:
    """Encode whole texts, append ``end_id``, and write shards in ascending key
    order under ``folder``. Returns the manifest (one row a shard, in order by
    ``shard``) and the dictionary, which is also written beside the shards."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dictionary = sample_dictionary(docs, key, text, tokenizer)

    def write(batches):
        first = next(batches, None)
        if first is None:
            return
        e = encoder(tokenizer, REMEMBER)
        shard = TaskContext.get().partitionId()
        w = ShardWriter(dictionary, id_width(max(e.tokenizer.get_vocab_size(), end_id + 1)))
        path = f"{folder}/shard-{shard:06d}.tok"
        tail = np.array([end_id], "<u4").tobytes()

        def chunks():
            yield w.head
            b = first
            while b is not None:
                for at in range(0, len(b["k"]), GROUP):
                    for k, ids in zip(b["k"][at : at + GROUP], e.encode_all([t or "" for t in b["t"][at : at + GROUP]])):
                        yield w.add(k, np.frombuffer(ids + tail, "<u4"))
                b = next(batches, None)
            yield w.close()

        n = shared.write_file(path, chunks())
        yield {"shard": [shard], "path": [path], "n_docs": [len(w.keys)], "n_tokens": [sum(w.tokens)], "n_bytes": [n]}

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(shards, "k").sortWithinPartitions("k", "t")
    manifest = shared.staged(shared.map_columns(rows, write, MANIFEST), "token-manifest")
    dict_file = spark.createDataFrame([(dictionary,)], "data binary").coalesce(1)
    shared.staged(shared.map_columns(dict_file, _put(f"{folder}/dictionary.zstd"), "n long"), "token-dictionary")
    return manifest, dictionary


def _put(path: str):
    def run(batches):
        for b in batches:
            yield {"n": [shared.write_file(path, [b["data"][0]])]}

    return run


def read_token_shards(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """What the shards hold, a row a document: doc_id, shard, row, start (ids of all
    documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), n_bytes (compressed)."""
    n = max(1, manifest.count())
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("shard", "path", before.alias("before")).repartition(n, "shard")

    def read(batches):
        for b in batches:
            for shard, path, start in zip(b["shard"], b["path"], b["before"]):
                r = ShardReader(path, dictionary)
                rows = shared.rows_buffer(["doc_id", "shard", "row", "start", "n_tokens", "ids_crc32", "n_bytes"])
                for k in range(len(r)):
                    ids = r.ids(k)
                    to = int(r.places[k + 1]) if k + 1 < len(r) else r.end
                    rows.add(r.key(k), shard, k, start, len(ids), zlib.crc32(ids.tobytes()), to - int(r.places[k]))
                    start += len(ids)
                    if rows.full():
                        yield rows.take()
                r.close()
                if rows:
                    yield rows.take()

    return shared.map_columns(placed, read, "doc_id long, shard long, row long, start long, n_tokens long, ids_crc32 long, n_bytes long")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, dictionary = write_token_shards(shared.table(spark, sf_dir, "documents"), shared.fresh_path(spark, "token-shards"))
    return read_token_shards(manifest, dictionary)
