"""WARC archives, each record a Zstandard frame of its own, with a dictionary built
from the archive's records and kept in a leading skippable frame.

Of records with equal payloads, one is a response and the others are revisits
that name it. Equal payloads are found by SHA-1 in the engine; pages of a payload
that many share are written where they are read. A task writes
one file: it gathers records up to ``GATHERED`` bytes, trains the dictionary on
an even choice of them (at most ``SAMPLED`` bytes), writes them and streams the
rest. Files are written under a name of their own and renamed, so a task that
runs again replaces its file by an equal one.

Defined results: a null payload is empty, a null URL is ``about:blank``; a row
without page_id is written without one, and is a response only if no equal
payload has an id; rows that repeat the largest page_id are responses each; an
empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .token_shards import as_dictionary, train_dictionary

SKIPPABLE = struct.Struct("<II")
MAGIC = 0x184D2A5D
GATHERED, SAMPLED, DICT_BYTES = 16 << 20, 1 << 20, 32 << 10
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WHEN = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID(int=0x5117)


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def build_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a record's block has another length than its header says")
    return headers, rest[:n]


def page_record(page: int | None, url: str | None, html: str, sha1_hex: str, refers: int | None, revisit: bool, name: str) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    clean = "".join((url or "about:blank").split())
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(f"page {page}" if page is not None else name), "WARC-Date": WHEN, "WARC-Target-URI": clean, "WARC-Payload-Digest": f"sha1:{base32(sha1_hex)}"}
    if page is not None:
        headers["WARC-X-Page-Id"] = str(page)
    if revisit:
        headers |= {"WARC-Profile": SAME, "WARC-Refers-To": record_id(f"page {refers}")}
    headers["Content-Type"] = "application/http; msgtype=response"
    return build_record(headers, http if revisit else http + payload)


def compressed(records: Iterator[bytes], level: int = 3) -> Iterator[bytes]:
    """The archive's bytes: the dictionary's frame, then a frame a record."""
    head, size = [], 0
    for r in records:
        head.append(r)
        size += len(r)
        if size >= GATHERED:
            break
    step = max(1, -(-size // SAMPLED))
    data = train_dictionary([r[: 128 << 10] for r in head[::step]], DICT_BYTES)
    yield SKIPPABLE.pack(MAGIC, len(data)) + data
    d = as_dictionary(data)
    c = zstandard.ZstdCompressor(level=level, dict_data=d) if d else zstandard.ZstdCompressor(level=level)
    for r in head:
        yield c.compress(r)
    del head
    for r in records:
        yield c.compress(r)


def read_archive(path: str, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, in order."""
    with shared.open_file(path) as f:
        magic, n = SKIPPABLE.unpack(f.read(SKIPPABLE.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: no dictionary frame")
        d = as_dictionary(f.read(n))
        z = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
        rest = f.read(piece)
        while rest:
            frame, out = z.decompressobj(), []
            while True:
                out.append(frame.decompress(rest))
                if frame.eof:
                    rest = frame.unused_data or f.read(piece)
                    break
                rest = f.read(piece)
                if not rest:
                    raise ValueError(f"{path}: a frame is cut off")
            yield parse_record(b"".join(out))


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds sha1 and keep: the largest page_id of the rows with an equal payload of at least ``least`` bytes, if there are others."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    again = rows.filter(F.octet_length("html") >= least).groupBy("sha1").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    return shared.looked_up(rows, shared.staged(again, "warc-again"), "sha1", "n")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages; returns the manifest: path, n_records, n_bytes."""

    def write(batches):
        first = next(batches, None)
        if first is None:
            return
        part, n = TaskContext.get().partitionId(), 0

        def records():
            nonlocal n
            yield build_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(f"{folder} {part}"), "WARC-Date": WHEN, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
            b = first
            while b is not None:
                for page, url, html, sha1, keep in zip(b["page_id"], b["url"], b["html"], b["sha1"], b["keep"]):
                    yield page_record(page, url, html, sha1, keep, keep is not None and page != keep, f"{folder} {part} {n}")
                    n += 1
                b = next(batches, None)

        path = f"{folder}/part-{part:06d}.warc.zst"
        size = shared.write_file(path, compressed(records()))
        yield {"path": [path], "n_records": [n], "n_bytes": [size]}

    return shared.staged(shared.map_columns(with_revisits(pages, least), write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row a record: page_id, payload_bytes, payload_digest, record_type, record_id,
    refers_id. A response's payload is held against its digest."""
    n = max(1, manifest.count())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_id"]

    def read(batches):
        for b in batches:
            for path in b["path"]:
                rows = shared.rows_buffer(names)
                for headers, block in read_archive(path):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                    page = headers.get("WARC-X-Page-Id")
                    rows.add(int(page) if page else None, size, digest, kind, headers["WARC-Record-ID"], headers.get("WARC-Refers-To"))
                    if rows.full():
                        yield rows.take()
                if rows:
                    yield rows.take()

    return shared.map_columns(manifest.select("path").repartition(n), read, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string")


def resolve(records: DataFrame) -> DataFrame:
    """Follows refers_id: a revisit's size is that of the response it names."""
    records = shared.staged(records, "warc-records")
    times = records.filter("record_type = 'revisit'").groupBy("refers_id").agg(F.count("*").alias("n"))
    named = records.filter("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("size")).withColumnRenamed("record_id", "refers_id")
    named = shared.staged(times.join(named, "refers_id"), "warc-named")
    own = records.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = shared.looked_up(records.filter("record_type = 'revisit'"), named, "refers_id", "n")
    return own.unionByName(again.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(read_archives(write_archives(shared.table(spark, sf_dir, "pages"), shared.fresh_path(spark, "warc"))))
