"""COCO-style JSON read in pieces: one document's arrays are cut by byte offsets, whatever its size.

A piece of a JSON text says little alone: it may begin in a string, and at any depth. So files are scanned first, piece by piece and in
parallel: a piece reports whether it has an odd number of quotation marks, and how it changes the depth if it began outside of a
string and if within one. Put in a row these few numbers give every piece's true beginning. A second scan finds where the document's
arrays lie. Then ``CocoReader`` plans tasks of one piece or several small ones: it parses the objects that begin in a piece, and reads on to the
end of the last one. Only the fields that are asked for are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.datasets import file_name
from ..session import ship

SPLIT_BYTES = 32 << 20
#: Pieces of fewer bytes share a task.
TASK_BYTES = 8 << 20
FIELDS = {
    "images": "id long, height int, width int, file_name string, coco_url string, flickr_url string, not_exhaustive_category_ids array<long>",
    "annotations": "id long, image_id long, category_id long, area double, iscrowd int, bbox array<double>, segmentation string",
    "categories": "id long, name string",
}
QUOTE, BACKSLASH = 34, 92
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
#: How far before an array its key is looked for, and by how much a piece is read on to end its last object.
BEFORE, MORE = 4096, 1 << 16


def open_bytes(path: str):
    """A seekable file of a plain path or any URI that Arrow knows."""
    if "://" not in path:
        return pa.fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/") if path.startswith("file:") else path)
    fs, at = pa.fs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def read_at(f, start: int, size: int) -> bytes:
    f.seek(max(0, start))
    return f.read(size)


def escaped_at(f, start: int) -> bool:
    """Whether the byte at ``start`` stands behind an odd number of backslashes."""
    n, at = 0, start
    while at > 0:
        before = read_at(f, max(0, at - 64), min(64, at))
        kept = before.rstrip(b"\\")
        n += len(before) - len(kept)
        if kept:
            break
        at -= len(before)
    return n % 2 == 1


def structure(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: the quotation marks up to and with it that are no part of a string's text, and +1 or -1 for a bracket (in a string or not)."""
    x = np.frombuffer(data, np.uint8)
    at = np.arange(len(x))
    last = np.maximum.accumulate(np.where(x != BACKSLASH, at, -1)) if len(x) else at
    quotes = np.flatnonzero(x == QUOTE)
    run = quotes - 1 - np.where(quotes > 0, last[quotes - 1], -1)
    run = run + ((run == quotes) & escaped)  # backslashes that reach back before the piece
    marks = np.zeros(len(x), np.int64)
    marks[quotes[run % 2 == 0]] = 1
    step = np.where((x == 123) | (x == 91), 1, np.where((x == 125) | (x == 93), -1, 0))
    return np.cumsum(marks), step


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    quoted: bool
    depth: int


@dataclass
class Pieces(InputPartition):
    """What one task reads, a piece after the other."""

    pieces: list[Piece]


def bundled(pieces: list[Piece], least: int) -> list[Pieces]:
    """Small pieces together, in order: no more tasks than ``least`` and one for every ``TASK_BYTES``."""
    most = max(1, min(TASK_BYTES, sum(p.end - p.start for p in pieces) // max(1, least)))
    out, size = [], most
    for p in pieces:
        if size >= most:
            out.append(Pieces([]))
            size = 0
        out[-1].pieces.append(p)
        size += p.end - p.start
    return out


def pieces(path: str, size: int, split: int) -> list[tuple[str, int, int]]:
    return [(path, at, min(size, at + split)) for at in range(0, size, split)]


def _turns(batches):
    """Of each piece: its quotation marks' parity, and its change of depth from outside and from within a string."""
    for b in batches:
        out = []
        for path, start, end in zip(b["path"], b["start"], b["end"]):
            with open_bytes(path) as f:
                count, step = structure(read_at(f, start, end - start), escaped_at(f, start))
            inside = count % 2 == 1
            out.append((path, start, end, bool(count[-1] % 2) if len(count) else False, int(step[~inside].sum()), int(step[inside].sum())))
        yield pd.DataFrame(out, columns=["path", "start", "end", "odd", "outside", "within"])


def _arrays(batches):
    """Where the arrays of the outermost object begin (with their key) and end, in each piece."""
    for b in batches:
        out = []
        for path, start, end, quoted, depth in zip(b["path"], b["start"], b["end"], b["quoted"], b["depth"]):
            with open_bytes(path) as f:
                data = read_at(f, start, end - start)
                count, step = structure(data, escaped_at(f, start))
                live = np.where((count + int(quoted)) % 2 == 1, 0, step)
                level = depth + np.cumsum(live)
                x = np.frombuffer(data, np.uint8)
                for at in np.flatnonzero((live == 1) & (level == 2) & (x == 91)).tolist():
                    before = read_at(f, max(0, start + at - BEFORE), min(BEFORE, start + at))
                    key = KEY.search(before)
                    out.append((path, start + at + 1, json.loads(b'"' + key.group(1) + b'"') if key else None))
                for at in np.flatnonzero((live == -1) & (level == 1) & (x == 93)).tolist():
                    out.append((path, start + at, None))
        yield pd.DataFrame(out, columns=["path", "at", "key"])


def plan(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> dict[str, list[Piece]]:
    """The pieces of each array of the documents that ``path`` names (a file, a folder or a pattern). Some numbers a piece come to the driver."""
    ship(spark)
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise ValueError(f"{path}: no file")
    found = []
    for p in files:
        with open_bytes(p) as f:
            found += pieces(p, f.size(), split)
    tasks = max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame(found, "path string, start long, end long").repartition(tasks)
    turns = rows.mapInPandas(_turns, "path string, start long, end long, odd boolean, outside long, within long").collect()
    placed, last, quoted, depth = [], None, False, 0
    for r in sorted(turns, key=lambda r: (r.path, r.start)):
        if r.path != last:
            if quoted or depth:
                raise ValueError(f"{last}: the document is cut off")
            last, quoted, depth = r.path, False, 0
        placed.append((r.path, r.start, r.end, quoted, depth))
        depth += r.within if quoted else r.outside
        quoted ^= r.odd
    if quoted or depth:
        raise ValueError(f"{last}: the document is cut off")
    known = spark.createDataFrame(placed, "path string, start long, end long, quoted boolean, depth long").repartition(tasks)
    marks = sorted(known.mapInPandas(_arrays, "path string, at long, key string").collect(), key=lambda r: (r.path, r.at))
    out: dict[str, list[Piece]] = {}
    of: dict[str, list[tuple]] = {}  # a file's pieces, so that an array does not look at those of all files
    for x in placed:
        of.setdefault(x[0], []).append(x)
    for begin, end in zip(marks[::2], marks[1::2]):
        for p, start, stop, quoted, depth in of[begin.path]:
            if start < end.at and stop > begin.at:
                own = start > begin.at
                out.setdefault(begin.key, []).append(Piece(p, start if own else begin.at, min(stop, end.at), quoted if own else False, depth if own else 2))
    return out


def objects(f, piece: Piece) -> Iterator[bytes]:
    """The array's objects that begin in a piece, as text."""
    size, data = f.size(), read_at(f, piece.start, piece.end - piece.start)
    while True:
        count, step = structure(data, escaped_at(f, piece.start))
        live = np.where((count + int(piece.quoted)) % 2 == 1, 0, step)
        level = piece.depth + np.cumsum(live)
        begins = np.flatnonzero((live == 1) & (level == 3))
        begins = begins[begins < piece.end - piece.start]
        ends = np.flatnonzero((live == -1) & (level == 2))
        if not len(begins):
            return
        ends = ends[ends > begins[0]]
        if len(ends) >= len(begins) or piece.start + len(data) >= size:
            break
        data += read_at(f, piece.start + len(data), max(MORE, len(data) // 4))
    for a, b in zip(begins.tolist(), ends.tolist()):
        yield data[a : b + 1]


class CocoReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Pieces]:
        return bundled([Piece(*p) for p in json.loads(self.options["plan"])], int(self.options["least"]))

    def read(self, partition: Pieces):
        arrow = to_arrow_schema(self.schema)
        kinds = {f.name: f.type for f in arrow}

        def value(row: dict, name: str):
            v = row.get(name)
            if v is None:
                return None
            if pa.types.is_string(kinds[name]) and not isinstance(v, str):
                return json.dumps(v, separators=(",", ":"))
            return float(v) if pa.types.is_floating(kinds[name]) else v

        rows = []
        for piece in partition.pieces:
            with open_bytes(piece.path) as f:
                for text in objects(f, piece):
                    row = json.loads(text)
                    rows.append({n: value(row, n) for n in kinds})
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class CocoSource(DataSource):
    """Format ``coco``: options table, columns (comma-separated, all without) plan and least (see ``read`` and ``bundled``)."""

    @classmethod
    def name(cls) -> str:
        return "coco"

    def schema(self) -> str:
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        return ", ".join(f for f in FIELDS[self.options["table"]].split(", ") if not wanted or f.split(" ")[0] in wanted)

    def reader(self, schema: StructType) -> CocoReader:
        return CocoReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, split: int = SPLIT_BYTES, planned: dict[str, list[Piece]] | None = None) -> DataFrame:
    """The objects of array ``table`` (images, annotations, categories) as rows of the ``columns`` asked for."""
    unknown = [c for c in columns or () if c not in [f.split(" ")[0] for f in FIELDS[table].split(", ")]]
    if unknown:
        raise ValueError(f"{table} has no {unknown}")
    found = (plan(spark, path, split) if planned is None else planned).get(table, [])
    spark.dataSource.register(CocoSource)
    parts = json.dumps([[p.path, p.start, p.end, p.quoted, p.depth] for p in found])
    return spark.read.format("coco").option("table", table).option("columns", ",".join(columns or ())).option("least", 4 * spark.sparkContext.defaultParallelism).option("plan", parts).load()


def images(spark: SparkSession, path: str, planned: dict[str, list[Piece]] | None = None) -> DataFrame:
    """As coco.images."""
    rows = read(spark, path, "images", planned=planned)
    named = rows.select(F.struct(*rows.columns).alias("i")).select("i.*", file_name(F.col("i")).alias("name"))
    return named.select(F.col("id").cast("string").alias("image_id"), F.col("id").alias("order"), "height", "width", F.col("name").alias("file_name"), F.coalesce("not_exhaustive_category_ids", F.array().cast("array<bigint>")).alias("not_exhaustive"))


def annotations(spark: SparkSession, path: str, planned: dict[str, list[Piece]] | None = None, columns: tuple[str, ...] = ("bbox", "segmentation")) -> DataFrame:
    """As coco.annotations; of box and segmentation only the ``columns`` asked for are kept."""
    rows = read(spark, path, "annotations", ["id", "image_id", "category_id", "area", "iscrowd", *columns], planned=planned).filter(F.coalesce("iscrowd", F.lit(0)) == 0)
    return rows.select(F.col("image_id").cast("string").alias("image_id"), F.col("id").alias("ann_id"), "category_id", F.coalesce("area", F.lit(0.0)).alias("area"), *columns)


def class_names(spark: SparkSession, path: str, planned: dict[str, list[Piece]] | None = None) -> DataFrame:
    return read(spark, path, "categories", planned=planned).select(F.col("id").alias("category_id"), F.col("name").alias("class_name"))


def write_documents(images_: DataFrame, annotations_: DataFrame, folder: str, per: int = 1000) -> None:
    """Tables (image_id, height, width) and (image_id, ann_id, category_id, area) as COCO-style documents of about ``per`` images each,
    a file a document under ``folder``."""
    entry = lambda *c: F.to_json(F.struct(*c))
    bucket = F.expr(f"image_id div {per}").alias("bucket")
    i = images_.select(bucket, entry(F.col("image_id").alias("id"), "height", "width", F.concat(F.col("image_id").cast("string"), F.lit('{"}.jpg')).alias("file_name")).alias("e"), F.lit(0).alias("kind"))
    a = annotations_.select(bucket, entry(F.expr("image_id * 10000 + ann_id").alias("id"), "image_id", "category_id", "area").alias("e"), F.lit(1).alias("kind"))
    of = lambda k: F.array_join(F.array_sort(F.array_agg(F.when(F.col("kind") == k, F.col("e")))), ", ")
    doc = i.unionByName(a).groupBy("bucket").agg(F.concat(F.lit('{"info": {"note": "a \\"quoted\\" [note]"}, "images": ['), of(0), F.lit('], "annotations": ['), of(1), F.lit('], "categories": []}')).alias("value"))
    doc.write.partitionBy("bucket").text(folder)
