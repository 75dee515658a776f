"""What the operators of this subpackage share: tables, staging, Arrow maps.

Staged tables and files live in the folder that ``spark.checkpoint.dir``
names, because it is the only place that the driver and all executors see.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import ship

#: Of an Arrow batch, about so many bytes are Python objects at a time.
PIECE_BYTES = 8 << 20
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set (tests), a folder of our own, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        app = spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="siltstone-")
            spark.sparkContext.setCheckpointDir(_OWN[app])
        found = _OWN[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, computes it once, and survives the loss of executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that more than one in so many rows have are joined by broadcast: there are fewer than that.
HOT = 4096


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` left-joined with ``table``, which has every ``key`` once and in ``n`` how many
    of the rows have it. Rows of a hot key stay where they are."""
    hot = (table.agg(F.sum(n)).first()[0] or 0) / HOT
    mark = free_name([*rows.columns, *table.columns], "hot")
    often = rows.join(F.broadcast(table.filter(F.col(n) > hot).drop(n).withColumn(mark, F.lit(True))), key, "left")
    seldom = often.filter(F.col(mark).isNull()).select(*rows.columns).join(table.filter(F.col(n) <= hot).drop(n), key, "left")
    return often.filter(F.col(mark)).drop(mark).unionByName(seldom)


def is_local(path: str) -> bool:
    return "://" not in path and not path.startswith("file:")


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path within it, for a plain path or any URI that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if is_local(path):
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path)


def write_file(path: str, chunks: Iterator[bytes]) -> int:
    """Write through a name of its own, then rename: a task that is retried or
    runs twice leaves one whole file. Returns the bytes written."""
    fs, at = filesystem(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    part, n = f"{at}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    fs.move(part, at)
    return n


def open_file(path: str):
    """A seekable file-like object."""
    fs, at = filesystem(path)
    return fs.open_input_file(at)


#: What a Python worker remembers between tasks: the modules that use it, and how to forget it.
_MEMORIES: list[tuple[frozenset[str], Callable[[], None]]] = []


def remembers(forget: Callable[[], None], *users: str) -> None:
    _MEMORIES.append((frozenset(users), forget))


_TURNED: list[str] = []


def begin(user: str) -> None:
    """A worker turns to work of module ``user``: what only others use is forgotten and
    given back, so that operators which follow each other do not add up their memories."""
    if _TURNED == [user]:
        return
    for users, forget in _MEMORIES:
        if user not in users:
            forget()
    give_back()
    _TURNED[:] = [user]


def give_back() -> None:
    """Memory that is free goes back to the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_columns(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], ddl: str) -> DataFrame:
    """mapInArrow with columns as Python lists: ``fn`` gets and gives an iterator of
    {name: values}; values may be lists or NumPy arrays."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(schema_of(ddl))
    user = fn.__module__.rpartition(".")[2]

    def run(batches):
        begin(user)

        def columns():
            for whole in batches:
                step = max(1, whole.num_rows * PIECE_BYTES // max(whole.nbytes, 1))
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    yield {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}

        for out in fn(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, ddl)


def rows_buffer(names: list[str], limit: int = 4096):
    """Collects rows for ``map_columns``: add(row) gives a batch now and then, rest() the last."""
    return _Rows(names, limit)


class _Rows:
    def __init__(self, names: list[str], limit: int):
        self.names, self.limit, self.cols = names, limit, [[] for _ in names]

    def add(self, *row) -> None:
        for c, v in zip(self.cols, row):
            c.append(v)

    def full(self) -> bool:
        return len(self.cols[0]) >= self.limit

    def take(self) -> dict[str, list]:
        out = dict(zip(self.names, self.cols))
        self.cols = [[] for _ in self.names]
        return out

    def __bool__(self) -> bool:
        return bool(self.cols[0])


def free_name(columns: list[str], base: str) -> str:
    """A column name that none of ``columns`` clashes with."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base
