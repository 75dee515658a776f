"""Trace events as a stream: each region's final decision, from events in any order.

A region's event says how many children it has and how deep it lies. A region and its children are a family, which
is decided once all of it has come: which children are worth pursuing and so what becomes of their parent. What a
stream leaves open is decided when the watermark passes ``patience`` behind a family's last event, from what has come;
timers are in event time, so a stream without new data comes to rest.

State is kept by image and a share of its families (``SHARES``), so an image with very many regions is in many groups,
and it holds open families only. Each region gets one decision: regions with children ``zoom`` or ``reid-stop``, others
``leaf`` (worth pursuing, or a root), ``below-floor`` (a sibling is) or ``reid-worse`` (none is). ``level`` and ``phase`` order
them as the search reports them: what a level's families decide (0) comes before the ends of its survivors (1).

A NULL image or region is no event. An event that comes twice counts once. A family whose parent never came calls its
childless members leaves. Events later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

EVENT = "image_id long, node_id long, parent_id long, n_children int, depth int, kind string, reid_score double, ts timestamp"
FINAL = "image_id long, node_id long, decision string, best_child double, level int, phase int"
#: A family's parts as they lie in the state: one entry an event and role.
STATE = "family array<long>, node array<long>, score array<double>, children array<int>, depth array<int>, last array<long>"
SHARES = 16


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class Family:
    """A region (``own``: score, children, depth; None until it comes) and the children that have come."""

    __slots__ = ("own", "kids", "last")

    def __init__(self):
        self.own, self.kids, self.last = None, {}, 0

    def add(self, family: int, node: int, score: float, children: int, depth: int, last: int) -> None:
        if node == family:
            self.own = score, children, depth
        else:
            self.kids[node] = score, children, depth
        self.last = max(self.last, last)

    def whole(self) -> bool:
        return self.own is not None and len(self.kids) >= self.own[1]

    def decided(self, family: int, floor: float) -> Iterator[tuple]:
        """(node, decision, best child's score or None, level, phase) in the order of the search."""
        scores = {n: s for n, (s, _, _) in self.kids.items()}
        best = max(scores.values(), default=None)
        if self.own is None:
            alive = set(scores)
        elif len(scores) <= 1 or best <= self.own[0]:
            alive = {n for n, s in scores.items() if s > self.own[0]}
        else:
            alive = {n for n, s in scores.items() if s > self.own[0] or s >= floor}
        ends = sorted(n for n, (_, c, _) in self.kids.items() if not c)
        for n in ends:
            if n not in alive:
                yield n, "below-floor" if alive else "reid-worse", None, self.kids[n][2], 0
        if self.own is not None:
            _, children, depth = self.own
            if children:
                yield family, "zoom" if alive else "reid-stop", best, depth + 1, 0
            elif not depth:  # a lone root
                yield family, "leaf", None, depth, 1
        for n in ends:
            if n in alive:
                yield n, "leaf", None, self.kids[n][2], 1


def _step(floor: float, patience_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, Family] = {}
        for row in zip(*state.get) if state.exists else ():
            held.setdefault(row[0], Family()).add(*row)
        for rows in () if state.hasTimedOut else batches:
            for r in rows.itertuples(index=False):
                held.setdefault(int(r.family), Family()).add(int(r.family), int(r.node_id), float(r.reid_score), int(r.n_children), int(r.depth), int(r.ms))
        now = state.getCurrentWatermarkMs()
        out = []
        for f in [f for f, x in held.items() if x.whole() or x.last + patience_ms <= now]:
            out += [(key[0], *d) for d in held.pop(f).decided(f, floor)]
        kept = []
        for f, x in held.items():
            own = [] if x.own is None else [(f, *x.own)]
            kept += [(f, n, s, c, d, x.last) for n, s, c, d in own + [(n, *k) for n, k in x.kids.items()]]
        if kept:
            state.update(tuple(list(c) for c in zip(*kept)))
            state.setTimeoutTimestamp(max(min(x.last for x in held.values()) + patience_ms, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["image_id", "node_id", "decision", "best_child", "level", "phase"]).astype({"best_child": "float64"})

    return run


def decisions(events: DataFrame, floor: float = 0.5, late: str = "1 minute", patience_ms: int = 60_000) -> DataFrame:
    """One row a region, see above. A child is worth pursuing if it beats its parent; of several the best must, and then
    those that reach ``floor`` are as well. ``late`` is the watermark's delay."""
    ship(events.sparkSession)
    own = events.filter("image_id IS NOT NULL AND node_id IS NOT NULL").withWatermark("ts", late)
    # a region takes part in its own family, if that has other members or it is a root, and in its parent's
    roles = F.array(F.when((F.col("n_children") > 0) | F.col("parent_id").isNull(), F.col("node_id")), F.col("parent_id"))
    parts = own.select("image_id", "node_id", "reid_score", "n_children", "depth", "ts", F.unix_millis("ts").alias("ms"), F.explode(F.array_compact(roles)).alias("family"))
    shares = parts.withColumn("share", F.pmod(F.xxhash64("family"), F.lit(SHARES)))
    return shares.groupBy("image_id", "share").applyInPandasWithState(_step(floor, patience_ms), FINAL, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs ``stream`` over all that has come so far, into a file sink under ``folder``, and reads what is there. A second run
    goes on from the first one's checkpoint: each row is written once, whatever was lost between."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by kind and tumbling window, with a watermark: ``ts`` may be without a time zone."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
