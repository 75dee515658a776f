"""Ranked lexical search: every item of a query set against all documents, by sort-based accumulation.

Two passes. The first reads whole texts once and keeps, of each document, its length in terms and the terms that the
items have, with their occurrences (``postings``); corpus statistics are sums over that. In the second, a task takes
a range of documents: it concatenates the (item, document, impact) entries of all matches, sorts their packed keys by radix,
sums equal ones with reduceat, and selects the best of each item with a heap that it carries from range to range. What tasks
have selected is dealt by ranges of items and merged by heaps again. A document's score is whole within its task, so
nothing is added across tasks, and tasks give out ``k`` rows an item at most.

A term's impacts are integers, so sums are exact and in any order. Items are a stated query set and come in blocks of at most
``BLOCK_CHARS`` characters (one scan of the documents a block); only a block's terms are sent to tasks.

Defined results: a null or termless document is none of the N and never ranked; a null or termless item has no rows; rows
with equal doc_id are documents of their own, rows with equal item_id items of their own; equal scores are by ascending
doc_id, a null one last; an empty table on either side gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BLOCK_CHARS = 8_000_000
POSTINGS = "doc_id long, n int, terms array<int>, tf array<int>"
FOUND = "item int, doc_id long, score long"
#: Entries that are sorted at once.
ENTRIES = 4_000_000
#: Bytes to terms: letters A-Z lower, other letters, digits and all of a character beyond ASCII kept, the rest blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """A block of items: their terms numbered, and for each term the items that hold it with how often."""

    def __init__(self, texts: list[str | None]):
        held = [Counter(terms(t)) if t else Counter() for t in texts]
        self.number = {t: i for i, t in enumerate(sorted(set().union(*held)))}
        pairs = sorted((self.number[t], q, k) for q, c in enumerate(held) for t, k in c.items())
        self.items = np.array([q for _, q, _ in pairs], np.int64)
        self.times = np.array([k for _, _, k in pairs], np.int64)
        self.starts = np.searchsorted(np.array([t for t, _, _ in pairs], np.int64), np.arange(len(self.number) + 1))
        self.n = len(texts)


def postings(docs: DataFrame, number: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of those in ``number``, rising), tf; documents without a term are left out."""

    def run(batches):
        find = number.get
        for b in batches:
            out = shared.rows_buffer(["doc_id", "n", "terms", "tf"])
            for k, t in zip(b["k"], b["t"]):
                own = terms(t) if t else ()
                if own:
                    c = Counter(map(find, own))
                    c.pop(None, None)
                    out.add(k, len(own), list(c), list(c.values()))
            if out:
                yield out.take()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return shared.map_columns(rows, run, POSTINGS)


def statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of each numbered term. A task adds up its own frequencies, so a row a term and task is summed, no row a posting."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            for t in b["terms"]:
                df[t] += 1
        live = np.flatnonzero(df)
        yield {"term": live, "df": df[live]}

    whole = found.agg(F.count("*").alias("n"), F.sum(F.col("n").cast("long")).alias("l")).first()
    df = np.zeros(n_terms, np.int64)
    for r in shared.map_columns(found.select("terms"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
        df[r.term] = r.df
    return whole.n, whole.l or 0, df


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The order that sorts ``keys`` (0 to ``most``): least significant 16 bits first, which NumPy sorts by counting."""
    order, shift = None, 0
    while shift == 0 or most >> shift:
        digit = ((keys if order is None else keys[order]) >> shift & 0xFFFF).astype(np.uint16)
        step = np.argsort(digit, kind="stable")
        order = step if order is None else order[step]
        shift += 16
    return order


def accumulate(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, items: Items, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, document and score of all (item, document) that share a term; ``doc`` counts from 0. Sorted by item, then document."""
    width = items.starts[term + 1] - items.starts[term]
    at = np.repeat(items.starts[term] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
    keys = items.items[at] * n_docs + np.repeat(doc, width)
    values = np.repeat(impact, width) * items.times[at]
    if not len(keys):
        return keys, keys, values
    order = radix_order(keys, items.n * n_docs)
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    keys = keys[starts]
    return keys // n_docs, keys % n_docs, np.add.reduceat(values, starts)


class Best:
    """The k best of each item so far: heaps whose least is the one to go. Entries are (score, doc_id turned round), a null doc_id last."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def add(self, item: int, score: int, doc: int | None) -> None:
        heap = self.heaps.setdefault(item, [])
        entry = score, doc is not None, 0 if doc is None else -doc
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def least(self, item: int) -> int:
        """A score below which nothing is let in."""
        heap = self.heaps.get(item, ())
        return heap[0][0] if len(heap) == self.k else 1

    def take(self, item: np.ndarray, score: np.ndarray, docs: list) -> None:
        """Scores of many items, sorted by item; ``docs`` are their doc_ids. Those below an item's k-th largest here are not looked at."""
        cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True]) if len(item) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            q, own = int(item[lo]), score[lo:hi]
            floor = self.least(q)
            if hi - lo > self.k:
                floor = max(floor, int(np.partition(own, hi - lo - self.k)[hi - lo - self.k]))
            for i in np.flatnonzero(own >= floor).tolist():
                self.add(q, int(own[i]), docs[lo + i])

    def rows(self) -> dict[str, list]:
        flat = [(q, -d if live else None, s) for q, h in sorted(self.heaps.items()) for s, live, d in sorted(h, reverse=True)]
        return dict(zip(("item", "doc_id", "score"), map(list, zip(*flat)))) if flat else {"item": [], "doc_id": [], "score": []}


def best_of_ranges(found: DataFrame, items: Items, n_docs: int, n_terms: int, df: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each item among the documents of each task."""
    w = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)

    def run(batches):
        best = Best(k)
        for b in batches:
            sizes = np.fromiter(map(len, b["terms"]), np.int64, len(b["terms"]))
            term = np.fromiter((t for x in b["terms"] for t in x), np.int64, int(sizes.sum()))
            tf = np.fromiter((t for x in b["tf"] for t in x), np.int64, len(term))
            m = 25 + (75 * np.array(b["n"], np.int64) * n_docs) // max(n_terms, 1)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            width = np.cumsum(items.starts[term + 1] - items.starts[term])
            ends, at, ids = np.cumsum(sizes), 0, np.array(b["doc_id"], object)
            while at < len(sizes):  # whole documents, of about ENTRIES entries together
                first = int(ends[at - 1]) if at else 0
                reach = (int(width[first - 1]) if first else 0) + ENTRIES
                to = max(at + 1, int(np.searchsorted(ends, int(np.searchsorted(width, reach)), "right")))
                cut = slice(first, int(ends[to - 1]))
                q, d, s = accumulate(term[cut], doc[cut] - at, impact[cut], items, to - at)
                best.take(q, s, ids[d + at])
                at = to
        yield best.rows()

    return shared.map_columns(found, run, FOUND)


def merged(found: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score: the k best of each item over all tasks. Items are dealt by ranges; an item has k rows a task."""

    def run(batches):
        best = Best(k)
        for b in batches:
            for q, d, s in zip(b["item"], b["doc_id"], b["score"]):
                best.add(q, s, d)
        rows = best.rows()
        item = np.array(rows["item"], np.int64)
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)])) + 1
        yield rows | {"rank": rank.astype(np.int32)}

    return shared.map_columns(found.repartitionByRange("item"), run, "item int, rank int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_key: str = "item_id", item_text: str = "text", key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents of the highest scores above 0."""
    spark = docs.sparkSession
    rows = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).filter("t IS NOT NULL")
    out, block, chars = [], [], 0
    for r in rows.orderBy("id", "t").toLocalIterator():
        block.append(r)
        chars += len(r.t)
        if chars >= block_chars:
            out.append(_block(docs, block, k, key, text))
            block, chars = [], 0
    if block:
        out.append(_block(docs, block, k, key, text))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _block(docs: DataFrame, block: list, k: int, key: str, text: str) -> DataFrame:
    spark, own = docs.sparkSession, Items([r.t for r in block])
    found = shared.staged(postings(docs, own.number, key, text), "postings")
    n_docs, n_terms, df = statistics(found, len(own.number))
    best = shared.staged(best_of_ranges(found, own, n_docs, n_terms, df, k), "ranked")
    names = spark.createDataFrame([(q, r.id) for q, r in enumerate(block)], "item int, item_id long")
    return merged(best, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
n AS (SELECT doc_id, len(t) AS n, t FROM d WHERE len(t) > 0), c AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM n),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL), v AS (SELECT DISTINCT term FROM q),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM n) JOIN v USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, nd),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // l)))))::BIGINT AS score FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, k::INT AS rank, doc_id, score FROM r WHERE k <= 10"""
