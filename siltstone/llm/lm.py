"""Language-model scoring by a hashed maximum-entropy model.

Words fall into 256 classes, 16 groups of 16: the ``OWN`` most frequent words have a
class each, all others one of 64 by a hash of their last two bytes. The model
gives P(group | history) and P(class | group, history), two softmaxes of 16 over
hashed features of the history: the word before (n-gram), the two words before
(n-gram) and the word before that (skip), each with its own table of weights; the
biases are the classes' counts.
Within a class, a word has its share of the class's training tokens, and the
share that Good and Turing give to unseen words is left for one unknown word. The
events are those of the base score, the known words and an unknown one.

Training: each shard of the training documents takes stochastic gradient steps
from the same weights, and rows of weights are averaged over shards by how often
they were updated; ``ROUNDS`` rounds, each over its own part of the documents, so
every training token is used once. Scoring is a forward pass in NumPy batches.

Counts cover all training tokens. The most frequent words, ``KNOWN`` at most, travel
with the model; what else a document holds is joined to the counts in the engine, row
by row, so the vocabulary is never gathered. In the engine a word is known by 128 bits
(58 of a first and 64 of a second hash, and 6 that are its class); the first 64 find it
among the words that travel.

The tables of weights have 2^``LEAST_BITS`` rows a feature, and more where the training
tokens hold more distinct words, up to 2^``MOST_BITS`` (100 MB of weights in a process).

Defined results: a null or empty text is its end token alone; null ids count as
the empty string for the fold; repeated rows are scored each; an empty training
part leaves every word unknown; an empty table gives no rows; columns of the input that
are called like a result are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

OWN, KNOWN, SUFFIXES = 192, 65_536, 64
GROUP = 16
LEAST_BITS, MOST_BITS = 15, 18
#: Distinct words up to which the least tables serve.
WORDS = 1 << 24
#: Weights of so many shards are averaged together.
FAN = 64
ROUNDS, RATE, MOST = 2, 0.1, 20.0
BATCH = 8192
REMEMBER, GATHERED = 600_000, 500_000
CHUNK = 4096
RESULTS = ("n_tokens", "n_known", "base_score", "score")
ONES = np.ones(GROUP, np.float32)
END, BEGIN = (-1 << 6), (-2 << 6)
#: Stands for a text's end; no word holds white space.
NO_WORD = b" "
SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def ids_of(words: list[bytes]) -> np.ndarray:
    """58 bits of XXH64, then 6 of the last two bytes, of each word; END for NO_WORD."""
    x = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64) & ~np.uint64(SUFFIXES - 1)
    x |= np.array(list(map(zlib.crc32, [w[-2:] for w in words])), np.uint64) % np.uint64(SUFFIXES)
    return np.array([END if w == NO_WORD else i for w, i in zip(words, x.view(np.int64).tolist())], np.int64) if NO_WORD in words else x.view(np.int64)


class Ids(dict):
    """Word to id, remembered."""

    def __missing__(self, w: bytes) -> int:
        x = (xxhash.xxh64_intdigest(w) & ~(SUFFIXES - 1)) | (zlib.crc32(w[-2:]) % SUFFIXES)
        x = x - (1 << 64) if x >> 63 else x
        if len(self) < REMEMBER:
            self[w] = x
        return x


IDS = Ids()
shared.remembers(IDS.clear, "lm")


def second_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64).view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def counts(docs: DataFrame, training: Column) -> DataFrame:
    """(id, other, c) of every token of the training documents: its hashes and count."""

    def run(batches):
        seen: Counter = Counter()
        docs_ = 0

        def out():
            words = [NO_WORD, *seen]
            return {"id": ids_of(words), "other": second_hashes(words), "c": [docs_, *seen.values()]}

        for b in batches:
            for t in b["text"]:
                seen.update(words_of(t))
                docs_ += 1
                if len(seen) >= GATHERED:
                    yield out()
                    seen.clear()
                    docs_ = 0
        if docs_:
            yield out()

    return shared.map_columns(docs.filter(training).select("text"), run, "id long, other long, c long").groupBy("id", "other").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words, by falling count, and what is known of all words."""

    ids: np.ndarray
    c: np.ndarray
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_once: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.ids)
        self.sorted, self.rank = self.ids[order], order
        slots = self.ids.view(np.uint64) >> np.uint64(44)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[slots] = np.arange(len(slots))
        many = np.bincount(slots.astype(np.int64), minlength=1 << 20) > 1
        self.slot[many] = -2
        total = np.maximum(self.class_tokens, 1)
        unseen = np.clip(self.class_once / total, 0.5 / (self.class_tokens + 1), 0.5)
        self.unseen = np.where(self.class_tokens > 0, unseen, 1.0)
        self.share = (1 - self.unseen) / total

    def __getstate__(self):
        return [self.ids, self.c, self.tokens, self.distinct, self.class_tokens, self.class_once]

    @property
    def bits(self) -> int:
        """Of a row of the weights' tables: one more where there are four times as many words."""
        return int(min(MOST_BITS, max(LEAST_BITS, LEAST_BITS + np.ceil(np.log2(max(1, self.distinct) / WORDS) / 2))))

    def __setstate__(self, state):
        self.__init__(*state)

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        """Rank of each id, or -1."""
        if not len(self.ids):
            return np.full(len(ids), -1, np.int64)
        r = self.slot[ids.view(np.uint64) >> np.uint64(44)].astype(np.int64)
        found = (r >= 0) & (self.ids[np.maximum(r, 0)] == ids)
        out = np.where(found, r, -1)
        for k in (np.flatnonzero(r == -2),):
            at = np.minimum(np.searchsorted(self.sorted, ids[k]), len(self.ids) - 1)
            out[k] = np.where(self.sorted[at] == ids[k], self.rank[at], -1)
        return out

    def base(self, c):
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def vocabulary(table: DataFrame) -> Vocabulary:
    size = F.floor(F.log2("c") * 16)
    sizes = sorted(((r.size, r.n) for r in table.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True)  # a few hundred
    least, n = None, 0
    for own_size, words in sizes:
        n += words
        if n > KNOWN:
            break
        least = own_size
    top = table.filter(size >= least).toPandas() if least is not None else table.limit(0).toPandas()
    order = np.lexsort((top["id"].to_numpy(np.int64), -top["c"].to_numpy(np.int64)))
    ids, c = top["id"].to_numpy(np.int64)[order], top["c"].to_numpy(np.int64)[order]
    own = ids[:OWN]
    per = table.groupBy(F.col("id").bitwiseAND(F.lit(SUFFIXES - 1)).alias("k")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once"), F.count("*").alias("words")).toPandas()
    n, once = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    n[per["k"].to_numpy(np.int64)], once[per["k"].to_numpy(np.int64)] = per["n"], per["once"]
    tokens, distinct = int(per["n"].sum()), int(per["words"].sum())
    np.subtract.at(n, own & (SUFFIXES - 1), c[:OWN])
    np.subtract.at(once, own & (SUFFIXES - 1), (c[:OWN] == 1).astype(float))
    return Vocabulary(ids, c, tokens, distinct, n, once)


def fold(x: np.ndarray, salt: int) -> np.ndarray:
    return (x * SALTS[salt]) ^ ((x * SALTS[salt]) >> np.uint64(29))


class Model:
    """Weights, as (3 features, rows, GROUP) for groups and for classes, and fixed biases."""

    def __init__(self, groups: np.ndarray | None = None, classes: np.ndarray | None = None, bias: np.ndarray | None = None, bits: int = LEAST_BITS):
        self.bits = bits if groups is None else int(groups.shape[1]).bit_length() - 1
        shape = (3, 1 << self.bits, GROUP)
        self.groups = np.zeros(shape, np.float32) if groups is None else groups
        self.classes = np.zeros(shape, np.float32) if classes is None else classes
        self.bias = np.zeros((GROUP + 1, GROUP), np.float32) if bias is None else bias
        self.seen = np.zeros((2, 3, 1 << self.bits), np.float32)

    @classmethod
    def untrained(cls, vocab: "Vocabulary") -> "Model":
        """Biases from the classes' counts: the model that has no history."""
        n = np.zeros(GROUP * GROUP)
        own = vocab.c[:OWN]
        n[: len(own)] = own
        n[OWN:] = vocab.class_tokens
        n = (n + 0.5).reshape(GROUP, GROUP)
        bias = np.vstack([np.log(n / n.sum(axis=1, keepdims=True)), np.log(n.sum(axis=1) / n.sum())[None]])
        return cls(bias=bias.astype(np.float32), bits=vocab.bits)

    def features(self, before: np.ndarray, second: np.ndarray, group: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of the group tables and of the class tables, by feature."""
        a, b = before.view(np.uint64), second.view(np.uint64)
        full = [fold(a, 0), fold(fold(b, 1) + a, 2), fold(b, 3)]
        shift = np.uint64(64 - self.bits)
        more = group.astype(np.uint64) * SALTS[1]
        return [(f >> shift).astype(np.intp) for f in full], [(fold(f + more, 2) >> shift).astype(np.intp) for f in full]

    @staticmethod
    def _softmax(tables: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
        z = tables[0].take(rows[0], axis=0)
        z += tables[1].take(rows[1], axis=0)
        z += tables[2].take(rows[2], axis=0)
        z += bias
        np.exp(z, out=z)  # weights are kept within MOST, so this stays finite
        z *= (1 / (z @ ONES))[:, None]
        return z

    def log10(self, before: np.ndarray, second: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(class | history) of each token."""
        group, at = cls // GROUP, np.arange(len(cls))
        gi, ci = self.features(before, second, group)
        p = self._softmax(self.groups, gi, self.bias[GROUP])[at, group]
        q = self._softmax(self.classes, ci, self.bias[group])[at, cls % GROUP]
        return np.log10(np.maximum(p.astype(np.float64) * q, 1e-300))

    def learn(self, before: np.ndarray, second: np.ndarray, cls: np.ndarray) -> None:
        group, at = cls // GROUP, np.arange(len(cls))
        gi, ci = self.features(before, second, group)
        g = self._softmax(self.groups, gi, self.bias[GROUP])
        g[at, group] -= 1
        c = self._softmax(self.classes, ci, self.bias[group])
        c[at, cls % GROUP] -= 1
        for k in range(3):
            self._step(0, k, gi[k], g)
            self._step(1, k, ci[k], c)

    def _step(self, which: int, k: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """Each row moves by its gradients' sum over the root of their number."""
        order = np.argsort(rows.astype(np.uint16) if self.bits <= 16 else rows, kind="stable")
        rows = rows.take(order)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        n = np.diff(np.append(first, len(rows))).astype(np.float32)
        rows = rows.take(first)
        table = (self.groups, self.classes)[which][k]
        moved = np.add.reduceat(grad.take(order, axis=0), first, axis=0)
        moved *= (-RATE / np.sqrt(n))[:, None]
        moved += table.take(rows, axis=0)
        table[rows] = np.clip(moved, -MOST, MOST, out=moved)
        self.seen[which, k, rows] += n


def histories(texts: list[str | None], vocab: Vocabulary, flat: list[bytes] | None = None):
    """For the tokens of all texts: document, id, rank, class, the two ids before; the words are added to ``flat``."""
    ids, length = [], []
    get = IDS.__getitem__
    for t in texts:
        w = words_of(t)
        ids += map(get, w)
        ids.append(END)
        length.append(len(w) + 1)
        if flat is not None:
            flat += w
            flat.append(NO_WORD)
    ids, n = np.array(ids, np.int64), np.array(length)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    before, second = np.empty_like(ids), np.empty_like(ids)
    before[1:], second[2:] = ids[:-1], ids[:-2]
    before[first] = second[first] = BEGIN
    second[np.minimum(first + 1, len(ids) - 1)] = BEGIN
    rank = vocab.ranks(ids)
    cls = np.where((rank >= 0) & (rank < OWN), rank, OWN + (ids & (SUFFIXES - 1)))
    return doc, ids, rank, cls, before, second


def groups_of(batches, name: str = "text", size: int = 1 << 18):
    """Rows of the batches in groups of about ``size`` characters of text."""
    for b in batches:
        at, n = 0, 0
        for i, t in enumerate(b[name]):
            n += len(t or "")
            if n >= size:
                yield {k: v[at : i + 1] for k, v in b.items()}
                at, n = i + 1, 0
        if at < len(b[name]):
            yield {k: v[at:] for k, v in b.items()}


def train(docs: DataFrame, training: Column, key: str, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    model = Model.untrained(vocab)
    # larger tables, fewer shards: what they send stays in proportion to the input
    parts = max(1, docs.rdd.getNumPartitions() // (2 << (vocab.bits - LEAST_BITS)))
    for r in range(rounds):
        model = _round(docs.filter(training & (F.pmod(F.xxhash64(key, "text"), F.lit(rounds)) == r)).select("text").coalesce(parts), vocab, model, parts)
    return model


def _round(docs: DataFrame, vocab: Vocabulary, start: Model, parts: int) -> Model:
    weights, rows = (start.groups, start.classes, start.bias), 1 << start.bits

    def run(batches):
        m = Model(*(x.copy() for x in weights))
        any_ = False
        for b in groups_of(batches):
            _, _, _, cls, before, second = histories(b["text"], vocab)
            for at in range(0, len(cls), BATCH):
                x = slice(at, at + BATCH)
                m.learn(before[x], second[x], cls[x])
            any_ = True
        if any_:
            shard = TaskContext.get().partitionId()
            for which, table in enumerate((m.groups, m.classes)):
                for k in range(3):
                    for at in range(0, rows, CHUNK):
                        yield _row((which * 3 + k) * (rows // CHUNK) + at // CHUNK, shard, table[k, at : at + CHUNK], m.seen[which, k, at : at + CHUNK])

    ddl = "chunk int, salt int, w binary, n binary"
    sent = shared.map_columns(docs, run, ddl)
    while parts > 1:  # at most FAN shards, or averages of them, meet in a task
        parts = -(-parts // FAN)
        sent = sent.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int")).groupBy("chunk", "salt").applyInPandas(_averaged, ddl)
    for r in sent.toLocalIterator():
        w = np.frombuffer(r.w, np.float16).astype(np.float32).reshape(-1, GROUP)
        table, at = divmod(r.chunk, rows // CHUNK)
        own = start.groups if table < 3 else start.classes
        live = np.frombuffer(r.n, np.float32) > 0
        own[table % 3, at * CHUNK : (at + 1) * CHUNK][live] = w[live]
    return start


def _row(chunk: int, shard: int, w: np.ndarray, n: np.ndarray) -> dict:
    return {"chunk": [chunk], "salt": [shard], "w": [w.astype(np.float16).tobytes()], "n": [n.astype(np.float32).tobytes()]}


def _averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of weights, averaged over shards by how often each was updated."""
    total = n = None
    for w, k in zip(rows["w"], rows["n"]):
        k = np.frombuffer(k, np.float32).astype(np.float64)
        w = np.frombuffer(w, np.float16).astype(np.float64).reshape(len(k), GROUP) * k[:, None]
        total, n = (w, k) if total is None else (total + w, n + k)
    mean = total / np.maximum(n, 1)[:, None]
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "salt": [rows["salt"].iloc[0]], "w": [mean.astype(np.float16).tobytes()], "n": [n.astype(np.float32).tobytes()]})


def score(docs: DataFrame, key: str, table: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """Per row: its columns but ``text``, n_tokens, n_known, base_score, score."""
    keep = [c for c in docs.columns if c not in ("text", *RESULTS)]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], "text")
    own = docs.columns[:-1]
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    weights = (model.groups, model.classes, model.bias)

    def run(batches):
        m = Model(*weights)
        for b in groups_of(batches):
            flat: list[bytes] = []
            doc, ids, rank, cls, before, second = histories(b["text"], vocab, flat)
            logs = np.concatenate([m.log10(before[at : at + BATCH], second[at : at + BATCH], cls[at : at + BATCH]) for at in range(0, len(cls), BATCH)])
            known = rank >= 0
            c = vocab.c[rank[known]] if known.any() else np.zeros(0)
            k = cls[known] - OWN
            logs[known] += np.where(k < 0, 0.0, np.log10(np.maximum(vocab.share[np.maximum(k, 0)] * c, 1e-300)))
            n = len(b["text"])
            base = np.bincount(doc[known], vocab.base(c), minlength=n)
            rest = np.flatnonzero(~known)
            cut = np.searchsorted(doc[rest], np.arange(1, n))
            other = second_hashes([flat[i] for i in rest.tolist()])
            yield {x: b[x] for x in own} | {
                "n_tokens": np.bincount(doc, minlength=n), "known": np.bincount(doc[known], minlength=n), "base": base,
                "model": np.bincount(doc, logs, minlength=n), "rest": np.split(ids[rest], cut), "others": np.split(other, cut),
            }

    first = shared.map_columns(docs, run, f"{kinds}n_tokens long, known long, base double, model double, rest array<long>, others array<long>")
    first = shared.staged(first.withColumn("row", F.monotonically_increasing_id()), "lm-first")
    suffix = F.col("id").bitwiseAND(F.lit(SUFFIXES - 1)).cast("int") + 1
    c = F.coalesce("c", F.lit(0))
    within = F.when(c > 0, F.log10(F.element_at(F.lit(vocab.share.tolist()), suffix) * c)).otherwise(F.log10(F.element_at(F.lit(vocab.unseen.tolist()), suffix)))
    base = F.log10((c + 0.5) / F.lit(vocab.tokens + 0.5 * (vocab.distinct + 1)))
    tokens = first.select("row", F.explode(F.arrays_zip("rest", "others")).alias("t")).select("row", F.col("t.rest").alias("id"), F.col("t.others").alias("other"))
    sums = tokens.join(table, ["id", "other"], "left").select("row", (c > 0).cast("long").alias("k"), base.alias("b"), within.alias("w")).groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("w").alias("w"))
    joined = first.drop("rest", "others").join(sums, "row", "left")
    added = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    results = [F.col("n_tokens"), added("known", "k", 0), added("base", "b", 0.0), added("model", "w", 0.0)]
    return joined.select(*[F.col(x).alias(name) for x, name in zip(own, keep)], *[r.alias(name) for r, name in zip(results, RESULTS)])


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    docs = shared.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = shared.staged(counts(docs, remainder != 1), "lm-counts")
    vocab = vocabulary(table)
    model = train(docs, remainder != 1, "doc_id", vocab)
    scored = score(docs.withColumn("held_out", remainder == 1), "doc_id", table, vocab, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
