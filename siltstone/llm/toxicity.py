"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts shared subsequences of three characters that lie within five
(``GAPS`` more than three), each weighted by ``DECAY`` for every character it skips,
normalised to 1 for equal words. It tolerates characters left out of or put into
a word; a run of single letters ("i d i o t") is read as one word too. A sentence's
kernel with a landmark is the largest over its words, taken up two ramps (one of ``RAMPS``):
one tells words that are alike, broken insults among them, the other those that are
nearly equal. Landmarks are the words of labelled texts that best tell toxic ones
from others; the kernel among them whitens the features of either ramp (Nyström) on
which a linear SVM is trained. A text's margin is the largest of its sentences'
(a sentence without words like a landmark is always taken to be there), and a
logistic curve over it gives the score.

Labels mark whole documents. So all sentences of documents that are not toxic are
clean examples, and of a toxic document the sentence with the largest margin is the
toxic example, chosen anew ``CHOICES`` times. ``COPIES`` sentences of one landmark are
toxic examples too, most of them broken by a character put in, doubled or left out. The machine is fitted on
at most ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` other labelled rows of at most
``FIT_CHARS`` characters, in the order of a hash of their id; scoring covers every word
of every text.

Defined results: a null or empty text has no words and gets the score of none; of
rows that repeat a labelled id, any toxic one counts; null labels are left out;
without labels of both kinds every score is the share of toxic ones (0 of none);
a null id counts as the empty string for the held-out fold.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

GAPS, DECAY = 2, 0.5
#: Kernels at which a word begins to count as alike, and counts in full; and as nearly equal. Which of these is used is found by
#: cross-validation over the rows that are learned from: the one that finds most while it calls at most ``FALSE`` more of the clean texts toxic
#: than the narrowest does (which labels that are wrong make it do).
Ramps = tuple[tuple[float, float], tuple[float, float]]
RAMPS: tuple[Ramps, ...] = (((0.5, 0.6), (0.7, 1.0)), ((0.52, 0.65), (0.7, 1.0)), ((0.55, 0.65), (0.7, 1.0)), ((0.7, 0.85), (0.8, 1.0)))
FOLDS, FALSE = 3, 0.002
FLOOR = min(r[0][0] for r in RAMPS)
LANDMARKS, FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 128, 2000, 4000, 200_000
COPIES, INTACT, OMITTED, CHOICES = 4000, 0.25, 0.35, 3
BREAKS = "-*._"
#: A sentence of clean documents that occurs more often counts so many times.
OFTEN = 50
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WIDTH, REMEMBER = 24, 400_000
SPACED = re.compile(r"(?<!\S)(?:\S[^\w\s]?\s+){2,}\S[^\w\s]*(?!\S)")
#: Positions of a subsequence's second and third character behind the first, and how many are skipped.
SHAPES = [(a, b, b - 2) for b in range(2, 3 + GAPS) for a in range(1, b)]
EDGE = 63


def _symbols() -> np.ndarray:
    """a-z are 1 to 26, other characters 27 to 62 by their code; no character is 0."""
    codes = np.arange(1 << 16)
    table = 27 + codes % 36
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0] = 0
    return table.astype(np.int32)


SYMBOLS = _symbols()


def words_of(text: str) -> set[str]:
    """A text's words, its runs of single letters joined among them."""
    low = text.lower()
    found = set(low.split())
    found.update("".join(m[0].split()) for m in SPACED.finditer(low))
    return found


def in_context(text: str) -> set[tuple[str, int]]:
    """A text's words, each with a hash of the words around it; of very long ones, their parts."""
    w = ["", *text.lower().split(), ""]
    out = {(p, zlib.crc32(f"{w[i - 1]} {w[i + 1]}".encode("utf-8", "surrogatepass"))) for i in range(1, len(w) - 1) for p in windows(w[i])}
    out.update((p, m.start()) for m in SPACED.finditer(text.lower()) for p in windows("".join(m[0].split())))
    return out


def windows(word: str) -> list[str]:
    """The word without punctuation around it; of a very long one, overlapping parts."""
    w = word.strip(".,;:!?\"'()[]{}<>*_-\0") or word.replace("\0", " ")
    return [w] if len(w) <= WIDTH else [w[i : i + WIDTH] for i in range(0, len(w) - WIDTH // 2, WIDTH // 2)]


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each word between two edge marks, zeros behind; and the lengths with marks."""
    codes = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
    n = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), WIDTH + 2 + SHAPES[-1][1]), np.int32)
    out[:, 1 : WIDTH + 1] = SYMBOLS[np.minimum(codes, (1 << 16) - 1)]
    out[:, 0] = EDGE
    out[np.arange(len(words)), n + 1] = EDGE
    return out, n + 2


def features(symbols: np.ndarray):
    """(index of each subsequence, weight) by shape; an index of a shape that runs over the end has a zero symbol."""
    w = WIDTH + 2
    for a, b, skipped in SHAPES:
        third = symbols[:, b : b + w]
        yield np.where(third > 0, symbols[:, :w] * 4096 + symbols[:, a : a + w] * 64 + third, 0), np.float32(DECAY**skipped)


def vector(word: str) -> dict[int, float]:
    """The word's normalised subsequence weights."""
    symbols, _ = coded([word])
    out: dict[int, float] = {}
    for index, weight in features(symbols):
        for i in index[0].tolist():
            if i:
                out[i] = out.get(i, 0.0) + float(weight)
    norm = sum(v * v for v in out.values()) ** 0.5
    return {i: v / norm for i, v in out.items()} if norm else {}


def kernel(a: str, b: str) -> float:
    x, y = vector(a), vector(b)
    return sum(v * y[i] for i, v in x.items() if i in y)


@dataclass
class Landmarks:
    """Kernels of words with all landmarks, remembered by a process."""

    words: list[str]
    seen: set = field(default_factory=set, repr=False)
    near: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        vectors = [vector(w) for w in self.words]
        rows = {i: k + 1 for k, i in enumerate(sorted({i for v in vectors for i in v}))}
        self.table = np.zeros((len(rows) + 1, len(self.words)), np.float32)
        for j, v in enumerate(vectors):
            for i, x in v.items():
                self.table[rows[i], j] = x
        self.row = np.zeros(1 << 18, np.int32)
        self.row[list(rows)] = list(rows.values())
        self.most = self.table.max(axis=1, initial=0)[self.row]
        alike = np.argsort(np.array(self.words, dtype=str), kind="stable")
        self.by_group = np.stack([self.table[:, part].max(axis=1, initial=0) for part in np.array_split(alike, 8)], axis=1)
        n = np.arange(WIDTH + 3, dtype=np.float64)
        self.norm = np.sqrt(sum(np.maximum(n - b, 0) * DECAY ** (2 * s) for _, b, s in SHAPES) + 1e-12)

    def __getstate__(self):
        return {"words": self.words}

    def __setstate__(self, state):
        self.__init__(state["words"])

    def _learn(self, words: list[str]) -> None:
        """Only words whose bound on the kernel reaches the floor are compared with
        every landmark. The bound takes each subsequence's largest weight, in any landmark and then in
        any of a group of similar ones, and the least norm that a word of its length has."""
        parts = [(w, p) for w in words for p in windows(w)]
        symbols, n = coded([p for _, p in parts])
        bound = sum(self.most[index].sum(axis=1) * weight for index, weight in features(symbols)) / self.norm[n]
        near = np.flatnonzero(bound >= FLOOR)
        bound = sum(self.by_group[self.row[index]].sum(axis=1) * weight for index, weight in features(symbols[near])) / self.norm[n[near], None]
        near = near[bound.max(axis=1) >= FLOOR]
        for at in range(0, len(near), 1024):
            block = near[at : at + 1024]
            index = np.concatenate([i for i, _ in features(symbols[block])], axis=1)
            weight = np.repeat([w for _, w in features(symbols[:1])], WIDTH + 2).astype(np.float32)
            own = sum(self.table[self.row[i]].sum(axis=1) * w for i, w in features(symbols[block]))
            # a subsequence that a word has twice counts squared: the norm is exact from here on
            order = np.argsort(index, axis=1, kind="stable")
            index, weight = np.take_along_axis(index, order, axis=1), np.where(np.take_along_axis(index, order, axis=1) > 0, weight[order], 0)
            new = np.concatenate([np.ones((len(block), 1), bool), index[:, 1:] != index[:, :-1]], axis=1).ravel()
            sums = np.add.reduceat(weight.ravel().astype(np.float64), np.flatnonzero(new)) ** 2
            norm = np.sqrt(np.bincount(np.flatnonzero(new) // index.shape[1], sums, minlength=len(block)))
            own = (own / norm[:, None]).astype(np.float32)
            own[own < FLOOR] = 0
            for k, v in zip(block[own.any(axis=1)].tolist(), own[own.any(axis=1)]):
                w = parts[k][0]
                self.near[w] = np.maximum(v, self.near.get(w, 0))

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """A text's sentences with words like a landmark, a row each: the largest kernel with each landmark.
        Near words in no sentence (letters with stops between them) are one of their own."""
        none, out = np.zeros((0, len(self.words)), np.float32), []
        if not self.words:
            return [none] * len(texts)
        for at in range(0, len(texts), 256):
            own = [words_of(t) if t else set() for t in texts[at : at + 256]]
            new = [w for w in set().union(*own) if w not in self.seen and w not in self.near]
            for k in range(0, len(new), 1 << 15):
                self._learn(new[k : k + (1 << 15)])
            for t, words in zip(texts[at : at + 256], own):
                left = words & self.near.keys()
                if not left:
                    out.append(none)
                    continue
                groups, every = [], set(left)
                for sentence in SENTENCE.split(t):
                    if hit := words_of(sentence) & every:
                        groups.append(hit)
                        left -= hit
                groups += [left] if left else []
                out.append(np.stack([np.maximum.reduce([self.near[w] for w in g]) for g in groups]))
            if len(self.seen) + len(new) > REMEMBER:
                self.seen.clear()
            self.seen.update(new)
            if len(self.near) > REMEMBER // 8:
                self.near.clear()
                self.seen.clear()
        return out


def climbed(kernels: np.ndarray, ramps: Ramps) -> np.ndarray:
    return np.concatenate([np.clip((kernels - a) / (b - a), 0, 1) for a, b in ramps], axis=-1)


def largest(sentences: list[np.ndarray], weights: np.ndarray, ramps: Ramps) -> np.ndarray:
    """Of each text's sentences the largest margin above that of a sentence without near words, 0 at least."""
    n = np.array([len(x) for x in sentences], np.int64)
    out = np.zeros(len(n))
    if n.sum():
        own = climbed(np.concatenate([x for x in sentences if len(x)]).astype(np.float64), ramps) @ weights
        full = np.flatnonzero(n)
        out[full] = np.maximum(0, np.maximum.reduceat(own, (np.cumsum(n) - n)[full]))
    return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    ramps: Ramps = RAMPS[0]

    def score(self, sentences: list[np.ndarray]) -> np.ndarray:
        margin = largest(sentences, self.weights, self.ramps) + self.bias if len(self.landmarks) else np.full(len(sentences), self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def whiten(landmarks: list[str]) -> np.ndarray:
    """K_mm^(-1/2) by its eigenvalues, small ones left out."""
    vectors = [vector(w) for w in landmarks]
    k = np.array([[sum(v * y[i] for i, v in x.items() if i in y) for y in vectors] for x in vectors])
    values, basis = np.linalg.eigh(k)
    keep = values > 1e-2
    return basis[:, keep] / np.sqrt(values[keep])


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """A linear SVM (squared hinge, full gradients with momentum); the last weight is the bias."""
    x, weight = np.hstack([x, np.ones((len(x), 1))]), weight / weight.sum()
    step = 0.5 / (np.linalg.norm(x.T @ (x * weight[:, None]), 2) + penalty)
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        ahead = w + 0.9 * speed
        slack = np.maximum(0, 1 - y * (x @ ahead))
        speed = 0.9 * speed - step * (penalty * ahead - 2 * x.T @ (weight * slack * y))
        w = w + speed
    return w


def curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve."""
    goal = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    a, b, weight = 1.0, 0.0, weight / weight.sum()
    for _ in range(1000):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        e = weight * (p - goal)
        a, b = a - 2 * float(e @ margin), b - 2 * float(e.sum())
    return a, b


def broken(word: str, rng: np.random.Generator) -> str:
    """The word with a character put in, one doubled, or one left out."""
    i = int(rng.integers(1, len(word)))
    if len(word) > 3 and rng.random() < OMITTED:
        i = int(rng.integers(1, len(word) - 1))
        return word[:i] + word[i + 1 :]
    return word[:i] + [*BREAKS, word[i]][int(rng.integers(len(BREAKS) + 1))] + word[i:]


def constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model([], np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))


def copied(landmarks: list[str], bad: list[np.ndarray], n: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Sentences of one landmark, most of them broken; a landmark is drawn as often as toxic texts hold it."""
    held = np.sum([(x > 0.999).any(axis=0) for x in bad], axis=0).astype(float) if bad else np.zeros(len(landmarks))
    if not held.any():
        return []
    drawn = [landmarks[j] for j in rng.choice(len(landmarks), n, p=held / held.sum())]
    none = np.zeros((1, len(landmarks)))
    return [x if len(x) else none for x in Landmarks(landmarks).of([w if rng.random() < INTACT else broken(w, rng) for w in drawn])]


def fitted(landmarks: list[str], sentences: list[np.ndarray], labels: np.ndarray, copies: list[np.ndarray], ramps: Ramps, penalty: float, rounds: int, choices: int) -> Model:
    none = np.zeros((1, len(landmarks)))
    bad = [x if len(x) else none for x, y in zip(sentences, labels) if y > 0]
    clean = np.concatenate([none, *[x for x, y in zip(sentences, labels) if y <= 0]])
    times = np.ones(len(clean))
    times[0] += sum(not len(x) for x, y in zip(sentences, labels) if y <= 0)
    clean, back = np.unique(np.round(clean, 3), axis=0, return_inverse=True)
    times = np.minimum(np.bincount(back.ravel(), times), OFTEN)
    more = climbed(np.concatenate(copies), ramps) if copies else np.zeros((0, len(ramps) * len(landmarks)))
    map_ = np.kron(np.eye(len(ramps)), whiten(landmarks))
    weight = np.concatenate([times, np.ones(len(bad)), np.full(len(more), len(bad) / max(1, len(more)))])
    y = np.concatenate([-np.ones(len(clean)), np.ones(len(bad) + len(more))])
    chosen = np.stack([x[np.argmax(x.max(axis=1))] for x in bad])
    for _ in range(choices):
        w = machine(np.vstack([climbed(clean, ramps), climbed(chosen, ramps), more]) @ map_, y, weight, penalty, rounds)
        own = map_ @ w[:-1]
        chosen = np.stack([x[np.argmax(climbed(x, ramps) @ own)] for x in bad])
    margin = np.concatenate([largest(sentences, own, ramps), np.maximum(0, more @ own)]) + w[-1]
    of_rows = np.concatenate([np.ones(len(labels)), np.full(len(more), len(bad) / max(1, len(more)))])
    a, b = curve(margin, np.concatenate([np.where(labels > 0, 1, -1), np.ones(len(more))]), of_rows)
    return Model(landmarks, own, float(w[-1]), a, b, ramps)


def best_ramps(landmarks: list[str], sentences: list[np.ndarray], labels: np.ndarray, copies: list[np.ndarray], penalty: float) -> Ramps:
    """By cross-validation over the labelled rows (folds by their kernels, so that copies of a text are in one) and the copies: of the
    ramps that call at most ``FALSE`` more of clean rows toxic than the last does, that which misses least."""
    fold = np.array([zlib.crc32(np.ascontiguousarray(x).tobytes()) % FOLDS if len(x) else k % FOLDS for k, x in enumerate(sentences)])
    found = []
    for ramps in RAMPS:
        false = missed = 0
        for f in range(FOLDS):
            rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not 0 < labels[rest].mean() < 1:
                continue
            model = fitted(landmarks, [sentences[i] for i in rest], labels[rest], [c for k, c in enumerate(copies) if k % FOLDS != f], ramps, penalty, 300, 1)
            called = model.score([sentences[i] for i in own]) >= 0.5
            false += int((called & (labels[own] <= 0)).sum())
            some = copies[f::FOLDS]
            missed += int((~called & (labels[own] > 0)).sum()) + (float((model.score(some) < 0.5).mean()) * (labels > 0).sum() / FOLDS if some else 0)
        found.append((false / max(1, (labels <= 0).sum()), missed))
    allowed = [(missed, k) for k, (false, missed) in enumerate(found) if false <= found[-1][0] + FALSE]
    return RAMPS[min(allowed)[1]]


def train(landmarks: list[str], sentences: list[np.ndarray], labels: np.ndarray, penalty: float = 1e-4, rounds: int = 1500) -> Model:
    """From each labelled text's sentences (kernels with the landmarks, a row each)."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not landmarks or share in (0.0, 1.0):
        return constant(share)
    rng = np.random.default_rng(1)
    copies = copied(landmarks, [x for x, y in zip(sentences, labels) if y > 0 and len(x)], COPIES, rng)
    ramps = best_ramps(landmarks, sentences, labels, copies, penalty)
    return fitted(landmarks, sentences, labels, copies, ramps, penalty, rounds, CHOICES)


def labelled(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """text, toxic of the bounded choice of labelled rows for which ``training`` (over doc_id) holds."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.filter("toxic = 1").orderBy(*order).limit(FIT_TOXIC).unionByName(marks.filter("toxic = 0").orderBy(*order).limit(FIT_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= FIT_CHARS)
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, training: Column, landmarks: int = LANDMARKS) -> Model:
    rows = shared.staged(labelled(docs, labels, training), "toxic-labelled")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return constant(float(bad > 0))

    def contexts(batches):
        for b in batches:
            seen = {(w, c, y) for t, y in zip(b["text"], b["toxic"]) for w, c in in_context(t)}
            yield {"word": [x[0] for x in seen], "context": [x[1] for x in seen], "toxic": [x[2] for x in seen]}

    # copies of a text repeat a word in one context, which counts once
    told = shared.map_columns(rows, contexts, "word string, context long, toxic int").distinct()
    words = shared.staged(told.groupBy("word").agg(F.count_if(F.col("toxic") == 0).alias("good"), F.count_if(F.col("toxic") == 1).alias("bad")), "toxic-words")
    total = words.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("words")).first()
    share = (total.bad or 0) / max(1, (total.bad or 0) + (total.good or 0))
    if not 0 < share < 1:
        return constant(bad / (bad + good))
    # what the best of so many words reaches by chance
    certain = 2 * math.log(max(2, total.words))
    n = F.col("bad") + F.col("good")
    gain = 2 * (F.col("bad") * F.log(F.col("bad") / (n * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0))
    best = words.filter((F.col("bad") > n * (1 + share) / 2) & (F.length("word") > 1)).withColumn("gain", gain).filter(F.col("gain") >= certain).orderBy(F.desc("gain"), "word").limit(landmarks)
    chosen = [r.word for r in best.collect()]

    def kernels(batches):
        marks = Landmarks(chosen)
        for b in batches:
            yield {"k": [x.astype(np.float16).tobytes() for x in marks.of(b["text"])], "toxic": b["toxic"]}

    got = shared.map_columns(rows, kernels, "k binary, toxic int").toPandas()
    sentences = [np.frombuffer(x, np.float16).reshape(-1, max(1, len(chosen))).astype(np.float64) for x in got["k"]]
    return train(chosen, sentences, got["toxic"].to_numpy(dtype=np.float64))


@functools.lru_cache(maxsize=2)
def _landmarks(words: tuple[str, ...]) -> Landmarks:
    return Landmarks(list(words))


shared.remembers(_landmarks.cache_clear, "toxicity")


def scorer(model: Model):
    """A column function: the score of a text column."""

    @F.pandas_udf("double")
    def toxic_score(texts: pd.Series) -> pd.Series:
        shared.begin("toxicity")
        return pd.Series(model.score(_landmarks(tuple(model.landmarks)).of(texts.tolist())), dtype="float64")

    return toxic_score


def fold(m: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % m


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    scored = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with their columns."""
    return docs.filter(scorer(model)(F.col("text")) < 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    model = fit(docs, shared.table(spark, sf_dir, "labels"), fold(5) != 0)
    return score_documents(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")
