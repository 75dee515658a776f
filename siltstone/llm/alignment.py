"""Two tokenizers' tokens aligned by bytes, and how often ids end together over the corpus.

A text is encoded by a byte-level BPE (A, of a blank and the text) and by a piece model (B, of the text, before which it
puts the blank itself). Where a token of both ends at the same byte, a group ends, and the two tokens are linked. A pair of
ids is one packed integer, ``a << 32 | b``. Partitions count their pairs with np.unique; partial counts are sorted by
range over all partitions and summed by run lengths into count shards, which are written to the shared folder; a
task maps them into memory and looks its pairs up by searchsorted. No pair meets another one in a join.

Encoding is done once: what it gives is staged. Texts are cut before runs of blanks and line feeds, where tokens of both
models end (a byte-level pre-token begins there, and no piece of the model has such a character behind another: checked
when the model is loaded), so a process remembers what a piece between them gives. Texts with other white space, or
with a piece that one model does not give back byte for byte, are encoded whole.

Defined results: a null or empty text, and one whose joined bytes of A or B differ from a blank and the text, has no tokens
(zeros, '' as digest); special tokens' strings are plain text; null and repeated doc_ids keep their rows; an empty table
gives no rows. The count shards hold all pairs of all documents.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import PIECE, Encoder, _even, _odd_space, byte_of_char, default_tokenizer

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
SHARD = "path string, n long, first long, last long, b array<int>, most array<long>"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
LOW = np.int64(0xFFFFFFFF)
#: Pieces that a process remembers, characters of documents that are encoded together, distinct pairs that a partition holds
#: before it gives them out as partial counts, and partial counts a shard. All of them bound memory, none the result.
REMEMBER, GROUP, PARTIAL, SHARD_ROWS = 250_000, 1_000_000, 1_000_000, 4_000_000


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cut_groups(a: list[int], b: list[int], len_a: list[int], len_b: list[int]) -> tuple[str, list[int]]:
    """The groups of two lists of ids that spell the same bytes, as text, and the linked pairs, packed."""
    out, links = [], []
    i = j = i0 = j0 = at_a = at_b = 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a += len_a[a[i]]
            i += 1
        else:
            at_b += len_b[b[j]]
            j += 1
        if at_a == at_b:
            out.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
            links.append(a[i - 1] << 32 | b[j - 1])
            i0, j0 = i, j
    return ";".join(out), links


class Aligner:
    """``aligned(texts)`` gives (n_a, n_b, n_groups, groups as text, links as bytes) of each, or None where it has no tokens."""

    def __init__(self, path_a: str, path_b: str, remember: int = REMEMBER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor

        self.encoder = Encoder(path_a, 0, control=False)  # special tokens' strings are plain text
        self.a = self.encoder.tokenizer
        chars = byte_of_char()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes([chars[c] for c in token]) if all(c in chars for c in token) else token.encode()
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.blank = self.b.piece_to_id("▁")
        live = [p for i, p in enumerate(pieces) if not self.b.is_control(i)]
        added = [t.content for t in self.a.get_added_tokens_decoder().values() if not t.special]
        #: Whether pieces between blanks can be encoded alone.
        self.apart = not added and not any("\n" in p or "▁" in p.lstrip("▁") for p in live) and self.b.encode("\n")[:1] == [self.blank]
        self.remember, self.known = remember, {}

    def _ids_b(self, piece: str) -> tuple[str, int]:
        """What B is to encode for a piece of a text, and how many ids of it are to go: B puts a blank before everything."""
        return (piece[1:], 0) if piece[0] == " " else (piece, 1)

    def _pair(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        want = text.encode()
        if b"".join([self.bytes_a[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
            return None
        groups, links = cut_groups(a, b, self.len_a, self.len_b)
        return len(a), len(b), groups, np.array(links, "<i8").tobytes()

    def whole(self, text: str) -> tuple | None:
        return self._pair(" " + text, self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1))

    def _learn(self, keys: list[str]) -> dict:
        into = self.known if len(self.known) < self.remember else {}
        pieces = [k if k[0] in " \n" else " " + k for k in keys]
        of_a: list = [self.encoder.word_ids(k) for k in keys]
        slow = [i for i, x in enumerate(of_a) if x is None]
        for i, e in zip(slow, self.a.encode_batch_fast([pieces[i] for i in slow], add_special_tokens=False)):
            of_a[i] = e.ids
        cut = [self._ids_b(p) for p in pieces]
        of_b = self.b.encode([t for t, _ in cut], num_threads=1)
        for k, p, x, y, (t, drop) in zip(keys, pieces, of_a, of_b, cut):
            into[k] = self._pair(p, np.frombuffer(x, "<u4").tolist() if isinstance(x, bytes) else x, y[drop:] if t else [self.blank])
        return into

    def _parts(self, text: str) -> list[str] | None:
        """A text's pieces; one with a single blank before it is written without. None: not to be cut."""
        if not self.apart or _odd_space(text):
            return None
        if _even(text):
            return text.replace("\n", " \n").split(" ")
        return [p[1:] if p[0] == " " and len(p) > 1 and p[1] not in " \n" else p for p in PIECE.findall(" " + text)]

    def aligned(self, texts: list[str | None]) -> list[tuple | None]:
        cut = [self._parts(t) if t else None for t in texts]
        known = self.known
        new = list({p for parts in cut if parts for p in parts if p not in known})
        extra = self._learn(new) if new else known
        out = []
        for t, parts in zip(texts, cut):
            found = [known[p] if p in known else extra[p] for p in parts] if parts else [None]
            if not t:
                out.append(None)
                continue
            if None in found:  # not cut, or a piece is not given back: the text as one
                w = self.whole(t)
                found = [] if w is None else [w]
            if not found:
                out.append(None)
                continue
            na, nb, groups, links = zip(*found)
            links = b"".join(links)
            out.append((sum(na), sum(nb), len(links) // 8, ";".join(groups), links))
        return out


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


shared.remembers(aligner.cache_clear, "alignment")


def forget() -> None:
    """Gives back what encoding remembered, once a worker turns to counting."""
    if aligner.cache_info().currsize:
        aligner.cache_clear()
        shared.give_back()


def grouped(texts: list[str | None], most: int = GROUP) -> list[tuple[int, int]]:
    """Stretches of texts of about ``most`` characters."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i + 1 == len(texts):
            out.append((start, i + 1))
            start, size = i + 1, 0
    return out


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, links (packed pairs as little-endian integers of 64 bits) and, if asked for, the groups themselves."""
    path_a, path_b = path_a or default_tokenizer(), path_b or default_pieces()

    def run(batches):
        al = aligner(path_a, path_b)
        for b in batches:
            for at, to in grouped(b["t"]):
                keys, got = b["k"][at:to], al.aligned(b["t"][at:to])
                none = 0, 0, 0, "", b""
                na, nb, ng, text_, links = zip(*[g or none for g in got])
                out = {"doc_id": keys, "n_a": na, "n_b": nb, "n_groups": ng, "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in text_], "links": links}
                yield out | {"groups": text_} if groups else out

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return shared.map_columns(rows, run, ALIGNED + (", groups string" if groups else ""))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours of sorted ``keys`` made one, their counts summed."""
    if not len(keys):
        return keys, counts
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def _partial(batches):
    """np.unique of the pairs seen so far, given out whenever they are many."""
    forget()
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        k, n = np.unique(np.frombuffer(b"".join(b["links"]), "<i8"), return_counts=True)
        k, n = np.r_[keys, k], np.r_[counts, n]
        order = np.argsort(k, kind="stable")
        keys, counts = _summed(k[order], n[order])
        if len(keys) >= PARTIAL:
            yield {"key": keys, "n": counts}
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield {"key": keys, "n": counts}


def _write_shards(folder: str):
    """Writes a partition's sorted partial counts as one shard: keys, then counts. Counts wait in memory (a shard's share of
    ``SHARD_ROWS`` rows); the last key of a batch waits for the next one."""

    def run(batches):
        keys, counts = [], []
        for b in batches:
            k, n = _summed(np.array(b["key"], "<i8"), np.array(b["n"], "<i8"))
            if keys and len(k) and keys[-1][-1] == k[0]:
                counts[-1][-1] += n[0]
                k, n = k[1:], n[1:]
            if len(k):
                keys.append(k)
                counts.append(n.copy())
        if not keys:
            return
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        path = f"{folder}/counts-{uuid.uuid4().hex}.i8"
        shared.write_file(path, iter([keys.tobytes(), counts.tobytes()]))
        b, most = keys & LOW, np.zeros(int((keys & LOW).max()) + 1, np.int64)
        np.maximum.at(most, b, counts)
        live = np.flatnonzero(most)
        yield {"path": [path], "n": [len(keys)], "first": [int(keys[0])], "last": [int(keys[-1])], "b": [live.astype(np.int32)], "most": [most[live]]}

    return run


def count_shards(aligned: DataFrame, folder: str) -> DataFrame:
    """All pairs of ``aligned`` counted, in files under ``folder`` that follow each other by key; a row a shard: path, n,
    first, last, and of each B id in it the highest count."""
    partial = shared.staged(shared.map_columns(aligned.select("links"), _partial, "key long, n long"), "pair-counts")
    shards = max(1, -(-partial.count() // SHARD_ROWS))
    rows = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
    return shared.staged(shared.map_columns(rows, _write_shards(folder), SHARD), "count-shards")


def _mapped(path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard, mapped into memory; one in a remote store through a copy that has no name."""
    if shared.is_local(path) or path.startswith("file:"):
        both = np.memmap("/" + path[5:].lstrip("/") if path.startswith("file:") else path, "<i8", "r", shape=(2, n))
    else:
        with tempfile.TemporaryFile() as own, shared.open_file(path) as f:
            while part := f.read(8 << 20):
                own.write(part)
            own.flush()
            both = np.memmap(own, "<i8", "r", shape=(2, n))
    return both[0], both[1]


class CountShards:
    """Looks sorted keys up in shards (path, n, first), of which each holds the keys from its first to the next one's first."""

    def __init__(self, shards: list[tuple[str, int, int]]):
        self.shards = sorted(shards, key=lambda s: s[2])
        self.firsts = [s[2] for s in self.shards]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted, distinct ``keys``; 0 of one that no shard has."""
        out, at = np.zeros(len(keys), np.int64), 0
        while at < len(keys):
            s = max(0, bisect.bisect_right(self.firsts, int(keys[at])) - 1)
            to = int(np.searchsorted(keys, self.firsts[s + 1])) if s + 1 < len(self.firsts) else len(keys)
            if s not in self.open:
                self.open[s] = _mapped(*self.shards[s][:2])
            k, n = self.open[s]
            place = np.minimum(np.searchsorted(k, keys[at:to]), len(k) - 1)
            out[at:to] = np.where(k[place] == keys[at:to], n[place], 0)
            at = to
        return out


def pair_counts(shards: DataFrame) -> DataFrame:
    """a, b, n of the shards: the whole table of counts, read back."""

    def run(batches):
        for b in batches:
            for path, n in zip(b["path"], b["n"]):
                keys, counts = _mapped(path, n)
                for at in range(0, n, 1 << 18):
                    k = np.array(keys[at : at + (1 << 18)])
                    yield {"a": k >> 32, "b": k & LOW, "n": np.array(counts[at : at + (1 << 18)])}

    return shared.map_columns(shards.select("path", "n").repartition("path"), run, "a long, b long, n long")


def count_links(aligned: DataFrame, shards: DataFrame) -> DataFrame:
    """Each document's links by their corpus-wide counts: n_best (links whose count is their B id's highest), count_sum."""
    listed = [(r.path, r.n, r.first) for r in shards.select("path", "n", F.col("first")).collect()]  # a row a shard of millions of pairs
    best = shards.select(F.explode(F.arrays_zip("b", "most")).alias("x")).groupBy("x.b").agg(F.max("x.most").alias("n")).collect()  # no more than B has ids
    most = np.zeros(max((r.b for r in best), default=0) + 1, np.int64)
    for r in best:
        most[r.b] = r.n

    def run(batches):
        forget()
        table = CountShards(listed)
        for b in batches:
            ends = np.cumsum([len(x) // 8 for x in b["links"]])
            keys, place = np.unique(np.frombuffer(b"".join(b["links"]), "<i8"), return_inverse=True)
            counts = table.lookup(keys)
            is_best = counts == most[keys & LOW]
            sums = np.r_[0, np.cumsum(counts[place])]
            hits = np.r_[0, np.cumsum(is_best[place])]
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            yield {k: b[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")} | {"n_links": ends - starts, "n_best": hits[ends] - hits[starts], "count_sum": sums[ends] - sums[starts]}

    return shared.map_columns(aligned.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"), run, COUNTED)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = shared.staged(align(shared.table(spark, sf_dir, "documents")), "aligned")
    return count_links(aligned, count_shards(aligned, shared.fresh_path(spark, "pair-shards")))
