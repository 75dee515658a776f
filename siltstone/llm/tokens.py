"""Whole-text encoding with a byte-level BPE of the tokenizers library.

Text is cut before runs of blanks and line feeds, which are always borders
between pre-tokens of such a tokenizer, so a piece encodes alone as it does in
place. Pieces repeat, so a process keeps their ids; texts with any other white
space are encoded in one go, because there a cut could split a run of it, and so
are texts that hold one of the tokenizer's added tokens ("<|endoftext|>"). These give
their own id, as in the library, unless ``control`` is False: then they are plain text.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from operator import itemgetter

import numpy as np

from . import shared

PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+$")
#: Marks a text's first word, which no blank precedes, among the parts of an even text.
FIRST = "\t"
#: White space other than blanks and line feeds; looking for each is faster than a pattern.
ODD_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Pieces remembered by a process; beyond it no more are kept (spans start anew). It bounds memory, not results.
REMEMBER = 800_000
STOPS = ".,"
SPECIAL_END = 2
#: Marks behind a word's letters, where another pre-token begins (an apostrophe may be part of a contraction).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: New words that are encoded in one string.
TOGETHER = 500
#: Up to here a character that is a letter to Python is one to the pre-tokenizer (Latin letters of the first Unicode versions).
LATIN = "\u0240"


def byte_of_char() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes bytes as: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_CHARS = {b: c for c, b in byte_of_char().items()}


def letters(word: str) -> bool:
    """Whether a word is of Latin letters alone, and so one pre-token."""
    return word.isalpha() and (word.isascii() or max(word) < LATIN)


def spelled(text: str) -> str:
    """A text as a byte-level vocabulary writes it."""
    return text.replace(" ", "\u0120") if text.isascii() else text.encode().decode("latin-1").translate(_CHARS)


def _odd_space(t: str) -> bool:
    for c in ODD_SPACES[:8] if t.isascii() else ODD_SPACES:
        if c in t:
            return True
    return False


def _even(t: str) -> bool:
    """White space is single blanks and line feeds between words."""
    return not (t[:1] in " \n" or t[-1:] in " \n" or "  " in t or "\n\n" in t or " \n" in t or "\n " in t or _odd_space(t))


class _Known(dict):
    """Ids by part; None of an unknown one."""

    def __missing__(self, part: str) -> None:
        return None


def _piece(part: str) -> str:
    """The text that a part stands for."""
    return part[1:] if part[0] == FIRST else part if part[0] in " \n" else " " + part


def _parts(p: str) -> tuple[str, str, str]:
    """A leading line feed, the word, a trailing stop: borders between them are
    pre-token borders if the line feed stands alone and the stop follows a letter or digit."""
    lead = stop = ""
    if len(p) > 1 and p[0] == "\n" and p[1] not in " \n":
        lead, p = "\n", p[1:]
    if len(p) > 1 and p[-1] in STOPS and p[-2].isalnum():
        p, stop = p[:-1], p[-1]
    return lead, p, stop


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def encoder(path: str, remember: int = REMEMBER, control: bool = True) -> "Encoder":
    return Encoder(path, remember, control)


shared.remembers(encoder.cache_clear, "packing", "token_shards", "token_counts")


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remember: int = REMEMBER, control: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not control
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if control or not t.special]
        self.added = [t.content for t in added]
        if any(re.search(r"\s", t.content) or t.normalized and not t.special for t in added):
            self.added = [""]  # such a token could lie across pieces: all texts are encoded whole
        self.remember, self.known = remember, _Known()
        self.spans: dict[str, tuple[bytes, bytes]] = {}
        self.tails: dict[str, bytes] = {}
        self.known_lead, *stops = self._ids(["\n", *STOPS])
        self.stops = dict(zip(STOPS, stops))
        self.line_feed = int(np.frombuffer(self.known_lead, dtype="<u4")[0])
        # of a plain byte-level tokenizer the model alone gives a single pre-token's ids, in half the time
        probes = [" the", "***", "Straße", " naïveté", " x", "Encyclopaedias", " Ærøskøbing"]
        plain = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.direct = plain and [self._model_ids(p) for p in probes] == self._ids(probes)

    def _whole(self, text: str) -> bool:
        for a in self.added:
            if a in text:
                return True
        return False

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, part: str) -> bytes | None:
        """Ids of letters behind a blank, and marks behind them; None of any other part."""
        word = part.rstrip(MARKS)
        if not self.direct or not word or not letters(word):
            return None
        ids = self.known[word] or self._model_ids(" " + word)
        return ids if len(word) == len(part) else ids + self._marks(part[len(word) :])

    def _marks(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._model_ids(marks)
            if len(self.tails) < 10_000:
                self.tails[marks] = ids
        return ids

    def _model_ids(self, word: str) -> bytes:
        """Ids of one pre-token."""
        ids = [t.id for t in self.tokenizer.model.tokenize(spelled(word))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """As encode, with one call of the library for what a group of texts has new."""
        known, cut, new = self.known, [], set()
        for t in texts:
            if self._whole(t):
                parts = None
            elif _even(t):  # a part is a word behind a blank, or a line feed and a word
                parts = t.replace("\n", " \n").split(" ")
                parts[0] = FIRST + parts[0]
            else:
                parts = None if _odd_space(t) else PIECE.findall(t)
                if parts and parts[0][0] not in " \n":
                    parts[0] = FIRST + parts[0]
            found, missing = None if parts is None else itemgetter(*parts)(known) if len(parts) > 1 else tuple(map(known.get, parts)), []
            if found and None in found:
                found = list(found)
                missing = [i for i, v in enumerate(found) if v is None]
                new.update([parts[i] for i in missing])
            cut.append((parts, found, missing))
        extra = self._learn(new) if new else self.known
        out = []
        for t, (parts, found, missing) in zip(texts, cut):
            for i in missing:
                found[i] = extra[parts[i]]
            out.append(self._ids([t])[0] if parts is None else b"".join(found))
        return out

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of parts not known yet, remembered while there is room; a part is put
        together from its word and its stop where it ends in one."""
        into = self.known if len(self.known) < self.remember else {}
        pieces = {}
        for p in new:
            first = p[0]
            if first != "\n" and first != "\t" and first != " ":
                ids = self.word_ids(p)
                if ids is not None:
                    into[p] = ids
                    continue
            if first in "\n\t " or len(p) == 1:
                pieces[p] = _parts(_piece(p))
            elif p[-1] in STOPS and p[-2].isalnum():
                pieces[p] = "", " " + p[:-1], p[-1]
            else:
                pieces[p] = "", " " + p, ""
        words = {w for _, w, _ in pieces.values()}
        ids_of, plain = {}, []
        for w in words:
            if self.direct and letters(w[1:] if w[0] == " " else w):
                ids_of[w] = self._model_ids(w)
            elif "\n" not in w and not w[-1].isspace():
                plain.append(w)
        for k in range(0, len(plain), TOGETHER):
            some = plain[k : k + TOGETHER]
            ids = np.frombuffer(self._ids(["\n".join(some)])[0], dtype="<u4")
            cut = np.flatnonzero(ids == self.line_feed)
            assert len(cut) == len(some) - 1
            b, at = ids.tobytes(), 0
            for w, end in zip(some, [*(cut * 4).tolist(), len(b)]):
                ids_of[w] = b[at:end]
                at = end + 4
        odd = [w for w in words if w not in ids_of]
        ids_of.update(zip(odd, self._ids(odd)))
        for p, (lead, w, stop) in pieces.items():
            into[p] = (self.known_lead if lead else b"") + ids_of[w] + (self.stops[stop] if stop else b"")
        return into

    def encode_spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where each token starts and ends in ``text``, in characters. A
        token that holds part of a character's bytes spans that whole character."""
        if _odd_space(text) or self._whole(text):
            e = self.tokenizer.encode(text, add_special_tokens=False)
            at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            return np.array(e.ids, dtype=np.uint32), at[:, 0], at[:, 1]
        pieces = PIECE.findall(text)
        spans = self.spans
        new = {p for p in pieces if p not in spans}
        if new:
            if len(spans) > self.remember // 2:
                spans.clear()
                new = set(pieces)
            self._learn_spans(list(new))
        got = [spans[p] for p in pieces]
        ids = np.frombuffer(b"".join([g[0] for g in got]), dtype="<u4")
        at = np.frombuffer(b"".join([g[1] for g in got]), dtype="<i4").reshape(-1, 2).astype(np.int64)
        if not len(ids):
            return ids, at[:, 0], at[:, 1]
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        counts = np.fromiter((len(g[0]) // 4 for g in got), dtype=np.int64, count=len(got))
        base = np.repeat(np.cumsum(lengths) - lengths, counts)
        return ids, at[:, 0] + base, at[:, 1] + base

    def _learn_spans(self, new: list[str]) -> None:
        """Pieces that begin with white space and end without it are encoded in one
        string: where they meet is a pre-token border."""
        joined = [p for p in new if p[0] in " \n" and not p[-1].isspace()]
        if joined:
            starts = np.cumsum([0, *map(len, joined)])
            e = self.tokenizer.encode("".join(joined), add_special_tokens=False)
            at = np.array(e.offsets, dtype="<i4").reshape(-1, 2)
            cut = np.searchsorted(at[:, 0], starts)
            at = at - np.repeat(starts[:-1], np.diff(cut))[:, None].astype("<i4")
            ids, at, cut = np.array(e.ids, dtype="<u4").tobytes(), at.astype("<i4").tobytes(), cut.tolist()
            for k, p in enumerate(joined):
                self.spans[p] = ids[4 * cut[k] : 4 * cut[k + 1]], at[8 * cut[k] : 8 * cut[k + 1]]
        rest = [p for p in new if p not in self.spans]
        for p, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            self.spans[p] = np.array(e.ids, dtype="<u4").tobytes(), np.array(e.offsets, dtype="<i4").tobytes()
