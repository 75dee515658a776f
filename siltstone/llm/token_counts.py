"""Token counts by section or field, from one encoding of the whole document.

A document is encoded once; its tokens' character spans are interval-joined to
the sections' spans (both are sorted, so by binary search), and a token that
crosses a border goes where ``rule`` says:

- ``first``: to the section of its first character (the default);
- ``last``: to the section of its last character;
- ``most``: to the section that holds most of its characters, the earlier on a tie;
- ``split``: to each section by its share of the token's characters.

Sections tile the text. Defined results: a null or empty text has one empty
section and no tokens; null keys and repeated rows are kept, a row each; other
columns of the input are not looked at; a key called like a result gets an underscore
behind its name; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import default_tokenizer, encoder

RULES = ("first", "last", "most", "split")
NAMES = ["key", "n_chars", "n_tokens", "n_sections", "crossing_tokens", "section_chars", "section_tokens"]
SCHEMA = "key long, n_chars long, n_tokens long, n_sections long, crossing_tokens long, section_chars array<long>, section_tokens array<double>"


def attribute(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section [borders[i], borders[i+1]), and how many tokens cross a border."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    n = len(borders) - 1
    counts = np.zeros(n)
    if not len(starts):
        return counts, 0
    a = np.clip(np.searchsorted(borders, starts, side="right") - 1, 0, n - 1)
    b = np.maximum(a, np.clip(np.searchsorted(borders, ends - 1, side="right") - 1, 0, n - 1))
    crossing = np.flatnonzero(b > a)
    to = b if rule == "last" else a.copy()
    if rule in ("most", "split") and len(crossing):
        inside = np.ones(len(a), dtype=bool)
        for t in crossing.tolist():
            spans = np.arange(a[t], b[t] + 1)
            share = np.minimum(ends[t], borders[spans + 1]) - np.maximum(starts[t], borders[spans])
            if rule == "most":
                to[t] = spans[int(np.argmax(share))]
            else:
                inside[t] = False
                counts[spans] += share / share.sum()
        to = to[inside]
    return counts + np.bincount(to, minlength=n), len(crossing)


def section_borders(text: str, separator: re.Pattern) -> np.ndarray:
    """A section ends behind each separator; the text's last piece is one too unless it is empty."""
    ends = [m.end() for m in separator.finditer(text) if m.end() > m.start()]
    return np.array([0, *ends, *([len(text)] if not ends or ends[-1] < len(text) else [])], dtype=np.int64)


def count_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n+", rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """A row a document: its sizes, and the characters and tokens of each section in order."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        e, cut = encoder(tokenizer), re.compile(separator)
        for b in batches:
            rows = shared.rows_buffer(NAMES)
            for k, t in zip(b["k"], b["t"]):
                t = t or ""
                ids, s, x = e.encode_spans(t)
                borders = section_borders(t, cut)
                counts, crossing = attribute(s, x, borders, rule)
                rows.add(k, len(t), len(ids), len(counts), crossing, np.diff(borders).tolist(), counts.tolist())
            yield rows.take()

    out = shared.map_columns(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), run, SCHEMA)
    return out.withColumnRenamed("key", shared.free_name(NAMES[1:], key))


def count_fields(rows: DataFrame, key: str, fields: list[str], joiner: str = "\n", rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """As count_sections, with the row's ``fields`` joined to one text: section i is field i with the joiner behind it."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        e = encoder(tokenizer)
        for b in batches:
            out = shared.rows_buffer(NAMES)
            for k, *parts in zip(b["k"], *(b[f"f{i}"] for i in range(len(fields)))):
                parts = [(p or "") + (joiner if i + 1 < len(parts) else "") for i, p in enumerate(parts)]
                text = "".join(parts)
                ids, s, x = e.encode_spans(text)
                borders = np.cumsum([0, *map(len, parts)])
                counts, crossing = attribute(s, x, borders, rule)
                out.add(k, len(text), len(ids), len(counts), crossing, np.diff(borders).tolist(), counts.tolist())
            yield out.take()

    chosen = rows.select(F.col(key).cast("long").alias("k"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)))
    return shared.map_columns(chosen, run, SCHEMA).withColumnRenamed("key", shared.free_name(NAMES[1:], key))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_sections(shared.table(spark, sf_dir, "documents"))
