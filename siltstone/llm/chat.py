"""Chat formatting: conversations rendered by a compiled template, and read back.

A conversation's turns are sorted to one task and streamed through the template, so
a long conversation is never held whole; its text is given in parts of about
``PART`` characters, each with the spans that a model would generate.

Defined results: a null text or role is empty; turns are ordered by turn (null
first), role, text, and repeated rows are kept; a null conv_id is a conversation
of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .templates import Template

PART = 1 << 20
BEGIN, HEAD, END = "<|turn|>", "<|says|>", "<|end|>"
#: What a text may not hold unescaped: the template's own marks and those of other public chat formats.
CONTROL = (BEGIN, HEAD, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>\n", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
SOURCE = (
    "{% for m in messages %}" + BEGIN + "{{ m.role | escape }}" + HEAD
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    + END + "{{ '\n' }}{% endfor %}"
)
FORMATTED = "conv_id long, part long, start long, text string, generated array<struct<start:long,end:long>>"


def format_conversations(turns: DataFrame, source: str = SOURCE, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """conv_id, part, start (of the part in its conversation's text), text, and
    generated: spans of the whole text. Parts of a conversation come in order in one task."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        template = Template(source, control)
        names = ["conv_id", "part", "start", "text", "generated"]

        def messages():
            for b in batches:
                yield from zip(b["conv_id"], b["role"], b["text"])

        for conv, own in groupby(messages(), key=itemgetter(0)):
            part, at, text, size, spans = 0, 0, [], 0, []
            for piece, generated in template.render({"role": r, "text": t} for _, r, t in own):
                if generated and piece:
                    begin = at + size
                    if spans and spans[-1]["end"] == begin:
                        spans[-1]["end"] = begin + len(piece)
                    else:
                        spans.append({"start": begin, "end": begin + len(piece)})
                text.append(piece)
                size += len(piece)
                if size >= PART:
                    yield dict(zip(names, ([conv], [part], [at], ["".join(text)], [spans])))
                    part, at, text, size, spans = part + 1, at + size, [], 0, []
            yield dict(zip(names, ([conv], [part], [at], ["".join(text)], [spans])))

    return shared.map_columns(rows, run, FORMATTED)


def parse_turns(parts: Iterator[str], unescape) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of the default template's text, which may come in parts."""
    rest = ""
    for part in parts:
        rest += part
        at = 0
        while (end := rest.find(END + "\n", at)) >= 0:
            if not rest.startswith(BEGIN, at):
                raise ValueError("a turn does not begin with its mark")
            head = rest.index(HEAD, at, end)
            yield unescape(rest[at + len(BEGIN) : head]), unescape(rest[head + len(HEAD) : end])
            at = end + len(END) + 1
        rest = rest[at:]
    if rest:
        raise ValueError("the last turn is cut off")


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Digests of what the default template's output holds, read from its text and spans."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        template = Template(SOURCE, CONTROL)
        unescape = template.escaper.unescape

        def parts():
            for b in batches:
                yield from zip(b["conv_id"], b["start"], b["text"], b["generated"])

        rows = shared.rows_buffer(names)
        for conv, own in groupby(parts(), key=itemgetter(0)):
            loss, chars, total, n, turns = hashlib.sha256(), 0, 0, 0, hashlib.sha256()

            def texts():
                nonlocal chars, total
                for _, start, text, spans in own:
                    for s in spans:
                        part = unescape(text[s["start"] - start : s["end"] - start])
                        loss.update(part.encode("utf-8", "surrogatepass"))
                        chars += len(part)
                    total += len(text)
                    yield text

            for role, text in parse_turns(texts(), unescape):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            rows.add(conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)
            if rows.full():
                yield rows.take()
        if rows:
            yield rows.take()

    return shared.map_columns(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_conversations(format_conversations(turns.unionByName(more)))
