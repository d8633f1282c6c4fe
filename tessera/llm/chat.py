r"""Chat formatting by a compiled template, and its inverse (operator 13).

Conversations are dealt by id and sorted by turn, and each task runs through
its rows once: the template's loop takes one turn after another, so neither a
long conversation nor one that holds a third of all rows needs more memory
than its longest turn. Output comes in pieces, each with its place in the
loss mask; a conversation's formatted text is its pieces, one after another.

The default template writes a turn as ``### role: text</turn>`` and a line
end. A backslash stands before every backslash and control string that roles
and texts hold themselves, so the reader finds each turn's ends again and
takes the backslashes away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.templates import Template, TemplateError, unescape

OPENER, DIVIDER, CLOSER = "### ", ": ", "</turn>"
#: The role whose texts are learnt.
LEARNT = "assistant"
TEMPLATE = r"""
{#- Turns one after another; only what the assistant says is under the loss mask. -#}
{%- for m in messages -%}
  {{- opener ~ (m.role | escape(opener, closer, divider)) ~ divider -}}
  {%- if m.role == learnt -%}
    {%- generation %}{{ m.text | escape(opener, closer) }}{% endgeneration -%}
  {%- else -%}
    {{- m.text | escape(opener, closer) -}}
  {%- endif -%}
  {{- closer ~ "\n" -}}
{%- endfor -%}
"""
VALUES = {"opener": OPENER, "divider": DIVIDER, "closer": CLOSER, "learnt": LEARNT}
#: Pieces of one kind are joined up to so many characters.
PIECE = 1 << 14
#: The stated conversation that holds the template's own control strings; fixed by the contract.
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches, as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` characters of the rows' texts (third column, where they have one)."""
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += 64 + (len(row[2]) if isinstance(row[2], str) else 0)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)


def joined(pieces: Iterator[tuple[str, bool]], most: int = PIECE) -> Iterator[tuple[str, bool]]:
    """Pieces without empty ones; those of the same kind are joined, the unlearnt ones up to ``most`` characters."""
    kept, kind, size = [], False, 0
    for text, learn in pieces:
        if not text:
            continue
        if kept and (learn != kind or (size >= most and not learn)):
            yield "".join(kept), kind
            kept, size = [], 0
        kept.append(text)
        kind, size = learn, size + len(text)
    if kept:
        yield "".join(kept), kind


def formatted(conversations: DataFrame, template: str = TEMPLATE, **values: object) -> DataFrame:
    """(conv_id, piece, text, learn): the pieces of each conversation's formatted text, by place from 0, dealt by conversation and in order.

    ``conversations`` needs conv_id, turn, role and text; other columns are ignored. Turns come by turn (null first); ties and repeated rows are
    turns each, by role, then text. A null role or text is empty; rows without conv_id are one conversation without id. The template is
    given ``messages`` (each with turn, role, text) and ``values``. A conversation whose output is empty has one empty piece, so none is lost;
    an empty table gives no rows. A template that doesn't parse is an error here, before any row is read.
    """
    compiled, given = Template(template), {**VALUES, **values}
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("learn", pa.bool_())])

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, turns in groupby(rows, key=lambda r: r[0]):
            messages = ({"turn": turn, "role": role, "text": text} for _, turn, role, text in turns)
            number = -1
            for number, (text, learn) in enumerate(joined(compiled.pieces(messages=messages, **given))):
                yield conv_id, number, text, learn
            if number < 0:
                yield conv_id, 0, "", False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(pieces(_rows(batches)), schema)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text") \
        .mapInArrow(run, "conv_id long, piece long, text string, learn boolean")


def _bare(text: str, control: str, start: int) -> int:
    """The first place from ``start`` where ``control`` stands without a backslash of its own, or -1."""
    at = text.find(control, start)
    while at >= 0:
        slashes = at
        while slashes > start and text[slashes - 1] == "\\":
            slashes -= 1
        if (at - slashes) % 2 == 0:
            return at
        at = text.find(control, at + 1)
    return -1


def read_turns(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn that the default template wrote, from the pieces of one conversation's formatted text."""
    end = CLOSER + "\n"
    text = ""
    for piece in pieces:
        text += piece
        at = 0
        while True:
            if not text.startswith(OPENER, at):
                break
            divider = _bare(text, DIVIDER, at + len(OPENER))
            close = _bare(text, end, divider + len(DIVIDER)) if divider >= 0 else -1
            if close < 0:
                break
            yield unescape(text[at + len(OPENER):divider]), unescape(text[divider + len(DIVIDER):close])
            at = close + len(end)
        text = text[at:]
    if text:
        raise TemplateError(f"not the template's output: {text[:40]!r}")


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns, read back from the output of ``formatted`` with the default template.

    ``pieces`` must be dealt and sorted as ``formatted`` leaves it; each conversation is read in one pass and hashed as it comes.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if n.endswith("256") else pa.int64()) for n in names])

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, own in groupby(rows, key=lambda r: r[0]):
            turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

            def texts(own=own, loss=loss, counts=counts) -> Iterator[str]:
                for _, _, text, learn in own:
                    counts[2] += len(text)
                    if learn:
                        learnt = unescape(text)
                        counts[1] += len(learnt)
                        loss.update(learnt.encode())
                    yield text

            for role, text in read_turns(texts()):
                counts[0] += 1
                turns.update(f"{role}\n{text}\n".encode())
            yield conv_id, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(read(_rows(batches)), schema)

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
