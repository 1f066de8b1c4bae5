"""Conversations rendered by a template, and read back from what was rendered.

Rows are dealt by conversation, sorted by turn and streamed: a task holds one part
of one conversation at a time.  A part ends after the turn that takes it past
``PART`` characters, so a conversation of any length is a run of parts.

Inside texts, control strings are escaped: a backslash goes behind their first
character (one more if backslashes are there already), and comes out again on
reading.  Line ends and backslashes in roles are written ``\\n`` and ``\\\\``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettica.llm.common import batches, bound_batches
from vettica.llm.template import compile_template

TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|im_start|>' ~ '' }}{{ m.role | role }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escaped }}{% endgeneration %}"
    "{% else %}{{ m.text | escaped }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}"
    "{% endfor %}"
)
#: Strings that must not come from a text.  Each begins with < or [, which none
#: has a second time, so no two of them overlap.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PART = 1_000_000

_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escaped(text: str | None) -> str:
    return _ESCAPE.sub(r"\1\\\2", text or "")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def role_line(role: str | None) -> str:
    plain = (role or "").replace("\\", "\\\\").replace("\n", "\\n")
    return escaped(plain)


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(line))


FILTERS = {"escaped": escaped, "role": role_line}


def parts(pieces: Iterable[tuple[str, bool]], ends: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """Pieces joined to parts that end after a piece ending in ``ends``:
    (text, starts and ends of what is generated, in code points)."""
    held: list[str] = []
    starts: list[int] = []
    stops: list[int] = []
    size = 0
    for text, generated in pieces:
        if generated:
            starts.append(size)
            stops.append(size + len(text))
        held.append(text)
        size += len(text)
        if size >= PART and text.endswith(ends):
            yield "".join(held), starts, stops
            held, starts, stops, size = [], [], [], 0
    if held or not size:
        yield "".join(held), starts, stops


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in source:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, text, loss_starts, loss_ends): rendered conversations.

    Null roles and texts count as empty, rows without conv_id as one conversation.
    Turns are taken by (turn, role, text), nulls first; repeated rows are turns of
    their own.  Loss offsets are code points inside the part's text.  The template
    must end a turn with ``<|im_end|>`` and a line end to be cut and read again.
    Other columns are not read."""
    bound_batches(conversations)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = pa.schema(
        [("conv_id", pa.string()), ("part", pa.int32()), ("text", pa.large_string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)

        def rendered() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(source), key=lambda r: r[0]):
                messages = ({"role": r[1] or "", "text": r[2] or ""} for r in rows)
                for number, (text, starts, stops) in enumerate(parts(render(messages=messages), "<|im_end|>\n")):
                    yield conv, number, text, starts, stops

        yield from batches(rendered(), schema, 200)

    return (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text")
        .mapInArrow(run, "conv_id string, part int, text string, loss_starts array<int>, loss_ends array<int>")
        .withColumn("conv_id", F.col("conv_id").cast(kind))
    )


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendered part."""
    for line, inner in _TURN.findall(text):
        yield role_of(line), unescaped(inner)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    from the output of ``format_conversations``, whose parts stand in order in
    their partition; nothing is shuffled."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = pa.schema(
        [("conv_id", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(source), key=lambda r: r[0]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = 0
                for _, _, text, starts, stops in rows:
                    chars += len(text)
                    for role, inner in turns_of(text):
                        turns.update(f"{role}\n{inner}\n".encode("utf-8", "surrogatepass"))
                        n += 1
                    for start, stop in zip(starts, stops, strict=True):
                        inner = unescaped(text[start:stop])
                        loss.update(inner.encode("utf-8", "surrogatepass"))
                        loss_chars += len(inner)
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from batches(digests(), schema)

    return formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "part", "text", "loss_starts", "loss_ends").mapInArrow(
        run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ).withColumn("conv_id", F.col("conv_id").cast(kind))
