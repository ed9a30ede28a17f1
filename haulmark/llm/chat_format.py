"""Chat formatting: conversations rendered by a compiled template, with generation markers.

Turns are brought together by conversation and sorted by Spark; a task then renders them one after
the other, so a conversation of any length needs the memory of one turn and one part.  The
formatted text comes in parts of about ``PART_CHARS``, numbered in order, with the spans of each
part that a model is trained on.

Control strings inside roles and texts are broken by a backslash after their first character, and
backslashes are doubled, so ``unescaped`` gives back every text exactly and no control string of
the output comes from a text.

Defined results: a null role or text is empty; turns with equal numbers are ordered by role and
text, null numbers come first; turns without a conversation id form one conversation with a null
id; repeated rows are repeated turns; an empty table gives an empty result.  Only ``conv_id``,
``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.template import compile_template

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for message in messages %}"
    "<|im_start|>{{ message.role | escape }}<|im_sep|>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "<|im_end|>\n"
    "{% endfor %}"
)
PART_CHARS = 1 << 20

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))


def escaped(text: str | None) -> str:
    doubled = (text or "").replace("\\", "\\\\")
    # Control strings hold no backslash, so a broken one is none, and a break can't make a new one.
    # "<<SYS>>" broken as "<\\<SYS>>" holds no other control string either.
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], doubled)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {"escape": escaped, "trim": lambda t: (t or "").strip(), "upper": lambda t: (t or "").upper()}


def _rows(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _parts(pieces: Iterable[tuple[str, bool]], limit: int) -> Iterator[tuple[str, list[int], list[int]]]:
    texts: list[str] = []
    begins: list[int] = []
    ends: list[int] = []
    size = 0
    for text, trained in pieces:
        if size and size + len(text) > limit:
            yield "".join(texts), begins, ends
            texts, begins, ends, size = [], [], [], 0
        if trained and text:
            begins.append(size)
            ends.append(size + len(text))
        texts.append(text)
        size += len(text)
    if size:
        yield "".join(texts), begins, ends


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, text, loss_begins and loss_ends (code points in the part), parts in order."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    together = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        turns = _rows(batches, ("conv_id", "role", "text"))
        held: list[tuple] = []
        size = 0
        for conv_id, group in groupby(turns, key=lambda r: r[0]):
            messages = ({"role": r[1], "text": r[2]} for r in group)
            for number, (text, begins, ends) in enumerate(_parts(render(messages=messages), part_chars)):
                held.append((conv_id, number, text, begins, ends))
                size += len(text)
                if size > part_chars:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    return together.mapInArrow(run, "conv_id long, part int, text string, loss_begins array<int>, loss_ends array<int>")


_PARTS = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss_begins", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARTS.types, strict=True)], schema=_PARTS)


class _Reader:
    """Takes the parts of one conversation in order; keeps digests and at most one turn of text."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest, self.role = "", None

    def feed(self, text: str, begins: list[int], ends: list[int]) -> None:
        self.chars += len(text)
        for b, e in zip(begins, ends, strict=True):
            trained = unescaped(text[b:e])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())
        self.rest += text
        at = 0
        while True:
            mark = MIDDLE if self.role is None else END
            end = self.rest.find(mark, at)
            if end < 0:
                break
            inside = self.rest[at:end]
            at = end + len(mark)
            if self.role is None:
                self.role = unescaped(inside[inside.index(START) + len(START) :])
            else:
                self.turns.update(f"{self.role}\n{unescaped(inside)}\n".encode())
                self.n_turns += 1
                self.role = None
        self.rest = self.rest[at:]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of every conversation from the parts of ``format_conversations``, where they lie."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        ids, *rest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, rest)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for conv_id, parts in groupby(_rows(batches, ("conv_id", "text", "loss_begins", "loss_ends")), key=lambda r: r[0]):
            reader = _Reader()
            for _, text, begins, ends in parts:
                reader.feed(text, begins, ends)
            found.append((conv_id, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
            if len(found) >= 4096:
                yield digests(found)
                found = []
        if found:
            yield digests(found)

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
