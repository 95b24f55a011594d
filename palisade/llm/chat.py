r"""Chat formatting at token level.

A turn becomes ``<|start|>role<|sep|>text<|end|>``. Role and text are encoded on their own, as ordinary text,
and the three marks are reserved ids spliced in between, so no text can produce them. Marks
and other control strings inside a text are escaped as well, for readers of the formatted
text: a backslash goes behind the first character of the string, one more than it has there
already, which is taken back by removing one. The loss mask is the running sum of +1 where an
assistant text starts and -1 where it ends.

Turns are formatted row by row. Only reading a conversation back in order brings its turns
together, as a sorted stream that holds one turn at a time, however long the conversation is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import over_batches

MARKS = ("<|start|>", "<|sep|>", "<|end|>")
# Control strings of other templates that a text should not show unescaped.
OTHER_CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"

_ESCAPES = re.compile("|".join(
    f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in sorted({*MARKS, *OTHER_CONTROLS}, key=len, reverse=True)))


def escape(text: str) -> str:
    return _ESCAPES.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPES.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


class Template:
    """Encoder of a rank file, with the first ids after its vocabulary reserved for the marks."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        with open(rank_file) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("template", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start, self.sep, self.end = range(max(ranks.values()) + 1, max(ranks.values()) + 4)
        self.marks = dict(zip((self.start, self.sep, self.end), MARKS))

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(escape(text))

    def turn(self, role: str, text: str) -> tuple[list[int], np.ndarray]:
        """The ids of a turn and its loss mask."""
        opened = [self.start, *self.encode(role), self.sep]
        inside = self.encode(text)
        ids = [*opened, *inside, self.end]
        change = np.zeros(len(ids) + 1, np.int8)
        if role == LOSS_ROLE:
            change[len(opened)] += 1
            change[len(opened) + len(inside)] -= 1
        return ids, np.cumsum(change[:-1], dtype=np.int8)

    def render(self, ids: list[int]) -> str:
        """The formatted text: marks as strings, everything else decoded."""
        out, run = [], []
        for i in ids:
            if i in self.marks:
                out += [self.encoding.decode(run), self.marks[i]]
                run = []
            else:
                run.append(i)
        return "".join(out) + self.encoding.decode(run)

    def read(self, ids: list[int]) -> tuple[str, str]:
        """Role and text of a turn, from its ids alone."""
        sep = ids.index(self.sep)
        plain = lambda part: unescape(self.encoding.decode(part))
        return plain(ids[1:sep]), plain(ids[sep + 1:-1])


@lru_cache(maxsize=2)
def template(rank_file: str, pattern: str) -> Template:
    return Template(rank_file, pattern)


def format_turns(rows: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``conv_id, turn, ids, mask``: one row per row of ``rows``.

    A null role or text is empty. A null conversation id is a conversation of its own; repeated
    rows are turns of their own. An empty table gives no rows; other columns are ignored.
    """
    def task(batch: pa.RecordBatch) -> dict:
        made = [template(rank_file, pattern).turn(r or "", t or "")
                for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return {"conv_id": batch.column(0), "turn": batch.column(1),
                "ids": [ids for ids, _ in made], "mask": [mask for _, mask in made]}

    return over_batches(
        rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"),
        "conv_id long, turn long, ids array<int>, mask array<byte>", task)


def read_back(formatted: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """One row per conversation, from ids and masks alone.

    Turns are in the order of ``turn``, null first, ties by their ids.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(rank_file, pattern)
        now, open_ = None, None  # a null id is a conversation as well, so this needs two variables
        for batch in batches:
            done = []
            for conv, ids, mask in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or conv != now:
                    if open_ is not None:
                        done.append(open_.row(now))
                    now, open_ = conv, Reading()
                open_.add(form, ids, mask)
            if done:
                yield _rows(done, names)
        if open_ is not None:
            yield _rows([open_.row(now)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "ids")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(run, schema)


class Reading:
    """Digests of a conversation, turn by turn."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, form: Template, ids: list[int], mask: list[int]) -> None:
        role, text = form.read(ids)
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        masked = unescape(form.encoding.decode([i for i, m in zip(ids, mask) if m]))
        self.loss_chars += len(masked)
        self.loss.update(masked.encode("utf-8", "replace"))
        self.chars += len(form.render(ids))

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
