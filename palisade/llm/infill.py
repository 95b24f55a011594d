"""Fill-in-middle transformation with cuts located in a wavelet matrix over character classes.

A text's tokens are runs of ASCII letters and single other characters. Each character has a
class of two bits: whether it is a letter, and whether a letter stands before it. Two stable
partitions by these bits make a wavelet matrix. The token starts before a place are the
characters there that are no letters, plus the letters without a letter before them: two
rank queries. A cut after so many tokens is where that count first exceeds the number, which
a bisection on the ranks finds.

The numbers that place the cuts and choose the form come from a digest of the id, so they do
not depend on partitions or reruns.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import over_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
TRANSFORMED_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20

# Classes: the upper bit says letter, the lower one says that a letter stands before.
LETTER, AFTER_LETTER = 2, 1


class Bits:
    """Bits with counts of ones before every 64th, so that a rank reads one word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, end: int) -> int:
        """Ones before ``end``."""
        word = int(self.words[end >> 6]) & ((1 << (end & 63)) - 1)
        return int(self.before[end >> 6]) + word.bit_count()


class WaveletMatrix:
    """Rank queries over a sequence of small codes, highest bit first."""

    def __init__(self, codes: np.ndarray, width: int) -> None:
        self.size, self.width = len(codes), width
        self.planes: list[Bits] = []
        self.zeros: list[int] = []
        for shift in range(width - 1, -1, -1):
            bits = (codes >> shift) & 1
            self.planes.append(Bits(bits))
            self.zeros.append(len(codes) - int(self.planes[-1].before[-1]))
            if shift:
                ones = bits.astype(bool)
                codes = np.concatenate([codes[~ones], codes[ones]])

    def rank(self, code: int, end: int, depth: int | None = None) -> int:
        """Places before ``end`` whose code equals ``code``, or agrees with it in its first ``depth`` bits."""
        start = 0
        for level in range(self.width if depth is None else depth):
            plane, one = self.planes[level], code >> (self.width - 1 - level) & 1
            if one:
                start, end = self.zeros[level] + plane.rank(start), self.zeros[level] + plane.rank(end)
            else:
                start, end = start - plane.rank(start), end - plane.rank(end)
        return end - start


def classes(text: str) -> np.ndarray:
    """The class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) - 97 < 26).astype(np.uint8)
    made = letter * np.uint8(LETTER)
    made[1:] |= letter[:-1]
    return made


class Tokens:
    """Counts and places of the tokens of a text."""

    def __init__(self, text: str) -> None:
        self.matrix = WaveletMatrix(classes(text), 2)
        self.count = self.starts(self.matrix.size)

    def starts(self, end: int) -> int:
        """Tokens that start before ``end``."""
        return self.matrix.rank(0, end, depth=1) + self.matrix.rank(LETTER, end)

    def place(self, tokens: int) -> int:
        """Where the text is cut after so many tokens: the place at which the next one starts."""
        if tokens >= self.count:
            return self.matrix.size
        # A token has one character at least, so the next one does not start earlier.
        low, high = tokens, self.matrix.size
        while low < high:
            half = (low + high) >> 1
            if self.starts(half + 1) > tokens:
                high = half
            else:
                low = half + 1
        return low


class Infill(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def infill(doc_id: int | None, text: str, seed: int = SEED) -> Infill:
    """One text, cut and put together in the form its id draws."""
    tokens = Tokens(text)
    first, second, whether, which = draws(doc_id, seed)
    n = tokens.count
    if not text or whether % 100 >= TRANSFORMED_PERCENT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return Infill(n, "plain", None, None, text)
    low, high = sorted((tokens.place(first % (n + 1)), tokens.place(second % (n + 1))))
    before, middle, after = text[:low], text[low:high], text[high:]
    if which % 100 < SUFFIX_FIRST_PERCENT:
        return Infill(n, "spm", low, high - low, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}")
    return Infill(n, "psm", low, high - low, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}")


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: one row per row of ``docs``.

    A null text is an empty one. Empty texts, and texts that hold one of the marks, stay plain;
    plain rows have no lengths of parts. A null id draws as an empty one and stays null. Rows
    that repeat an id draw the same numbers. A very long text takes some thirteen bytes a
    code point while it is cut. An empty table gives no rows; other columns are ignored.
    """
    def task(batch: pa.RecordBatch) -> dict:
        made = [infill(i, t or "", seed) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        return {"doc_id": batch.column(0)} | {f: [getattr(m, f) for m in made] for f in Infill._fields}

    return over_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", task)


def restored(output: str | Column, form: str | Column) -> Column:
    """The text of an output, from the output and its form alone.

    A mark begins with its only ``<``, so none can arise where two parts meet, and splitting
    at the marks is exact.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    between = lambda first, second: F.split_part(F.split_part(output, F.lit(first), F.lit(2)), F.lit(second), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``fill_in_middle`` with digests of the output and of the restored text in its place."""
    made = fill_in_middle(docs, seed)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored("output", "form"), 256).alias("restored_sha256"))
