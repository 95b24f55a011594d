"""Quality rules: repetition measures of each text, and lines that a host repeats across documents.

A line is normalised (A-Z lowered, white space runs to one space) and hashed to 128 bits. For
each host the distinct documents with the line are counted; the counts are formed before and
after a shuffle that includes the document, so a line in a third of all rows is not one task.
A line in more than ``min_docs`` documents and in more than ``max_share`` of the host's
documents is removed; a document that loses more than ``max_removed`` of its words is rejected.
The share makes the limit mean the same on a host of any size.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import over_batches, whole_row
from palisade.session import settle

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 20
MAX_SHARE = 0.1
MAX_REMOVED = 0.5
SALTS = 64

_SPACE = b" \t\n\v\f\r"
_NOT_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))


class Measures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def measure(text: str | None) -> Measures:
    """The base measures of one text; a null text measures like an empty one."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return Measures(
        len(words),
        len(text) - len(data) + len(data.translate(None, _SPACE)),
        len(data.translate(None, _NOT_SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
    )


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, until = 0, 0
    for k, window in enumerate(windows):
        if counts[window] > 1:
            total += k + 3 - max(until, k)
            until = k + 3
    return total


def normalised(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def _line_words(text: str) -> dict[bytes, int]:
    """Hash of each normalised line with a word, and how many words the text has on such lines."""
    found: dict[bytes, int] = {}
    for line in text.encode("utf-8", "replace").split(b"\n"):
        parts = line.lower().split()
        if parts:
            key = xxhash.xxh3_128_digest(b" ".join(parts))
            found[key] = found.get(key, 0) + len(parts)
    return found


def _row():
    """A digest of id, host and text: rows that agree in them share their verdict."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\n", part("doc_id"), part("source"), part("text"))))


_MEASURED = ("doc_id long, host string, _row binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, lines array<struct<line: binary, words: int>>")


def measures(docs: DataFrame) -> DataFrame:
    """The base measures of every row and the hashes of its lines."""
    def task(batch: pa.RecordBatch) -> dict:
        texts = [x or "" for x in batch.column(3).to_pylist()]
        made = list(zip(*map(measure, texts)))
        lines = [[{"line": k, "words": n} for k, n in _line_words(t).items()] for t in texts]
        return {"doc_id": batch.column(0), "host": batch.column(1), "_row": batch.column(2),
                **dict(zip(Measures._fields, made)), "lines": lines}

    host = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("host")
    return over_batches(
        docs.select(F.col("doc_id").cast("long"), host, _row().alias("_row"), "text"), _MEASURED, task)


def common_lines(measured: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``host, line, n_docs``: the lines above the limits. Rows without an id count for none."""
    known = measured.where(F.col("doc_id").isNotNull())
    hosts = known.groupBy("host").agg(F.countDistinct("doc_id").alias("docs"))
    counts = (
        known.select("doc_id", "host", F.explode("lines.line").alias("line"))
        .groupBy("host", "line").agg(F.countDistinct("doc_id").alias("n_docs")).where(F.col("n_docs") > min_docs)
    )
    return counts.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("docs")).select("host", "line", "n_docs")


def _verdicts(measured: DataFrame, limits: dict) -> DataFrame:
    """``_row, removed`` (hashes)``, removed_words`` for the rows that lose a line."""
    common = settle(common_lines(measured, **limits), "common-lines")
    # Common lines are in very many rows by definition: their rows are dealt by a salt from the row.
    salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS)).alias("salt")
    lines = measured.select("host", "_row", salt, F.explode("lines").alias("x")).select("host", "_row", "salt", "x.line", "x.words")
    salted = common.select("host", "line", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    hits = lines.join(salted, ["host", "line", "salt"]).select("_row", "line", "words").distinct()
    return hits.groupBy("_row").agg(F.collect_list("line").alias("removed"), F.sum("words").alias("removed_words"))


def quality(
    docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """One row per row of ``docs``: the measures, ``base_failed``, ``removed_words`` and ``kept``.

    Null and empty texts have no words, so they fail the base rules. A null source is a host
    of its own. Repeated rows, also those with one id, get a row each; documents are counted
    by distinct id, and a row without an id has its lines removed but counts for no limit. An
    empty table gives no rows; other columns are ignored.
    """
    measured = settle(measures(docs), "measures")
    lost = _verdicts(measured, {"min_docs": min_docs, "max_share": max_share})
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0)).cast("long")
    return (
        measured.drop("lines", "host").join(lost, "_row", "left")
        .select("doc_id", *Measures._fields, failed.alias("base_failed"),
                (~failed & (removed <= max_removed * F.col("n_words"))).alias("kept"),
                removed.alias("removed_words"), "_row", "removed")
    )


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, in their own columns, without the lines above the limits.

    Other columns stay as they are, whatever their names; ``n_chars``, where there is one, is counted anew for
    texts that lost a line. The cases are those of ``quality``.
    """
    verdict = quality(docs, **limits).where("kept").select("_row", "removed").dropDuplicates(["_row"])
    kept = docs.select(whole_row(docs), _row().alias("_row")).join(settle(verdict, "quality-verdicts"), "_row")
    touched = F.col("removed").isNotNull()
    names = docs.columns
    place = names.index("text")

    def task(batch: pa.RecordBatch) -> pa.RecordBatch:
        *columns, removed = batch.columns
        texts = [_without(t, set(g)) for t, g in zip(columns[place].to_pylist(), removed.to_pylist())]
        columns[place] = pa.array(texts, columns[place].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    # Only rows that lose a line pass through Python.
    cut = over_batches(kept.where(touched).select(
        *[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(names)], "removed"), docs.schema, task)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.where(~touched).select("row.*").union(cut)


def _without(text: str, gone: set[bytes]) -> str:
    lines = text.split("\n")
    hashed = lambda x: xxhash.xxh3_128_digest(normalised(x.encode("utf-8", "replace")))
    return "\n".join(x for x in lines if not x.strip(" \t\n\v\f\r") or hashed(x) not in gone)
