"""SentencePiece BPE encoding and decoding with a table of last tokens.

Every prefix of a text has one encoding, and so one last token. A token that ends a prefix is
that token when it encodes to itself and is compatible with the last token of the prefix before it:
merging the two of them alone leaves both as they are. An automaton over the vocabulary gives
the tokens that end at each place, longest first; the first compatible one goes into the
table. The ids are then read off backwards from the end. Work is linear in the text, also for
a text without any space.

A piece of this kind of model never holds a letter before a space mark, so a text is cut
before the marks that follow something else, and at characters that no piece holds. The
distinct units of a batch are solved in order, so that units share the table's entries of their
common prefixes. Results of the latest units are kept, up to a bounded size. A unit of more
than ``LONGEST_CACHED`` characters has a table of its own, by place instead of by prefix.
"""

from __future__ import annotations

import gc
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from palisade.llm import tries
from palisade.llm.common import over_batches

MARK = "▁"  # stands for a space inside pieces
CACHED_PREFIXES = 100_000
CACHED_PAIRS = 600_000
LONGEST_CACHED = 64
CACHED_UNITS = 4 << 20  # characters of units whose ids are kept


class Pieces:
    """Encoder and decoder for one BPE model file without normalisation, with byte fallback."""

    def __init__(self, model_file: str) -> None:
        self.library = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (
            model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in usable}
        self.scores = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after a letter: units cannot be cut there")
        self.tokens = ahocorasick.Automaton()
        for piece in self.ids:
            self.tokens.add_word(piece, piece)
        self.tokens.make_automaton()
        alphabet = {c for p in self.ids for c in p}
        alone = "" if "\n" in alphabet else "\n"
        self.unit = re.compile(f"{alone}|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        # Longest piece for each ending of three characters (shorter ones have two at most), and
        # the next shorter piece that ends a piece (the automaton's suffix links).
        self.reach: dict[str, int] = {}
        for piece in self.ids:
            self.reach[piece[-3:]] = max(self.reach.get(piece[-3:], 2), len(piece))
        self.shorter = {p: next((p[k:] for k in range(1, len(p)) if p[k:] in self.ids), "") for p in self.ids}
        self.table: dict[str, tuple] = {}  # the last piece and the entry before it
        self.fits: dict[tuple[str, str], bool] = {}
        # Ids are kept as four bytes each, in the order of the machine.
        self.coded = {piece: i.to_bytes(4, sys.byteorder) for piece, i in self.ids.items()}
        self.coded_bytes = [i.to_bytes(4, sys.byteorder) for i in self.bytes]
        self.decimals = [str(i) for i in range(size)]
        self.solved = tries.Solved(self.unit_ids, CACHED_UNITS)

    def merged(self, text: str) -> list[str]:
        """The pieces after all merges, best score first, leftmost on ties. For short strings."""
        parts = list(text)
        scores = [self.scores.get(a + b, -inf) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > -inf:
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = self.scores.get(parts[at - 1] + parts[at], -inf)
            if at < len(scores):
                scores[at] = self.scores.get(parts[at] + parts[at + 1], -inf)
        return parts

    def compatible(self, before: str, token: str) -> bool:
        known = self.fits.get((before, token))
        if known is None:
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
            want = [before, token] if before else [token]
            known = self.fits[before, token] = self.merged(before + token) == want
        return known

    def last_token(self, prefix: str) -> tuple:
        """The last piece of a short prefix and the entry of the prefix before it, from the
        table that all units share.

        The longest piece that ends the prefix starts the walk along the automaton's suffix
        links, which lead to the shorter ones.
        """
        size, table, fits = len(prefix), self.table, self.fits
        piece = prefix[-1:]
        for length in range(min(size, self.reach.get(prefix[-3:], 2)), 1, -1):
            if prefix[size - length:] in self.ids:
                piece = prefix[size - length:]
                break
        while True:
            start = size - len(piece)
            if start:
                rest = prefix[:start]
                before = table.get(rest) or self.last_token(rest)
                pair = (before[0], piece)
            else:
                before, pair = None, ("", piece)
            known = fits.get(pair)
            if known or known is None and self.compatible(*pair):
                break
            if not (shorter := self.shorter.get(piece)):
                piece = prefix[-1:]  # outside the vocabulary: it stands alone
                before = (table.get(prefix[:-1]) or self.last_token(prefix[:-1])) if size > 1 else None
                break
            piece = shorter
        if len(table) >= CACHED_PREFIXES:
            table.clear()
        table[prefix] = found = (piece, before)
        return found

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit; characters outside the vocabulary stand alone."""
        pieces, end = [], len(unit)
        if end <= LONGEST_CACHED:
            entry = self.table.get(unit) or (self.last_token(unit) if unit else None)
            while entry:
                piece, entry = entry
                pieces.append(piece)
            return pieces[::-1]
        # A long unit has a table of its own, filled in one pass of the automaton.
        last = [""] * (end + 1)
        at = 0
        for place, piece in self.tokens.iter(unit):
            while at < place:  # places where no piece ends
                at += 1
                last[at] = last[at] or unit[at - 1]
            start = place + 1 - len(piece)
            if not last[place + 1] and self.compatible(last[start], piece):
                last[place + 1] = piece
        while end:
            piece = last[end] or unit[end - 1]
            pieces.append(piece)
            end -= len(piece)
        return pieces[::-1]

    def unit_ids(self, units: list[str]) -> Iterator[bytes]:
        """The ids of each unit. Sorted units find the prefixes of their neighbours in the table."""
        known, split = self.coded, self.split
        for unit in units:
            yield b"".join([known.get(p) or self._bytes_of(p) for p in split(unit)])

    def _bytes_of(self, piece: str) -> bytes:
        return b"".join([self.coded_bytes[b] for b in piece.encode("utf-8")])

    def cut(self, text: str) -> list[str]:
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """The ids of each text, also as decimal numbers joined by commas."""
        cuts = [self.cut(t) for t in texts]
        # Strings and tuples in tables make no cycles; looking for some among them costs a fifth of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            units = self.solved(cuts)
        finally:
            if collects:
                gc.enable()
        for cut in cuts:
            ids = array("I", b"".join(map(units.__getitem__, cut))).tolist()
            yield ids, ",".join(map(self.decimals.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the library gives them without begin and end ids."""
        return next(self.encode_all([text]))[0]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def load(model_file: str) -> Pieces:
    """One encoder per worker process and model."""
    return Pieces(model_file)


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array of ids per text. A null or empty text has none."""
    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType()))])
    place, names = docs.columns.index(text), schema.names

    def task(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = load(model_file)
        made = [ids for ids, _ in pieces.encode_all([t or "" for t in batch.column(place).to_pylist()])]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(made, pa.list_(pa.int32()))], names=names)

    return over_batches(docs, schema, task)


def decode(coded: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids. Null ids decode to the empty text."""
    schema = StructType([*coded.schema.fields, StructField(text, StringType())])
    place, names = coded.columns.index(ids), schema.names

    def task(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = load(model_file)
        made = [pieces.decode(x) if x else "" for x in batch.column(place).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=names)

    return over_batches(coded, schema, task)


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``.

    Encodes and decodes a text in one task, so ids do not leave it. Null and empty texts have
    no ids and decode to the empty text. Repeated rows get a row each; a null id stays null.
    A text of any length, with or without spaces, takes time and memory in proportion to it.
    An empty table gives no rows; other columns are ignored.
    """
    def task(batch: pa.RecordBatch) -> dict:
        pieces = load(model_file)
        counts, coded, decoded = [], [], []
        for ids, decimals in pieces.encode_all([t or "" for t in batch.column(1).to_pylist()]):
            counts.append(len(ids))
            coded.append(hashlib.sha256(decimals.encode()).hexdigest())
            decoded.append(hashlib.sha256(pieces.decode(ids).encode("utf-8", "replace")).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": coded, "decoded_sha256": decoded}

    return over_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", task)
