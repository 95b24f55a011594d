"""Greedy, data-dependent time windows as distributed jobs.

All four detectors place windows the same way. Per key, in time order, a window opens at
the first *candidate* instant and covers the next ``width`` microseconds, both ends
included; the next one opens at the first candidate after that cover. The detectors differ
only in what a candidate is: enough rows ahead (brute force), enough distinct ports ahead
(port scan), or every instant (floods).

The choice is sequential in time, so one busy key must not become one task. Time is cut
into slots of fixed length, much longer than a window:

* Rows are spread over (key, slot). Those near a slot's edge are copied to the neighbour,
  so each slot sees one width of time on both sides and counts exactly on its own.
* A slot whose first candidate has no candidate within one width before it restarts the
  chain and is solved alone. Nearly all slots of ordinary keys are such.
* Any other slot is *carried*: its first window depends on the last window before it. Such
  a slot offers, for each instant of its first width where a window may open, the place of
  its last window. Only these lines are brought together per key, and walked; the windows
  inside are then found in parallel, slot by slot.

The passes read rows sorted by (key, slot, instant) and hold the rows ahead, the last window, one
slot's offered lines, or the chains that are open at one time: what one window width of
one key holds, never a slot or a key. Where a chain is alone, a pass looks for its next window
by bisection and leaves the instants between alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from palisade.functions.times import HOUR, from_micros
from palisade.session import settle

WIDTHS_PER_SLOT = 16
# The side of a row that marks where the first window of a carried slot opens.
MARK = -2


@dataclass(frozen=True)
class Slots:
    """Window width and slot length, in microseconds."""

    width: int
    length: int

    @classmethod
    def of(cls, width: int, length: int | None = None) -> Slots:
        if width < 0:
            raise ValueError("the window width must not be negative")
        if length is None:
            length = max(WIDTHS_PER_SLOT * width, HOUR)
        if length < max(width, 1):
            raise ValueError("a slot must be at least as long as a window")
        return cls(width, length)


def spread(nodes: DataFrame, slots: Slots) -> DataFrame:
    """Assign rows (with ``at`` in microseconds) to slots, copying edges to neighbours.

    ``side`` is 0 in the row's own slot, 1 for a copy that lies after the slot it was
    copied to, and -1 for one that lies before it.
    """
    within = F.expr(f"pmod(at, {slots.length}L)")
    slot = F.expr(f"(at - pmod(at, {slots.length}L)) div {slots.length}L")
    place = lambda step, side: F.struct((slot + step).alias("slot"), F.lit(side).alias("side"))
    places = F.array_compact(F.array(
        place(0, 0),
        F.when(within < slots.width, place(-1, 1)),
        F.when(within >= slots.length - slots.width, place(1, -1)),
    ))
    return nodes.select("*", F.inline(places))


def ahead_counts(nodes: DataFrame, keys: Sequence[str], slots: Slots) -> DataFrame:
    """For each instant: rows within one width ahead, and the last instant among them.

    ``nodes`` has the keys, ``at`` and the row count ``c``, one row per key and instant.
    Both frames start at the slot's edge and only grow, which Spark updates row by row; a
    frame that slides would be summed anew for every row.
    """
    # The slot first: its numbers tell rows apart faster than keys that begin alike.
    order = Window.partitionBy("slot", *keys).orderBy("at")
    reach = order.rangeBetween(Window.unboundedPreceding, slots.width)
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    return (
        spread(nodes, slots)
        .withColumn("n", F.sum("c").over(reach) - F.coalesce(F.sum("c").over(before), F.lit(0)))
        .withColumn("until", F.max("at").over(reach))
        .where(F.col("side") <= 0)
    )


def ahead_distinct(nodes: DataFrame, keys: Sequence[str], value: str, slots: Slots, least: int = 0) -> DataFrame:
    """Like ``ahead_counts``, with ``k``: the distinct non-null values within one width ahead.

    Instants with fewer than ``least`` such values are left out. One pass over the rows of a
    slot in time order is enough; it holds the rows within one width.
    """
    chunk, n, width = [*keys, "slot"], len(keys) + 1, slots.width
    rows = spread(nodes, slots).select(*chunk, "at", "side", "c", value)
    out = StructType([*(rows.schema[c] for c in chunk), StructField("at", LongType()), StructField("side", IntegerType()),
                      *(StructField(c, LongType()) for c in ("k", "n", "until"))])
    arrow = to_arrow_schema(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scan = None, Ahead(width, least)
        for batch in batches:
            found, owners, lengths = [], [], []

            def leave() -> None:
                if now is not None:
                    scan.leave(None, found)
                    owners.append(now)
                    lengths.append(len(found))

            at, side, c = _integers(batch, n, n + 3)
            values = batch.columns[n + 3].to_pylist()
            for lo, hi in _runs(batch, n):
                key = _key(batch, n, lo)
                if key != now:
                    leave()
                    now, scan = key, Ahead(width, least)
                scan.feed(at, side, c, values, lo, hi, found)
            owners.append(now)
            lengths.append(len(found))
            yield from _owned(found, owners, lengths, arrow)
        found = []
        scan.leave(None, found)
        yield from _owned(found, [now], [len(found)], arrow)

    return _by_slot(rows, keys, "at").mapInArrow(count, out)


class Ahead:
    """For the instants of one slot, met in time order: the distinct values, the rows and the
    last instant within one width ahead. Holds the rows of one width."""

    def __init__(self, width: int, least: int) -> None:
        self.width, self.least, self.rows = width, least, 0
        self.held: deque[tuple] = deque()
        self.places: dict = {}

    def feed(self, at: Sequence[int], side: Sequence[int], c: Sequence[int], value: Sequence, lo: int, hi: int,
             found: list[tuple]) -> None:
        """Takes the rows from ``lo`` to ``hi``; adds the instants whose width ends before a row
        to ``found``, as (at, side, k, n, until)."""
        held, places, width = self.held, self.places, self.width
        for i in range(lo, hi):
            if held and held[0][0] < at[i] - width:
                self.leave(at[i] - width, found)
            if not held and side[i] > 0:
                # Nothing after the slot counts once its own rows have left.
                return
            held.append((at[i], side[i], c[i], value[i]))
            self.rows += c[i]
            if value[i] is not None:
                places[value[i]] = places.get(value[i], 0) + 1

    def leave(self, end: int | None, found: list[tuple]) -> None:
        """Adds the held instants before ``end`` to ``found``, and lets them go."""
        held, places = self.held, self.places
        while held and (end is None or held[0][0] < end):
            at, side = held[0][:2]
            if side > 0:
                held.clear()
                places.clear()
                self.rows = 0
                return
            if len(places) >= self.least:
                found.append((at, side, len(places), self.rows, held[-1][0]))
            while held and held[0][0] == at:
                _, _, c, value = held.popleft()
                self.rows -= c
                if value is not None:
                    places[value] -= 1
                    if not places[value]:
                        del places[value]


def greedy_windows(
    candidates: DataFrame,
    keys: Sequence[str],
    slots: Slots,
    payload: Sequence[str] = (),
) -> DataFrame:
    """Choose windows among candidate instants: one row per window with ``at`` and payload.

    ``candidates`` comes from ``ahead_counts`` or ``ahead_distinct``, filtered by the
    detector; ``side`` must be 0 or -1. Keys must not be null. Candidates are written once,
    since two passes read them.
    """
    chunk = [*keys, "slot"]
    rows = settle(candidates.select(*chunk, "at", "side", *payload), "window-candidates")
    opens = _entries(rows, keys, slots)
    marks = opens.select(*chunk, F.col("entry").alias("at"), F.lit(MARK).alias("side"),
                         *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in payload])
    width, n = slots.width, len(keys)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scan = None, None
        for batch in batches:
            taken = []
            at, side = _integers(batch, n + 1, n + 3)
            for lo, hi in _runs(batch, n + 1):
                key = _key(batch, n + 1, lo)
                if key != now:
                    now, scan = key, Choice(width)
                taken.extend(scan.taken(at, side, lo, hi))
            if taken:
                yield batch.take(pa.array(taken))

    return _by_slot(rows.unionByName(marks), keys, "at", "side").mapInArrow(choose, rows.schema).drop("slot", "side")


class Choice:
    """The windows of one slot, met in time order: holds the last one only."""

    def __init__(self, width: int) -> None:
        self.width, self.before, self.free, self.met, self.marked = width, None, None, False, None

    def taken(self, at: Sequence[int], side: Sequence[int], lo: int, hi: int) -> Iterator[int]:
        """The rows from ``lo`` to ``hi`` at which a window opens."""
        while lo < hi:
            if self.free is not None:
                lo = bisect_left(at, self.free, lo, hi)
                if lo < hi and side[lo] == 0:
                    yield lo
                    self.free = at[lo] + self.width + 1
            elif side[lo] == MARK:
                self.marked = at[lo]
            elif side[lo] < 0:
                self.before = at[lo]
            else:
                # A carried slot waits for the mark at its first window.
                carried = self.met or (self.before is not None and self.before >= at[lo] - self.width)
                self.met = True
                if not carried or self.marked == at[lo]:
                    self.free = at[lo]
                    continue
            lo += 1


def _entries(rows: DataFrame, keys: Sequence[str], slots: Slots) -> DataFrame:
    """The instant at which the first window of each carried slot opens: keys, slot, ``entry``."""
    chunk, n, width, length = [*keys, "slot"], len(keys), slots.width, slots.length
    kept = StructType([rows.schema[c] for c in chunk])
    routes = StructType([*kept.fields, StructField("carried", BooleanType()), StructField("entry", LongType()),
                         StructField("exit", LongType())])

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scan = None, None
        for batch in batches:
            done = []
            at, side = _integers(batch, n + 1, n + 3)
            for lo, hi in _runs(batch, n + 1):
                key = _key(batch, n + 1, lo)
                if key != now:
                    if scan is not None:
                        done += [(*now, *r) for r in scan.routes()]
                    now, scan = key, Routes(key[-1] * length, width, length)
                scan.feed(at, side, lo, hi)
            yield from _batch(done, routes)
        if scan is not None:
            yield from _batch([(*now, *r) for r in scan.routes()], routes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slot, last, hit = None, None, None, False
        for batch in batches:
            found = []
            for *key, number, carried, entry, leaves in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    now, slot, last = key, None, None
                if number != slot:
                    slot, hit = number, False
                if hit:
                    continue
                if not carried:
                    last, hit = leaves, True
                elif last is not None and entry > last + width:
                    found.append((*key, number, entry))
                    last, hit = leaves, True
            yield from _batch(found, out)

    out = StructType([*kept.fields, StructField("entry", LongType())])
    offered = _by_slot(rows.select(*chunk, "at", "side"), keys, "at").mapInArrow(offer, routes)
    return offered.repartition(*keys).sortWithinPartitions(*chunk, "entry").mapInArrow(walk, out)


class Routes:
    """For one slot: where its last window opens, for each place where the first may open.

    Instants come in time order. The chain of windows from each entry is at one place at a
    time; chains that meet go on as one, so no more are held than entries exist, and these lie
    in the first width of the slot.
    """

    def __init__(self, start: int, width: int, length: int) -> None:
        self.start, self.width, self.end = start, width, start + length
        self.before = self.carried = None
        self.entries: list[int] = []
        self.parent: list[int] = []
        self.exit: list[int] = []
        self.open: deque[tuple[int, int]] = deque()
        self.late = False

    def _root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def add(self, at: int, side: int) -> None:
        if side < 0:
            self.before = at
            return
        if self.carried is None:
            self.carried = self.before is not None and self.before >= at - self.width
            entry = True
        else:
            # The first instant beyond the first width may still be the first window.
            entry = self.carried and not self.late
        self.late = self.late or at > self.start + self.width
        landed = None
        while self.open and self.open[0][0] + self.width < at:
            root = self._root(self.open.popleft()[1])
            if landed is None:
                landed = root
            elif root != landed:
                self.parent[root] = landed
        if entry:
            own = len(self.parent)
            self.entries.append(at)
            self.parent.append(own if landed is None else landed)
            self.exit.append(at)
            landed = own if landed is None else landed
        if landed is not None:
            self.exit[landed] = at
            self.open.append((at, landed))
        self.last = at

    def feed(self, at: Sequence[int], side: Sequence[int], lo: int, hi: int) -> None:
        """``add`` for the rows from ``lo`` to ``hi``. A slot that is not carried has one chain."""
        while lo < hi and self.carried is not False:
            self.add(at[lo], side[lo])
            lo += 1
        if lo < hi:
            self.last = at[hi - 1]
            while (lo := bisect_left(at, self.exit[0] + self.width + 1, lo, hi)) < hi:
                self.exit[0] = at[lo]

    def routes(self) -> Iterator[tuple[bool, int, int]]:
        """``carried, entry, exit``, for slots that hang on another or may reach into the next."""
        if self.carried is None or not (self.carried or self.last + self.width >= self.end):
            return
        for k, entry in enumerate(self.entries):
            yield self.carried, entry, self.exit[self._root(k)]


def _by_slot(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The rows of each (key, slot) together and in order."""
    return rows.repartition(*keys, "slot").sortWithinPartitions("slot", *keys, *order)


def _runs(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of rows that agree in the first ``n`` columns."""
    changed = np.zeros(max(batch.num_rows - 1, 0), bool)
    for column in batch.columns[:n]:
        here, there = column.slice(1), column.slice(0, len(changed))
        differs = pc.coalesce(pc.not_equal(here, there), pc.xor(pc.is_null(here), pc.is_null(there)))
        changed |= differs.to_numpy(zero_copy_only=False)
    begins = [0, *(np.flatnonzero(changed) + 1).tolist()] if batch.num_rows else []
    return zip(begins, [*begins[1:], batch.num_rows])


def _key(batch: pa.RecordBatch, n: int, row: int) -> list:
    return [c[row].as_py() for c in batch.columns[:n]]


def _integers(batch: pa.RecordBatch, first: int, end: int) -> list[list[int]]:
    return [c.to_numpy().tolist() for c in batch.columns[first:end]]


def _owned(rows: list[tuple], owners: list[list], ends: list[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows behind the keys of their owners, the first of which owns the rows up to the first end."""
    if rows:
        owner = pa.array(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)))
        types = [f.type for f in schema]
        keys = [pa.array(c, t).take(owner) for c, t in zip(zip(*owners), types)]
        yield pa.RecordBatch.from_arrays(
            [*keys, *(pa.array(c, t) for c, t in zip(zip(*rows), types[len(keys):]))], schema=schema)


def _batch(rows: list[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    if rows:
        arrow = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def in_windows(
    rows: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    slots: Slots,
) -> DataFrame:
    """Join rows (with ``at``) to the window of their key that covers them.

    Windows carry ``opened`` (microseconds). Time is cut into cells of one width: a window
    touches two cells and a cell meets at most two windows of a key, so the join is an
    equality on (key, cell) with at most two pairs per row, and a busy key is spread over
    its cells.
    """
    cell = max(slots.width, 1)
    of = lambda c: f"({c} - pmod({c}, {cell}L)) div {cell}L"
    opened = windows.withColumn("cell", F.explode(F.array_distinct(F.array(
        F.expr(of("opened")), F.expr(of(f"(opened + {slots.width}L)"))))))
    joined = rows.withColumn("cell", F.expr(of("at"))).join(opened, [*keys, "cell"])
    covered = (F.col("at") >= F.col("opened")) & (F.col("at") <= F.col("opened") + slots.width)
    return joined.where(covered).drop("cell")


def with_bounds(windows: DataFrame, end: str = "until") -> DataFrame:
    """Replace the microsecond columns ``at`` and ``end`` by timestamps."""
    rest = [c for c in windows.columns if c not in ("at", end)]
    return windows.select(
        *rest, from_micros("at").alias("window_start"), from_micros(end).alias("window_end"))
