"""Streaming detection.

Window choice restarts after a gap longer than one window, so a stream can be cut there:
rows of a key are gathered into sessions that end one window after their last row, and each
closed session can be searched on its own.

A source that never pauses grows one session without end, so detection itself does not wait
for sessions to close: ``detect_stream`` searches by event time and keeps, per key, only the
instants that can still decide a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palisade.functions.times import MINUTE, from_micros, micros
from palisade.operators.brute_force import EVENT
from palisade.operators.port_scan import LOOKBACK_HOURS
from palisade.operators.reputation import enrich
from palisade.streaming.stats import in_event_time


def sessions(logs: DataFrame, keys: list[str], width_micros: int, delay: str) -> DataFrame:
    """Gap sessions per key: a session closes when nothing came for more than one window.

    Its windows are then final. The gap is one microsecond longer than a window, since a
    window includes its end.
    """
    return (
        in_event_time(logs, delay)
        .groupBy(*keys, F.session_window("timestamp", f"{width_micros + 1} microseconds"))
        .agg(F.count("*").alias("rows"), F.min("timestamp").cast("timestamp_ntz").alias("first"),
             F.max("timestamp").cast("timestamp_ntz").alias("last"))
        .drop("session_window")
    )


# --- detection with bounded state --------------------------------------------------------

_OUT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("opened", T.LongType()),
    T.StructField("until", T.LongType()), T.StructField("rows", T.LongType()),
    T.StructField("distinct", T.LongType()),
])
_POINTS = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("stamp", T.TimestampType()),
    T.StructField("at", T.LongType()), T.StructField("c", T.LongType()), T.StructField("d", T.LongType()),
])
_COUNTED = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("at", T.LongType()), T.StructField("value", T.StringType()), T.StructField("c", T.LongType()),
])
_BLOB = T.StructType([T.StructField("rows", T.BinaryType())])
_PART = T.StructType([T.StructField("number", T.LongType())])
_INDEX = T.StructType([
    T.StructField("number", T.ArrayType(T.LongType())), T.StructField("first", T.ArrayType(T.LongType())),
    T.StructField("last", T.ArrayType(T.LongType())), T.StructField("next", T.LongType()),
    T.StructField("decided", T.LongType()), T.StructField("base", T.LongType()), T.StructField("due", T.LongType()),
])
_TOTALS = T.StructType([
    T.StructField("at", T.ArrayType(T.LongType())), T.StructField("c", T.ArrayType(T.LongType())),
    T.StructField("waiting", T.ArrayType(T.ArrayType(T.LongType()))),
])
NEVER = -(2 ** 62)
TARGET_SHARDS = 32


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count equal rows before the shuffle, so that a busy key sends instants, not rows."""
    for batch in batches:
        columns = batch.schema.names
        counted = pa.Table.from_batches([batch]).group_by(columns).aggregate([([], "count_all")])
        yield from counted.rename_columns([*columns, "c"]).to_batches()


class Parts:
    """The rows of one key, in the parts they came in.

    A batch adds one part and rewrites none; a part goes when all its rows are decided. What
    is rewritten is the list of parts, with the first and last instant of each.
    """

    def __init__(self, handle: StatefulProcessorHandle, columns: pa.Schema):
        self.columns = columns
        self.parts = handle.getMapState("parts", _PART, _BLOB)
        self.index = handle.getValueState("index", _INDEX)

    def load(self) -> dict:
        kept = self.index.get() if self.index.exists() else ([], [], [], 0, NEVER, 0, NEVER)
        return {n: list(v) if isinstance(v, (list, tuple)) else v for n, v in zip(_INDEX.names, kept)}

    def save(self, index: dict) -> None:
        self.index.update(tuple(index[n] for n in _INDEX.names))

    def add(self, index: dict, rows: pd.DataFrame) -> None:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(rows, schema=self.columns, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.parts.updateValue((index["next"],), (sink.getvalue().to_pybytes(),))
        index["number"].append(index["next"])
        index["first"].append(int(rows["at"].min()))
        index["last"].append(int(rows["at"].max()))
        index["next"] += 1

    def between(self, index: dict, low: int, high: int) -> pd.DataFrame:
        """Rows after ``low`` and before ``high``; only parts that can have some are read."""
        blobs = [self.parts.getValue((n,))[0] for n, a, b in zip(index["number"], index["first"], index["last"])
                 if b > low and a < high]
        tables = [pa.ipc.open_stream(bytes(b)).read_all() for b in blobs]
        rows = pa.concat_tables(tables or [self.columns.empty_table()]).to_pandas()
        return rows[(rows["at"] > low) & (rows["at"] < high)].sort_values("at", kind="stable", ignore_index=True)

    def forget(self, index: dict, until: int) -> None:
        """Drop the parts without a row after ``until``."""
        gone = [i for i, last in enumerate(index["last"]) if last <= until]
        for i in reversed(gone):
            self.parts.removeKey((index["number"][i],))
            for name in ("number", "first", "last"):
                del index[name][i]


class Deciding(StatefulProcessor):
    """Rows are gathered per key, and decided once per slot of one window width.

    A slot waits for ``ahead`` slots of final rows. A row is written once, and read once per
    slot that passes while it is undecided, which is what the window and the delay hold, so
    work follows the new rows and not what the key has in state.
    """

    columns: pa.Schema
    ahead: int
    behind = 0

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.store = handle, Parts(handle, self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([r[self.columns.names] for r in rows], ignore_index=True)
        index = self.store.load()
        fresh = self.before_adding(index, fresh)
        if len(fresh):
            self.store.add(index, fresh)
            self._wake(index, int(fresh["at"].min()), timerValues)
        self.store.save(index)
        return iter(())

    def before_adding(self, index: dict, fresh: pd.DataFrame) -> pd.DataFrame:
        return fresh

    def _wake(self, index: dict, earliest: int, timer_values) -> None:
        due = max((earliest // self.width + self.ahead) * self.width // 1000 + 1, timer_values.getCurrentWatermarkInMs() + 1)
        if index["due"] == NEVER or due < index["due"]:
            self.handle.registerTimer(due)
            index["due"] = due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        index, now = self.store.load(), timerValues.getCurrentWatermarkInMs()
        # Rows before this are final, and so is all that opens before it.
        bound = (now * 1000 // self.width - self.ahead + 1) * self.width
        if index["due"] > now:
            return
        index["due"] = NEVER
        made = self.decide(key, index, bound, now) if bound > index["decided"] + 1 else None
        self.store.forget(index, index["decided"] - self.behind)
        undecided = [max(first, index["decided"] + 1) for first, last in zip(index["first"], index["last"]) if last > index["decided"]]
        if undecided:
            self._wake(index, min(undecided), timerValues)
        elif index["number"]:
            # Only rows that were kept for what may follow: they go when they are out of reach.
            self._wake(index, max(index["last"]) + self.behind, timerValues)
        if self.keeps(index):
            self.store.save(index)
        else:
            self.store.index.clear()
        if made is not None and len(made):
            yield made

    def keeps(self, index: dict) -> bool:
        return bool(index["number"])

    def decide(self, key, index: dict, bound: int, now: int) -> pd.DataFrame | None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _starts(rows: pd.DataFrame, width: int) -> np.ndarray:
    """For each row with a value, the first instant from which a window sees it as the first of its value."""
    before = rows.groupby("value", sort=False)["at"].shift(1, fill_value=NEVER).to_numpy()
    return np.maximum(before + 1, rows["at"].to_numpy() - width)


class Windows(Deciding):
    """Windows of one key, from its rows. With ``min_total``, a window is held back until its
    key has that many rows within ``period`` (None: at all), and forgotten when it cannot any more."""

    columns = pa.schema([("at", pa.int64()), ("value", pa.string()), ("c", pa.int64())])
    ahead = 2

    def __init__(self, width: int, min_rows: int, min_distinct: int, tumbling: bool, min_total: int = 1, period: int | None = None):
        super().__init__(width)
        self.min_rows, self.min_distinct, self.tumbling = min_rows, min_distinct, tumbling
        self.min_total, self.period = min_total, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", _TOTALS)

    def measure(self, index: dict, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Instants, their rows, and the distinct values from each of them to a width later."""
        at = rows["at"].to_numpy()
        instants, place = np.unique(at, return_inverse=True)
        counts = np.bincount(place, rows["c"].to_numpy(), len(instants)).astype(np.int64)
        if not self.min_distinct:
            return instants, counts, np.zeros(len(instants), dtype=np.int64)
        valued = rows[rows["value"].notna()]
        begins, ends = np.sort(_starts(valued, self.width)), np.sort(valued["at"].to_numpy())
        return instants, counts, np.searchsorted(begins, instants, "right") - np.searchsorted(ends, instants, "left")

    def decide(self, key, index: dict, bound: int, now: int) -> pd.DataFrame | None:
        rows = self.store.between(index, index["decided"], bound + self.width)
        instants, counts, distinct = self.measure(index, rows)
        found, free = self._choose(instants, counts, distinct, bound)
        until = max(bound - 1, free)
        found = self._release(found, instants[instants <= until], counts[instants <= until], until)
        self.pass_over(index, rows, until)
        index["decided"] = until
        return pd.DataFrame([(key[0], *w) for w in found], columns=_OUT.names) if found else None

    def pass_over(self, index: dict, rows: pd.DataFrame, until: int) -> None:
        """Called with the rows up to ``until`` before they go."""

    def _choose(self, instants, counts, distinct, bound: int) -> tuple[list[tuple[int, int, int, int]], int]:
        """Windows that open before ``bound``, and the end of the last; a step per window, not per instant."""
        sums = np.concatenate([[0], np.cumsum(counts)])
        after = np.searchsorted(instants, instants + self.width, "right")
        rows = sums[after] - sums[:-1]
        reached = (rows >= self.min_rows) & (distinct >= self.min_distinct)
        openers = np.flatnonzero((instants < bound) & (reached | self.tumbling))
        found, free, i = [], NEVER, 0
        while (place := np.searchsorted(openers, i)) < len(openers):
            opener = openers[place]
            i, free = int(after[opener]), int(instants[opener]) + self.width
            if reached[opener]:
                found.append((int(instants[opener]), int(instants[i - 1]), int(rows[opener]), int(distinct[opener])))
        return found, free

    def _release(self, found: list, instants: np.ndarray, counts: np.ndarray, until: int) -> list:
        """The windows whose key has enough rows by now. Kept are the newest rows that make up the
        total and the windows before it is reached: less than ``min_total`` rows, whatever the key has."""
        if self.min_total <= 1:
            return found
        at, c, waiting = self.totals.get() if self.totals.exists() else ([], [], [])
        period = 2 ** 61 if self.period is None else self.period
        at, c = np.concatenate([np.array(at, dtype=np.int64), instants]), np.concatenate([np.array(c, dtype=np.int64), counts])
        sums = np.concatenate([[0], np.cumsum(c)])
        enough = at[sums[1:] - sums[np.searchsorted(at, at - period, "right")] >= self.min_total]
        released, held = [], []
        for window in [tuple(w) for w in waiting] + found:
            place = np.searchsorted(enough, window[0])
            if place < len(enough) and enough[place] <= window[0] + period:
                released.append(window)
            elif window[0] + period > until:
                held.append(window)
        # What is left makes up the total by itself, or is all there is.
        spare = (sums[-1] - sums[1:] >= self.min_total) | (at <= until - period)
        left = ~spare
        if left.any() or held:
            self.totals.update((at[left].tolist(), c[left].tolist(), [list(w) for w in held]))
            if self.period is not None and left.any():
                self.handle.registerTimer((int(at[left][-1]) + period + self.width) // 1000 + 1)
        elif self.totals.exists():
            self.totals.clear()
        return released

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        # A key that went silent: nothing may be left that a later row could complete.
        if self.min_total > 1 and self.period is not None and self.totals.exists():
            at, _, _ = self.totals.get()
            if not at or at[-1] + self.period < timerValues.getCurrentWatermarkInMs() * 1000:
                self.totals.clear()


class Shards(Deciding):
    """One shard of the values of a key: what its rows add to each instant of the key.

    A value is in one shard, so distinct values add up. A row with a value adds one (``d``) from the instant
    its value is not seen before, at most a width back, and takes it away after its own.
    """

    columns = Windows.columns
    ahead = 1

    def __init__(self, width: int):
        super().__init__(width)
        # Rows that went out stay for one width: they say what is not new.
        self.behind = width + 1

    def decide(self, key, index: dict, bound: int, now: int) -> pd.DataFrame | None:
        rows = self.store.between(index, index["decided"] - self.behind, bound)
        fresh = (rows["at"] > index["decided"]).to_numpy()
        index["decided"] = bound - 1
        valued = rows["value"].notna().to_numpy()
        begins = pd.DataFrame({"at": _starts(rows[valued], self.width), "c": 0, "d": 1})[fresh[valued]]
        own = rows[fresh]
        ends = pd.DataFrame({"at": own["at"][valued[fresh]] + 1, "c": 0, "d": -1})
        points = pd.concat([begins, ends, pd.DataFrame({"at": own["at"], "c": own["c"], "d": 0})], ignore_index=True)
        points = points.groupby("at", as_index=False)[["c", "d"]].sum()
        # Not late for the next operator, whatever the instants are.
        points.insert(0, "stamp", pd.Timestamp(now + 1, unit="ms"))
        points.insert(0, "key", pd.Series([key[0]] * len(points), dtype=object))
        return points[_POINTS.names]


class Targets(Windows):
    """Windows of one key, from the points of all its shards."""

    columns = pa.schema([("at", pa.int64()), ("c", pa.int64()), ("d", pa.int64())])

    def before_adding(self, index: dict, fresh: pd.DataFrame) -> pd.DataFrame:
        # Begins a width back may lie before what is decided: they count from there on.
        known = (fresh["at"] <= index["decided"]).to_numpy()
        index["base"] += int(fresh["d"][known].sum())
        return fresh[~known].groupby("at", as_index=False)[["c", "d"]].sum()

    def measure(self, index: dict, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = rows.groupby("at")[["c", "d"]].sum()
        distinct = index["base"] + points["d"].cumsum().to_numpy()
        rowed = points["c"].to_numpy() > 0
        return points.index.to_numpy()[rowed], points["c"].to_numpy()[rowed], distinct[rowed]

    def pass_over(self, index: dict, rows: pd.DataFrame, until: int) -> None:
        index["base"] += int(rows["d"][rows["at"] <= until].sum())

    def keeps(self, index: dict) -> bool:
        return bool(index["number"]) or index["base"] != 0


def _state_in_rocksdb(spark) -> None:
    """``transformWithState`` needs this store, and commits faster with logs of changes. A query that
    already has a checkpoint keeps its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def detect_stream(
    rows: DataFrame,
    key: str,
    width_micros: int,
    delay: str,
    *,
    min_rows: int = 1,
    min_distinct: int = 0,
    tumbling: bool = False,
    min_total: int = 1,
    period_micros: int | None = None,
    shards: int = 1,
) -> DataFrame:
    """Windows of a stream with ``timestamp``, a text ``key`` and a text ``value`` (may be null).

    A window opens at the first instant with at least ``min_rows`` rows and
    ``min_distinct`` distinct values ahead of it. With ``tumbling`` it opens at every free
    instant, and only windows that reach the bounds are reported. Time is cut into slots of one
    width; the instants of a slot are decided together, once the watermark has passed the slot
    after it. What lies before is then forgotten, so the state of a key covers two windows and
    the delay, however long the key stays active.

    With ``min_total`` a window is reported once its key has that many rows within ``period_micros`` of
    its opening. With ``shards`` the rows of a key are spread over that many groups by value, and only
    sums per instant come together: a key that a third of the stream goes to is then not one task.
    """
    _state_in_rocksdb(rows.sparkSession)
    named = rows.select(F.col(key).alias("key"), F.col("timestamp").cast("timestamp").alias("timestamp"),
                        micros("timestamp").alias("at"), "value")
    counted = named.mapInArrow(_combine, _COUNTED).withWatermark("timestamp", delay)
    if shards == 1:
        return counted.groupBy("key").transformWithStateInPandas(
            Windows(width_micros, min_rows, min_distinct, tumbling, min_total, period_micros), _OUT, "Append", "EventTime")
    spread = counted.withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(shards)))
    points = spread.groupBy("key", "shard").transformWithStateInPandas(
        Shards(width_micros), _POINTS, "Append", "EventTime", eventTimeColumnName="stamp")
    return points.groupBy("key").transformWithStateInPandas(
        Targets(width_micros, min_rows, min_distinct, tumbling, min_total, period_micros), _OUT, "Append", "EventTime")


def brute_force_stream(logs: DataFrame, window_minutes: int = 15, threshold: int = 5, delay: str = "1 minute") -> DataFrame:
    """Brute-force windows of a log stream."""
    failed = logs.where((F.col("event_type") == EVENT) & F.col("source_ip").isNotNull())
    found = detect_stream(failed.withColumn("value", F.lit(None).cast("string")), "source_ip",
                          window_minutes * MINUTE, delay, min_rows=threshold)
    return _named(found, "source_ip").select("source_ip", "attempt_count", "window_start", "window_end")


def port_scan_stream(
    logs: DataFrame, window_minutes: int = 10, unique_ports_threshold: int = 10, delay: str = "1 minute",
    min_total_attempts: int = 1, period_hours: int | None = LOOKBACK_HOURS,
) -> DataFrame:
    """Port-scan windows of a log stream.

    A window is reported once its source has ``min_total_attempts`` rows within ``period_hours``
    of its opening (None: at any time, as the batch form counts over its whole range).
    """
    ported = logs.where((F.col("source_ip") != "") & F.col("destination_port").isNotNull())
    named = ported.withColumn("value", F.col("destination_port").cast("string"))
    found = detect_stream(
        named, "source_ip", window_minutes * MINUTE, delay, min_distinct=unique_ports_threshold,
        min_total=min_total_attempts, period_micros=None if period_hours is None else period_hours * 60 * MINUTE)
    return _named(found, "source_ip").select(
        "source_ip", "attempt_count", F.col("distinct").alias("unique_ports"), "window_start", "window_end")


def single_flood_stream(logs: DataFrame, window_seconds: int = 60, single_ip_threshold: int = 100, delay: str = "1 minute") -> DataFrame:
    """Flood windows of single sources in a log stream; a window ends with its last row."""
    named = logs.where(F.col("source_ip") != "").withColumn("value", F.lit(None).cast("string"))
    found = detect_stream(named, "source_ip", window_seconds * 1_000_000, delay,
                          min_rows=single_ip_threshold, tumbling=True)
    return _named(found, "source_ip").select(
        "source_ip", F.col("attempt_count").alias("request_count"), "window_start", "window_end")


def distributed_flood_stream(
    logs: DataFrame, window_seconds: int = 60, distributed_ip_count: int = 10,
    distributed_request_threshold: int = 500, delay: str = "1 minute", shards: int = TARGET_SHARDS,
) -> DataFrame:
    """Flood windows of (port, protocol) targets in a log stream; the sources of a target are spread over ``shards``."""
    target = F.to_json(F.struct("destination_port", "protocol"))
    named = logs.withColumn("target", target).withColumn("value", F.nullif("source_ip", F.lit("")))
    found = detect_stream(named, "target", window_seconds * 1_000_000, delay, min_rows=distributed_request_threshold,
                          min_distinct=distributed_ip_count, tumbling=True, shards=shards)
    return _named(found, "target").select(
        F.get_json_object("target", "$.destination_port").cast("int").alias("target_port"),
        F.get_json_object("target", "$.protocol").alias("target_protocol"),
        F.col("attempt_count").alias("request_count"), F.col("distinct").alias("unique_ip_count"),
        "window_start", "window_end")


def _named(found: DataFrame, key: str) -> DataFrame:
    return found.select(
        F.col("key").alias(key), F.col("rows").alias("attempt_count"), "distinct",
        from_micros("opened").alias("window_start"), from_micros("until").alias("window_end"))


# --- alerts and enrichment ----------------------------------------------------------------


def enrich_stream(rows: DataFrame, reputation: DataFrame) -> DataFrame:
    """Attach reputation to a stream; the reputation table is read anew for every batch."""
    return enrich(rows, reputation)


def alert_feed(windows: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str,
               trigger: dict | None = None) -> StreamingQuery:
    """Hand the windows found in each batch to ``publish(frame, batch_number)``.

    A batch may be handed over again after a failure: publish by batch number.
    """
    writer = windows.writeStream.outputMode("append").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
