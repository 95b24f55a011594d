"""The state of stream detection without a stream: random batches and watermarks against plain loops."""

import random

import pandas as pd
import pytest

from palisade.streaming import detect

WIDTH = 10_000


class Value:
    def __init__(self):
        self.held = None

    exists = lambda self: self.held is not None
    get = lambda self: self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map:
    def __init__(self):
        self.held, self.reads, self.writes = {}, 0, 0

    def getValue(self, key):
        self.reads += 1
        return self.held[key]

    def updateValue(self, key, value):
        assert key not in self.held
        self.writes += 1
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Map())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value())

    def registerTimer(self, moment):
        self.timers.add(moment)


class Timer:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


class Group:
    """One group of an operator: rows go in, then the timers that are due run."""

    def __init__(self, key, processor):
        self.key, self.processor, self.handle = key, processor, Handle()
        processor.init(self.handle)

    def step(self, rows, now):
        out = []
        if len(rows):
            out += self.processor.handleInputRows(self.key, iter([rows]), Timer(now))
        for moment in sorted(t for t in self.handle.timers if t <= now):
            self.handle.timers.discard(moment)
            out += self.processor.handleExpiredTimer(self.key, Timer(now), None)
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame()


def batches(rows, seed, delay=5):
    """Rows in batches, out of order by less than the delay, and the watermark (in ms) each batch has."""
    rng = random.Random(seed)
    moved = sorted(rows, key=lambda r: r[0] + rng.randint(0, delay * 1000 - 1))
    newest, now, i = 0, 0, 0
    while i < len(moved):
        size = rng.choice([1, 5, 40])
        part = [r for r in moved[i:i + size] if r[0] > now * 1000]
        assert len(part) == len(moved[i:i + size]), "a row came late"
        yield pd.DataFrame(part, columns=["at", "value", "c"]), now
        newest, i = max(newest, *(r[0] for r in part)), i + size
        now = max(now, newest // 1000 - delay)
    for last in (newest // 1000 + 100, newest // 1000 + 10_000):
        yield pd.DataFrame([], columns=["at", "value", "c"]), last


def plain(rows, min_rows, min_distinct, tumbling, min_total=1, period=None):
    mine, out, i = sorted(rows, key=lambda r: r[0]), [], 0
    total = lambda t: sum(c for at, _, c in mine if at <= t and (period is None or at > t - period))
    while i < len(mine):
        inside = [r for r in mine[i:] if r[0] <= mine[i][0] + WIDTH]
        n, k = sum(r[2] for r in inside), len({r[1] for r in inside if r[1] is not None}) if min_distinct else 0
        reached = n >= min_rows and k >= min_distinct
        if reached:
            opened = mine[i][0]
            later = [t for t, _, _ in mine if t >= opened and (period is None or t <= opened + period)]
            if any(total(t) >= min_total for t in later):
                out.append((opened, inside[-1][0], n, k))
        i = i + len(inside) if reached or tumbling else next(
            (j for j in range(i, len(mine)) if mine[j][0] > mine[i][0]), len(mine))
    return sorted(out)


def series(seed, size=250, span=200_000, step=1000):
    """Instants on a grid, many of them on the edges of slots, with bursts and nulls."""
    rng = random.Random(seed)
    return [(rng.randint(1, span // step) * step + rng.choice([0, 0, 1]), rng.choice([None, *"abcdefgh"]), rng.randint(1, 3))
            for _ in range(size)]


def found(frames):
    rows = [tuple(int(v) for v in r[1:]) for f in frames if len(f) for r in f.itertuples(index=False)]
    return sorted(rows)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("tumbling", [False, True])
def test_windows(seed, tumbling):
    rows = series(seed, size=60 if seed % 2 else 300)
    group = Group(("k",), detect.Windows(WIDTH, 8, 4, tumbling))
    got = found([group.step(part, now) for part, now in batches(rows, seed)])
    assert got == plain(rows, 8, 4, tumbling)
    # Nothing is left of a key that has gone.
    assert not group.handle.states["parts"].held and not group.handle.states["index"].exists()


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("least, period", [(400, None), (120, 60_000), (90, 30_000), (60, 10_000)])
def test_least_total(seed, least, period):
    rows = series(seed, 250)
    group = Group(("k",), detect.Windows(WIDTH, 1, 5, False, least, period))
    got = []
    for part, now in batches(rows, seed):
        got.append(group.step(part, now))
        kept = group.handle.states["totals"].get() or ([], [], [])
        # The newest rows that make up the total, whatever the key had before.
        assert sum(kept[1][1:]) < least and len(kept[2]) <= least // 5 + 1
    assert found(got) == plain(rows, 1, 5, False, least, period)
    assert period is None or not group.handle.states["totals"].exists()


@pytest.mark.parametrize("seed", range(12))
def test_shards_add_up(seed):
    rows = series(seed, size=60 if seed % 2 else 300)
    shards = [Group(("k", i), detect.Shards(WIDTH)) for i in range(3)]
    target = Group(("k",), detect.Targets(WIDTH, 8, 4, True))
    got = []
    for part, now in batches(rows, seed):
        of = part["value"].map(lambda v: 0 if v is None else ord(v) % 3)
        points = [g.step(part[of == i], now) for i, g in enumerate(shards)]
        points = [p for p in points if len(p)]
        # What goes on is not late for the next operator.
        assert all((p["stamp"] > pd.Timestamp(now, unit="ms")).all() for p in points)
        got.append(target.step(pd.concat(points, ignore_index=True) if points else pd.DataFrame(), now))
    assert found(got) == plain(rows, 8, 4, True)
    for group in (*shards, target):
        assert not group.handle.states["parts"].held and not group.handle.states["index"].exists()


def test_work_follows_new_rows():
    """A key that never pauses: each part is written once and read a few times, however long it goes on."""
    reads = []
    for hours in (1, 4):
        group = Group(("k",), detect.Windows(WIDTH, 10 ** 9, 0, False))
        parts, most = 0, 0
        for i in range(hours * 400):
            at = [i * 2000 + j for j in range(0, 2000, 100)]
            group.step(pd.DataFrame({"at": [1 + a for a in at], "value": None, "c": 1}), max(0, (i * 2000) // 1000 - 5))
            parts, most = parts + 1, max(most, len(group.handle.states["parts"].held))
        state = group.handle.states["parts"]
        assert state.writes == parts and most <= 4 * WIDTH // 2000
        reads.append(state.reads / parts)
    assert max(reads) <= 4 and abs(reads[0] - reads[1]) < 0.5
