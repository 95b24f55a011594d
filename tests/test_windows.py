"""The distributed window choice against plain loops on random series."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palisade.operators.windows import Slots, ahead_counts, ahead_distinct, greedy_windows, in_windows


def loop(times, width, qualifies):
    """The definition, one key at a time: (start, end, rows) of each window."""
    rows, out, i = sorted(times), [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] <= rows[i][0] + width:
            j += 1
        if qualifies(rows[i:j]):
            out.append((rows[i][0], rows[j - 1][0], j - i))
            i = j
        else:
            i += 1
    return out


def series(seed, keys=40, span=900, rows=60):
    rng = random.Random(seed)
    data = defaultdict(list)
    for key in range(keys):
        dense = rng.choice([1, 3, 10])
        for _ in range(rng.randint(1, rows * dense)):
            data[f"k{key}"].append((rng.randint(0, span), rng.choice([None, *range(9)])))
    return data


def frame(spark, data):
    rows = [(k, t, p) for k, points in data.items() for t, p in points]
    return spark.createDataFrame(rows, "key string, at bigint, port int")


CASES = [(10, 3, 16), (40, 6, 50), (40, 2, 640), (0, 2, 7), (7, 1, 7), (13, 4, 900), (100, 12, 100)]


@pytest.mark.parametrize("width,threshold,length", CASES)
def test_count_windows_equal_loop(spark, width, threshold, length):
    data = series(width + threshold)
    slots = Slots.of(width, length)
    nodes = frame(spark, data).groupBy("key", "at").agg(F.count("*").alias("c"))
    found = greedy_windows(
        ahead_counts(nodes, ["key"], slots).where(F.col("n") >= threshold), ["key"], slots, ["n", "until"])
    got = sorted((r.key, r["at"], r.until, r.n) for r in found.collect())
    want = sorted((k, *w) for k, points in data.items()
                  for w in loop([(t, ) for t, _ in points], width, lambda rows: len(rows) >= threshold))
    assert got == want and want


@pytest.mark.parametrize("width,threshold,length", [(10, 3, 16), (40, 5, 50), (40, 4, 640), (100, 7, 100)])
def test_distinct_windows_equal_loop(spark, width, threshold, length):
    data = series(width * threshold)
    slots = Slots.of(width, length)
    nodes = frame(spark, data).groupBy("key", "at", "port").agg(F.count("*").alias("c"))
    ports = lambda rows: len({p for _, p in rows if p is not None})
    found = greedy_windows(
        ahead_distinct(nodes, ["key"], "port", slots).where(F.col("k") >= threshold),
        ["key"], slots, ["n", "until"])
    got = sorted((r.key, r["at"], r.until, r.n) for r in found.collect())
    order = lambda points: sorted(points, key=lambda x: x[0])
    want = []
    for k, points in data.items():
        rows, i = order(points), 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] <= rows[i][0] + width:
                j += 1
            if ports(rows[i:j]) >= threshold:
                want.append((k, rows[i][0], rows[j - 1][0], j - i))
                i = j
            else:
                i += 1
    assert got == sorted(want) and want


def test_every_instant_is_a_candidate(spark):
    data = series(5)
    slots = Slots.of(30, 37)
    nodes = frame(spark, data).groupBy("key", "at").agg(F.count("*").alias("c"))
    found = greedy_windows(ahead_counts(nodes, ["key"], slots), ["key"], slots, ["n", "until"])
    got = sorted((r.key, r["at"], r.until, r.n) for r in found.collect())
    want = sorted((k, *w) for k, points in data.items()
                  for w in loop([(t, ) for t, _ in points], 30, lambda rows: True))
    assert got == want


def test_chain_through_many_carried_slots(spark):
    """One key without any gap: every slot but the first hangs on the one before."""
    data = {"hot": [(t, None) for t in range(0, 5000)], "odd": [(t, None) for t in range(3, 5000, 7)]}
    slots = Slots.of(60, 61)
    nodes = frame(spark, data).groupBy("key", "at").agg(F.count("*").alias("c"))
    found = greedy_windows(ahead_counts(nodes, ["key"], slots), ["key"], slots)
    got = sorted((r.key, r["at"]) for r in found.collect())
    assert got == sorted((k, w[0]) for k, points in data.items()
                         for w in loop([(t, ) for t, _ in points], 60, lambda rows: True))


def test_negative_time_and_membership(spark):
    data = {"a": [(t, None) for t in (-130, -120, -61, -60, 0, 5, 60, 61, 121)]}
    slots = Slots.of(60, 100)
    rows = frame(spark, data)
    nodes = rows.groupBy("key", "at").agg(F.count("*").alias("c"))
    found = greedy_windows(ahead_counts(nodes, ["key"], slots), ["key"], slots)
    member = in_windows(rows, found.withColumnRenamed("at", "opened"), ["key"], slots)
    got = sorted((r.opened, r["at"]) for r in member.collect())
    assert got == [(-130, -130), (-130, -120), (-61, -61), (-61, -60), (0, 0), (0, 5), (0, 60), (61, 61), (61, 121)]


def test_bad_widths_are_refused():
    for args in ((-1,), (10, 5)):
        with pytest.raises(ValueError):
            Slots.of(*args)


def test_a_million_instants_of_one_key_in_one_slot(spark):
    """Microsecond instants, wide windows: the slot is carried, and read as a stream."""
    from palisade.functions.times import MINUTE

    count, step, width = 1_000_000, 977_777, 1440 * MINUTE
    slots = Slots.of(width)
    start = 5 * slots.length
    nodes = spark.range(-3, count).select(
        F.lit("k").alias("key"), (F.lit(start) + F.col("id") * step).alias("at"), F.lit(1).cast("bigint").alias("c"))
    found = greedy_windows(
        ahead_counts(nodes, ["key"], slots).where(F.col("n") >= 2), ["key"], slots, ["n"]).orderBy("at").collect()
    want, at, last = [], start - 3 * step, start + (count - 1) * step
    while at < last:
        want.append(at)
        at += (width // step + 1) * step
    assert [r["at"] for r in found] == want and len(want) > 5


def test_routes_hold_the_chains_that_are_open():
    """Far more instants than fit in a width pass through without being kept."""
    from palisade.operators.windows import Routes

    routes = Routes(0, 100, 1_000_000)
    routes.add(-50, -1)
    most = 0
    for at in range(0, 900_000, 7):
        routes.add(at, 0)
        most = max(most, len(routes.open))
    assert most <= 16 and len(routes.entries) <= 16


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_windows_do_not_depend_on_where_batches_end(spark, rows):
    """Slots that go over several batches, and batches with several slots."""
    data = series(21, keys=12, span=400, rows=25)
    slots, name = Slots.of(20, 45), "spark.sql.execution.arrow.maxRecordsPerBatch"
    nodes = frame(spark, data).groupBy("key", "at").agg(F.count("*").alias("c"))
    want = {(k, t): [p for at, p in points if t <= at <= t + 20] for k, points in data.items() for t, _ in points}
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        got = greedy_windows(ahead_counts(nodes, ["key"], slots), ["key"], slots).collect()
        by_port = frame(spark, data).groupBy("key", "at", "port").agg(F.count("*").alias("c"))
        ahead = ahead_distinct(by_port, ["key"], "port", slots).where("side = 0").collect()
    finally:
        spark.conf.set(name, before)
    assert sorted((r.key, r["at"]) for r in got) == sorted(
        (k, w[0]) for k, points in data.items() for w in loop([(t, ) for t, _ in points], 20, lambda _: True))
    assert {(r.key, r["at"]): (r.k, r.n) for r in ahead} == {x: (len({*p} - {None}), len(p)) for x, p in want.items()}


def test_distinct_counts_hold_one_width():
    from palisade.operators.windows import Ahead

    scan, found, most = Ahead(100, 3), [], 0
    for at in range(0, 90_000, 7):
        scan.feed([at], [0], [2], [at % 5], 0, 1, found)
        most = max(most, len(scan.held))
    assert most <= 16 and found[0] == (0, 0, 5, 30, 98)
    scan.feed([90_001, 90_002], [1, 1], [1, 1], [9, 8], 0, 2, found)
    scan.leave(None, found)
    assert [t for t, *_ in found] == [*range(0, 90_000, 7)] and not scan.rows and not scan.places
    scan.feed([90_003], [1], [1], [9], 0, 1, found)
    assert not scan.held
