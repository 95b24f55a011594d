"""Embedding near-duplicates: int8 tile products with error bounds, exact where it matters.

Each unit vector x is stored as int8 codes q with a scale s, and e = |x - s q| is computed, not
estimated. For two of them |x.y - s t q.r| <= e |t r| + f |s q| + e f, which holds for every pair.
A tile multiplies the codes of two blocks in single precision, with the largest rounding error
that many products can have added to the bound, and only pairs whose bound reaches the threshold are recomputed
in double precision from the vectors themselves.

Equal vectors are one node with a number of copies. Blocks have a fixed number of vectors and
each pair of blocks is a task, so no task grows with the input or with a group of near
copies. A tile returns how many links each vector has in it and a forest of links, never all
pairs. The work is that of comparing all distinct vectors, which the operator asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Links, components, over_batches
from palisade.session import drop_settled, settle

THRESHOLD = 0.9
BLOCK_ROWS = 8192
STRIP = 512  # rows of a tile multiplied at once


def unit(vectors: np.ndarray) -> np.ndarray:
    """The rows at length one; scaled by a power of two first, so squares stay in range."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return scaled / np.sqrt(np.einsum("nd,nd->n", scaled, scaled))[:, None]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of each row, their scale, and the length of what they miss (rounded up)."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    missed = x - scale[:, None] * codes
    return codes, scale, np.sqrt(np.einsum("nd,nd->n", missed, missed)) * (1 + 1e-12) + 1e-15


_VECTOR = "vec_id long, dim int, key binary, x binary, q binary, s double, e double"


def _vectors(rows: DataFrame) -> DataFrame:
    """The vectors that can link: ``key`` is the digest of the components, ``x`` the unit vector in doubles,
    ``q, s, e`` its codes, their scale and their error. Nothing of this is done again for a tile."""
    def task(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {k.split()[0]: [] for k in _VECTOR.split(", ")}
        lengths: dict[int, list] = {}
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lengths.setdefault(len(v), []).append((i, v))
        for dim, found in lengths.items():
            given = np.array([[np.nan if c is None else c for c in v] for _, v in found], "<f8").reshape(len(found), dim)
            good = np.isfinite(given).all(axis=1) & given.any(axis=1)
            given = given[good] + 0.0  # -0 becomes 0
            if not len(given):
                continue
            x = unit(given)
            codes, scale, error = quantise(x)
            made["vec_id"] += [i for (i, _), g in zip(found, good) if g]
            made["dim"] += [dim] * len(x)
            made["key"] += [hashlib.sha256(v.tobytes()).digest() for v in given]
            made["x"] += [v.tobytes() for v in x]
            made["q"] += [v.tobytes() for v in codes]
            made["s"] += scale.tolist()
            made["e"] += error.tolist()
        return made

    usable = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", "embedding")
    return over_batches(usable, _VECTOR, task)


def tile(left: dict, right: dict, same: bool, threshold: float) -> tuple[list, np.ndarray, np.ndarray]:
    """Forest of links between two blocks, and the copies each vector of either links to.

    A block has ``id, copies, x`` (unit vectors), ``q`` (codes as single precision), ``s, e`` and ``w`` (|s q|).
    """
    links, found = Links(), []
    of_left, of_right = np.zeros(len(left["id"]), np.int64), np.zeros(len(right["id"]), np.int64)
    if not len(of_left) or not len(of_right):
        return found, of_left, of_right
    # A sum of d products of lengths up to 1.1 rounds by less than this in single precision.
    rounding = 1.3 * (left["q"].shape[1] + 8) * 2.0 ** -23
    # The bound of a pair, with the largest errors of the right block.
    e, w, s = right["e"].max(), right["w"].max(), right["s"]
    codes = np.ascontiguousarray((right["q"] * s[:, None].astype(np.float32)).T)
    for k in range(0, len(of_left), STRIP):
        a = slice(k, k + STRIP)
        about = left["q"][a] @ codes
        slack = (left["e"][a] * w + left["w"][a] * e + left["e"][a] * e) + rounding
        floor = ((threshold - slack) / left["s"][a]).astype(np.float32)
        i, j = np.nonzero(about >= floor[:, None])
        if same:
            keep = i + k < j
            i, j = i[keep], j[keep]
        for c in range(0, len(i), 1 << 16):
            p, r = i[c:c + (1 << 16)] + k, j[c:c + (1 << 16)]
            near = np.einsum("nd,nd->n", left["x"][p], right["x"][r]) >= threshold
            p, r = p[near], r[near]
            np.add.at(of_left, p, right["copies"][r])
            np.add.at(of_right, r, left["copies"][p])
            for u, v in zip(left["id"][p].tolist(), right["id"][r].tolist()):
                if links.join(u, v):
                    found.append((u, v))
    return found, of_left, of_right


def _block(ids: list, copies: list, vectors: list, codes: list, scales: list, errors: list) -> dict:
    x = np.frombuffer(b"".join(vectors), "<f8").reshape(len(ids), -1)
    q = np.frombuffer(b"".join(codes), np.int8).reshape(len(ids), -1).astype(np.float32)
    s = np.array(scales)
    return {"id": np.array(ids, np.int64), "copies": np.array(copies, np.int64), "x": x, "q": q, "s": s, "e": np.array(errors),
            "w": s * np.sqrt(np.einsum("nd,nd->n", q, q, dtype=np.float64))}


def _tiles(distinct: DataFrame, block_rows: int) -> DataFrame:
    """Each distinct vector once for every tile its block is in."""
    # Written first, so that its size decides how it is joined.
    blocks = settle(
        distinct.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "vector-blocks")
    placed = distinct.join(blocks, "dim").withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pair = lambda other: F.struct(F.least("block", other).alias("p"), F.greatest("block", other).alias("q"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)
    return placed.select("dim", "block", F.explode(others).alias("t"), "node", "copies", "x", "q", "s", "e").select(
        "dim", F.col("t.p").alias("left"), F.col("t.q").alias("right"), "block", "node", "copies", "x", "q", "s", "e")


def _linked(tiles: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` for links of the forest, and ``a, null, n`` for the copies ``a`` links to in a tile."""
    def solve(rows: list[tuple], p: int, q: int) -> Iterator[pa.RecordBatch]:
        sides = {}
        for at in {p, q}:
            own = [r for r in rows if r[0] == at]
            sides[at] = _block(*zip(*(r[1:] for r in own))) if own else None
        left, right = sides[p], sides[q]
        if left is None or right is None:
            return
        found, of_left, of_right = tile(left, right, p == q, threshold)
        counted = [(left["id"], of_left), (right["id"], of_right)]
        a = [u for u, _ in found] + [i for ids, n in counted for i in ids[n > 0].tolist()]
        b = [v for _, v in found] + [None] * (len(a) - len(found))
        n = [0] * len(found) + [k for _, c in counted for k in c[c > 0].tolist()]
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for dim, p, q, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (dim, p, q) != now:
                    if rows:
                        yield from solve(rows, *now[1:])
                    now, rows = (dim, p, q), []
                rows.append(row)
        if rows:
            yield from solve(rows, *now[1:])

    return tiles.repartition("dim", "left", "right").sortWithinPartitions("dim", "left", "right").mapInArrow(run, "a long, b long, n long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``rows``.

    Null, empty and zero vectors, and vectors with null or non-finite components, link with
    nothing, nor do vectors of different dimensions with each other. A row without an id links with nothing and is
    kept. Repeated ids are rows of their own: each counts as a link of the others. An empty
    table gives no rows; other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    vectors = settle(_vectors(rows), "vectors")
    distinct = settle(vectors.groupBy("key").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("dim").alias("dim"),
        *[F.first(c).alias(c) for c in ("x", "q", "s", "e")]), "distinct-vectors")
    # Two different vectors under one id are still two nodes.
    numbered = settle(distinct.withColumn("id", F.col("node")).withColumn("node", F.xxhash64("key")), "vector-nodes")
    made = settle(_linked(_tiles(numbered, block_rows), threshold), "vector-links")
    groups = components(made.where("b is not null").select("a", "b"))
    counts = made.groupBy("a").agg(F.sum("n").alias("others"))
    named = (
        numbered.select("key", "node", "id", "copies")
        .join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left")
        .join(counts, F.col("node") == F.col("a"), "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    told = settle(named.join(smallest, "component").select(
        "key", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-groups")
    drop_settled(rows.sparkSession, made)
    linked = vectors.select("vec_id", "key").join(told, "key").select(
        "vec_id", F.col("n_links").cast("long"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists(
        "embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("embedding", lambda c: c != 0)
    alone = rows.where(~F.coalesce(good, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)
