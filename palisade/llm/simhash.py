"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming radius by BK-trees.

Two fingerprints at most ``radius`` bits apart agree on all bits of at least
``BANDS - radius`` of ``BANDS`` bands, so every link meets in a shard that is keyed by that
many bands (fifteen keys of about 21 bits for a radius of 4). Each shard is one BK-tree: the
children of a node are keyed by their integer Hamming distance to it, and a search follows only edges
whose key differs from the distance at hand by the radius at most. Trees are built in the
task that reads the shard: sending all of them to all executors would grow with the corpus.

Equal fingerprints are one node. A shard links as a forest: a subtree whose nodes are all
connected with the searching fingerprint already is not entered, so a dense group of n near
copies gives n - 1 links after about n short searches, not all pairs. A shard with more than
``shard_rows`` fingerprints is cut into pieces, and each pair of pieces is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import Links, components, over_batches, whole_row
from palisade.session import drop_settled, settle

WORDS = 4        # words in a shingle
RADIUS = 4       # differing bits of a link
SEED = 42
SHARD_ROWS = 20_000
_ALL = (1 << 64) - 1


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text: the majority of each bit over the hashes of its shingles.

    Letters A-Z are lowered, words end at ASCII white space, repeated shingles count again.
    Fewer words than a shingle: all of them are one; none, or a null text: 0.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
        shingles = map(joined.__getitem__, map(slice, starts, ends[words - 1:].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(starts))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        piece = hashes[k:k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long), one row per row of ``docs``."""
    def task(batch: pa.RecordBatch) -> dict:
        made = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(made.view(np.int64))}

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", task)


class Tree:
    """A BK-tree that also knows which of its subtrees are one component."""

    __slots__ = ("links", "root", "radius")

    def __init__(self, links: Links, radius: int) -> None:
        self.links, self.root, self.radius = links, None, radius

    def add(self, value: int) -> Iterator[tuple[int, int]]:
        """Put ``value`` into the tree; yields the links that join two components."""
        find = self.links.find
        if self.root is None:
            self.root = [value, {}, True]
            return
        radius, stack = self.radius, [self.root]
        while stack:
            node, children, one = stack.pop()
            if one and find(node) == find(value):
                continue
            apart = (node ^ value).bit_count()
            if apart <= radius and self.links.join(node, value):
                yield node, value
            for key, child in children.items():
                if apart - radius <= key <= apart + radius:
                    stack.append(child)
        spot = self.root
        while True:
            # The subtree stays one component only if the newcomer belongs to it.
            spot[2] = spot[2] and find(spot[0]) == find(value)
            apart = (spot[0] ^ value).bit_count()
            below = spot[1].get(apart)
            if below is None:
                spot[1][apart] = [value, {}, True]
                return
            spot = below


def _shard_keys(radius: int):
    """The keys of a fingerprint: all choices of bands, ``choice`` and the bits chosen."""
    bands = radius + 2
    edges = [64 * k // bands for k in range(bands + 1)]
    masks = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(bands)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [signed(masks[a] | masks[b]) for a, b in combinations(range(bands), 2)]
    return F.explode(F.array(*[
        F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(chosen)]))


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """Links within each shard of ``rows`` (shard columns, then fp), read shard by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, first = None, None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            *keys, values = [c.to_pylist() for c in batch.columns]
            for key, value in zip(zip(*keys), values):
                if key != now:
                    now, tree, first = key, None, value
                    continue
                if tree is None:  # most shards have a single fingerprint and need no tree
                    tree = Tree(Links(), radius)
                    found.extend(tree.add(first & _ALL))
                found.extend(tree.add(value & _ALL))
            if found:
                made = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    keys = rows.columns[:-1]
    return rows.repartition(*keys).sortWithinPartitions(*rows.columns).mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``a, b``: a forest of links over distinct fingerprints ``fp``, at most ``radius`` bits apart."""
    if not 0 <= radius <= 6:
        raise ValueError("the radius is 0 to 6 bits")
    keyed = prints.select(_shard_keys(radius).alias("k"), "fp").select("k.choice", "k.bits", "fp")
    busy = settle(
        keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows)
        .select("choice", "bits", F.ceil(F.col("n") / shard_rows).cast("int").alias("pieces")), "busy-shards")
    plain = _linked(keyed.join(busy, ["choice", "bits"], "left_anti"), radius)
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    pair = lambda other: F.struct(F.least("piece", other).alias("p"), F.greatest("piece", other).alias("q"))
    cut = (
        keyed.join(busy, ["choice", "bits"]).withColumn("piece", piece.cast("int"))
        .select("choice", "bits", F.explode(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), pair)).alias("t"), "fp")
        .select("choice", "bits", "t.p", "t.q", "fp")
    )
    return plain.union(_linked(cut, radius))


def near_duplicates(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits)``, component_id``: one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable by links. Texts without words, null
    included, have fingerprint zero and link like any other. Rows without an id link as well
    but give no component its name: it is null if a whole component has none. Repeated rows
    come out as often as they went in. An empty table gives no rows; other columns are ignored.
    """
    prints = settle(fingerprints(docs, words), "fingerprints")
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    edges = settle(links(nodes.select("fp"), radius, shard_rows), "fingerprint-links")
    groups = settle(components(edges), "fingerprint-groups").withColumnRenamed("node", "fp")
    drop_settled(docs.sparkSession, edges)
    # A fingerprint without links is its own group.
    named = nodes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = settle(
        named.groupBy("component").agg(F.min("least").alias("component_id")), "fingerprint-names")
    ids = settle(named.join(smallest, "component").select("fp", "component_id"), "fingerprint-ids")
    return prints.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest id of each group, in the columns of ``docs``.

    Rows without an id stand behind all that have one, and equal texts among them count as one
    document. Of rows that share the id that stays, the one with the smallest text is kept.
    """
    # Above any id in use: bit 62 is set.
    stand_in = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = docs.select(whole_row(docs), F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("id"))
    found = near_duplicates(named.select(F.col("id").alias("doc_id"), "row.text"), **options)
    stay = settle(
        found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("id"))
        .agg((F.count("*") > 1).alias("repeated")), "kept-ids")
    once = named.join(stay.where(~F.col("repeated")).select("id"), "id", "left_semi")
    again = named.join(stay.where("repeated").select("id"), "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_first("row.text"), "row"))
    first = again.withColumn("place", place).where("place = 1")
    return once.select("row.*").union(first.select("row.*"))
