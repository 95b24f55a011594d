"""Mixing sources to target weights by capped water-filling, with expressions only.

The mix has as many words as the corpus. A source's share follows its weight until it would
be repeated more than ``max_epochs`` times; it is held there, and what is left is shared anew among the
others, until none is above its limit. The level at which that ends is found in one ordered
pass over the sources, since sources reach their limits in the order of limit to weight.

A source's target is taken in whole repetitions of all its documents and one fractional repetition: documents
in a seeded order until the words run out, the last of them in part, so the words taken are
the target to the word. Finding where they run out needs no source in one task: words are
added up per source and slice of the order, and only the one slice that holds the end is
ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import WORD, whole_row, with_text
from palisade.session import settle

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 17
SLICES = 4096
SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int) -> Column:
    """Sixty random bits of a row, the same in every run with the seed."""
    part = lambda c: F.concat(F.lit("="), F.col(c).cast("string"))
    digest = F.md5(F.concat_ws("\n", F.lit(str(seed)), part("doc_id"), part("source"), part("text")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target``: how many words the mix takes from each source.

    ``sizes`` has ``source`` and ``size``. Weights go round over the sources in code point
    order, null last. A source without words has the target 0. The ordered passes are over
    one row per source, which is what the grouping leaves.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Spark orders strings by their UTF-8 bytes, which is code point order.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("limit", max_epochs * F.col("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # If all before this source are at their limits, the others share the rest at this level.
    filled = weighed.withColumns({
        "held": F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "all": F.sum("source_size").over(every),
    }).withColumn("level", (F.col("all") - F.col("held")) / F.col("open"))
    first = filled.withColumn(
        "found", F.min(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct("held", "level"))).over(every))
    level = first["found"]["level"]
    return first.select(
        "source", "source_size",
        F.coalesce(F.least(F.col("limit").cast("double"), level * F.col("weight")), F.lit(0.0)).alias("target"))


def document_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, draw``: the seeded draw orders the documents of a source.

    It depends on id, source and text only, so reruns and other partitions give the same order.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"),
        draw(seed).alias("draw"))


def _decisions(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Per source: target, whole repetitions, the slice in which the fractional one ends, and the words left there."""
    aims = settle(targets(sizes, weights, max_epochs), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("whole", whole.cast("long")).withColumn(
        "part", (F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")).cast("long"))
    slices = sizes.groupBy("source", _slice("draw").alias("slice")).agg(F.sum("size").alias("words"))
    so_far = F.sum("words").over(
        Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    ends = (
        slices.withColumn("until", so_far)
        .join(aims.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("until") >= F.col("part")) & (F.col("until") - F.col("words") < F.col("part")))
        .select(F.col("source").alias("s"), "slice", (F.col("part") - F.col("until") + F.col("words")).alias("left"))
    )
    return aims.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("its_source"), "source_size", "target", "whole",
        # No words to take in part: no slice is reached.
        F.coalesce("slice", F.when(F.col("part") <= 0, -1).otherwise(SLICES)).alias("last_slice"),
        F.coalesce("left", F.lit(0)).alias("left"))


def _slice(draw: str) -> Column:
    return F.shiftright(F.col(draw), 60 - SLICES.bit_length() + 1)


def _with_decisions(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``rows`` with what was decided for their source; the rows of each source are spread over
    ``SALTS`` keys, so that a large source is not one task."""
    salted = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("its_salt", F.pmod("draw", F.lit(SALTS))).join(
        salted, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("its_salt") == F.col("salt"))
    ).drop("salt", "its_salt")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken`` and ``whole``, ``part``.

    ``whole`` is how often the whole document is taken and ``part`` how many of its words a last
    time. Null and empty texts have size 0 and nothing is taken; the null source is a source
    of its own; repeated rows each have their share, and rows equal in all columns share the
    draw, so they stand next to each other in the order. An empty table gives no rows; other
    columns are ignored.
    """
    sizes = settle(document_sizes(docs, seed), "mix-sizes")
    decided = settle(_decisions(sizes, weights, max_epochs), "mix-decisions")
    rows = _with_decisions(sizes, decided).withColumn("slice", _slice("draw"))
    inside = F.col("slice") == F.col("last_slice")
    # Only the slice with the end is ordered; the rest of a source is decided by its slice.
    before = Window.partitionBy("its_source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("size").over(before), F.lit(0))
    last = rows.where(inside).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("left") - used)))
    rest = rows.where(~inside).withColumn("part", F.when(F.col("slice") < F.col("last_slice"), F.col("size")).otherwise(0))
    names = ["doc_id", "size", "source_size", "target", "whole", "part", "draw", "source"]
    return last.select(*names).union(rest.select(*names)).select(
        "doc_id", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        "whole", F.col("part").cast("long").alias("part"), "draw", "source")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, in the columns of ``docs``: whole texts repeated, and the partly taken text cut after its words.

    ``n_chars``, where there is one, is counted anew for the cut text. Documents without words are not taken;
    rows equal in all columns are all taken as often as the one taken most.
    """
    plan = settle(
        mix(docs, **options).where("taken > 0").groupBy("draw", "doc_id").agg(
            F.max("size").alias("size"), F.max("whole").alias("whole"), F.max("part").alias("part")), "mix-plan")
    keyed = docs.select(whole_row(docs), draw(options.get("seed", SEED)).alias("its_draw"))
    same = (F.col("its_draw") == F.col("draw")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id"))
    copies = F.col("whole") + (F.col("part") > 0).cast("long")
    chosen = keyed.join(plan, same).select(
        "row", "size", "whole", "part", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    cut = (F.col("copy") > F.col("whole")) & (F.col("part") < F.col("size"))
    words = F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1))
    first = F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ")
    return chosen.select(with_text(docs, first, cut)).select("row.*")
