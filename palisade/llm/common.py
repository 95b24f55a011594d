"""What several corpus operators share: sessions, tasks over texts, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palisade.session import configure, drop_settled, settle

# Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

# What is handed to a Python task at once: so many rows, and no more bytes than this beyond the first row.
BATCH_ROWS = 512
BATCH_BYTES = "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """The session with the library's settings and small Arrow batches, bounded in rows and in bytes."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def over_batches(
    frame: DataFrame, schema: str | StructType, task: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch | None],
) -> DataFrame:
    """``task`` on every Arrow batch; it returns columns by name, in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = task(batch)
            if isinstance(made, dict):
                made = pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(k).type) for k, x in made.items()],
                    schema=arrow)
            if made is not None and made.num_rows:
                yield made

    return frame.mapInArrow(run, schema)


def whole_row(frame: DataFrame) -> Column:
    """All columns as one struct ``row``, so that no name of theirs meets one of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("row")


def with_text(docs: DataFrame, text: Column, changed: Column) -> Column:
    """The struct ``row`` of ``docs`` with another text where it changed, and ``n_chars``, if there is one, for it."""
    made = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        made = made.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return F.when(changed, made).otherwise(F.col("row")).alias("row")


class Links:
    """Union-find over hashable nodes, for the links one task sees."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a, b) -> bool:
        """Whether the link was news: only then it has to leave the task."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (a, b long).

    Each round moves all links of a node to its smallest neighbour, first those to larger
    nodes, then those to smaller ones, so that trees flatten in a logarithmic number of
    rounds. A round is two grouped minima, combined before the shuffle, and two joins on the
    node. Links are written after each round in the shared folder, which cuts the lineage,
    and the previous round's files are deleted.
    """
    spark = edges.sparkSession
    now = settle(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "links")
    state = _fingerprint(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.where("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = settle(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        reached = _fingerprint(after)
        drop_settled(spark, now, large)
        now = after
        if reached == state:
            break
        state = reached
    star = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the links: equal when a round changed nothing."""
    spread = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    row = edges.agg(F.count("*"), spread("a", "b"), spread("b", "a")).first()
    return tuple(row)
