"""A reputation feed computed from the derived logs, two answers per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENGINES = 12


def provider_answers(logs: DataFrame) -> DataFrame:
    """ip, cached_at, body: figures follow from how many rows a source has (c) and from the
    version (0 when first seen, 1 when last seen). Some last answers are "not known"."""
    seen = logs.groupBy(F.col("source_ip").alias("ip")).agg(
        F.count("*").cast("int").alias("c"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
    answers = seen.select("ip", "c", F.inline(F.array(
        F.struct(F.lit(0).alias("v"), F.col("low").alias("cached_at")),
        F.struct(F.lit(1).alias("v"), F.col("high").alias("cached_at")))))
    c, malicious = F.col("c"), (F.col("c") + F.col("v")) % 13
    results = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(ENGINES - 1)), lambda i: F.struct(
        F.concat(F.lit("engine"), F.lpad(i.cast("string"), 2, "0")),
        F.struct(F.when(i < malicious, "malicious").otherwise("harmless").alias("category"),
                 F.when(i % 3 != 0, F.concat(F.lit("name"), i.cast("string"))).alias("result")))))
    attributes = F.struct(
        F.struct(malicious.alias("malicious"), (c % 7).alias("suspicious"), (40 + c % 30).alias("undetected"))
        .alias("last_analysis_stats"),
        results.alias("last_analysis_results"),
        F.create_map(F.lit("a"), F.concat(F.lit("kind"), (c % 3).cast("string")),
                     F.lit("b"), F.concat(F.lit("kind"), (c % 2).cast("string"))).alias("categories"),
        F.when(c % 5 != 0, F.concat(F.lit("C"), (c % 5).cast("string"))).alias("country"),
        (1000 + c % 50).alias("asn"),
        F.concat(F.lit("owner"), (c % 4).cast("string")).alias("as_owner"),
        (1_700_000_000 + c).alias("last_analysis_date"))
    body = F.to_json(F.struct(F.struct(F.col("ip").alias("id"), attributes.alias("attributes")).alias("data")))
    return answers.select(
        "ip", "cached_at", F.when((c % 4 != 3) | (F.col("v") == 0), body).alias("body"))
