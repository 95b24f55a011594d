"""Source reputation: normalizing provider answers, keeping the latest, and joining them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.severity import lift
from palisade.functions.times import iso, ntz
from palisade.schema import PROVIDER_SCHEMA, REPUTATION_SCHEMA
from palisade.session import settle

FRESH_HOURS = 24
LISTED_DETECTIONS = 10
# Fixed values.
REPORT_URL = "https://www.virustotal.com/gui/ip-address/"
MISSING_ERROR = "Unable to fetch reputation"
UNNAMED_DETECTION = "Malicious"


def threat_level(malicious: Column, suspicious: Column) -> Column:
    """The level from how many engines call a source malicious or suspicious."""
    return (
        F.when(malicious >= 10, "CRITICAL").when(malicious >= 5, "HIGH")
        .when((malicious >= 2) | (suspicious >= 5), "MEDIUM")
        .when((malicious >= 1) | (suspicious >= 1), "LOW").otherwise("CLEAN")
    )


def normalize(feed: DataFrame) -> DataFrame:
    """Provider answers (ip, cached_at, body) to reputation records.

    A null body means the provider does not know the source: its record is UNKNOWN. A body
    that is no JSON is no answer and gives no record.
    """
    parsed = feed.select("ip", "cached_at", "body", F.from_json("body", PROVIDER_SCHEMA).alias("answer"))
    parsed = parsed.where(F.col("body").isNull() | F.col("answer.data").isNotNull())
    known, found = F.col("body").isNotNull(), F.col("answer.data.attributes")
    stat = lambda name: F.coalesce(found["last_analysis_stats"][name], F.lit(0))
    parts = parsed.select(
        "ip", "cached_at", known.alias("known"), found.alias("found"), F.col("answer.data.id").alias("id"),
        *[stat(s).alias(s) for s in ("malicious", "suspicious", "undetected")],
    ).withColumn("engines", F.col("malicious") + F.col("suspicious") + F.col("undetected"))
    malicious, engines, found = F.col("malicious"), F.col("engines"), F.col("found")
    engines_hit = F.filter(F.map_values(found["last_analysis_results"]), lambda r: r["category"] == "malicious")
    when_known = lambda value: F.when(F.col("known"), value)
    stamp = found["last_analysis_date"]
    return parts.select(
        "ip",
        (F.col("known") & (malicious > 0)).alias("detected"),
        F.when(F.col("known") & (engines > 0), ((malicious / engines) * 100).cast("int")).otherwise(0).alias("reputation_score"),
        F.when(F.col("known"), threat_level(malicious, F.col("suspicious"))).otherwise("UNKNOWN").alias("threat_level"),
        when_known(malicious).alias("malicious_count"),
        when_known(F.col("suspicious")).alias("suspicious_count"),
        when_known(engines).alias("total_engines"),
        F.when(stamp != 0, iso(F.timestamp_seconds(stamp).cast("timestamp_ntz"))).alias("last_analysis_date"),
        when_known(F.coalesce(found["country"], F.lit(""))).alias("country"),
        found["asn"].alias("asn"),
        when_known(F.coalesce(found["as_owner"], F.lit(""))).alias("as_owner"),
        F.coalesce(F.array_sort(F.array_distinct(F.map_values(found["categories"]))),
                   F.array().cast("array<string>")).alias("categories"),
        F.coalesce(
            F.slice(F.transform(engines_hit, lambda r: F.coalesce(r["result"], F.lit(UNNAMED_DETECTION))), 1, LISTED_DETECTIONS),
            F.array().cast("array<string>")).alias("detection_names"),
        when_known(F.concat(F.lit(REPORT_URL), F.coalesce("id", F.lit("")))).alias("virustotal_url"),
        "cached_at",
    )


def latest(records: DataFrame) -> DataFrame:
    """The newest record per source. The maximum is taken before the shuffle too."""
    rest = [c for c in REPUTATION_SCHEMA.names if c not in ("ip", "cached_at")]
    newest = records.groupBy("ip").agg(F.max(F.struct("cached_at", *rest)).alias("r"))
    return newest.select("ip", "r.*").select(*REPUTATION_SCHEMA.names)


def upsert(current: DataFrame, answers: DataFrame) -> DataFrame:
    """The reputation table after new answers."""
    return latest(current.unionByName(answers))


def read_reputation(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the table; empty when there is none."""
    at = _versions(spark, path)
    return spark.read.schema(REPUTATION_SCHEMA).parquet(f"{path}/v{at[-1]}") if at else spark.createDataFrame([], REPUTATION_SCHEMA)


def store(answers: DataFrame, path: str) -> None:
    """Bring answers into the table: a new version is written beside the one in use.

    A version counts once it is complete, so a write that stops changes nothing; the version
    before the last is kept for those that still read it, older ones go. On a stream, call it for each batch:
    storing the same answers again gives the same table.
    """
    spark = answers.sparkSession
    at = _versions(spark, path)
    upsert(read_reputation(spark, path), answers).write.mode("overwrite").parquet(f"{path}/v{at[-1] + 1 if at else 0}")
    place, files = _files(spark, path)
    for old in at[:-1]:
        files.delete(place(f"v{old}"), True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    place, files = _files(spark, path)
    if not files.exists(place("")):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place(""))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and files.exists(place(f"{n}/_SUCCESS")))


def _files(spark: SparkSession, path: str):
    place = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
    return place, place("").getFileSystem(spark._jsc.hadoopConfiguration())


def known_at(records: DataFrame, as_of: datetime) -> DataFrame:
    """What was known at a point in time, and whether it was younger than a day.

    A stale record is still used when no fresher one exists.
    """
    newest = latest(records.where(F.col("cached_at") <= ntz(as_of)))
    return newest.withColumn(
        "is_fresh", F.col("cached_at") > ntz(as_of) - F.make_dt_interval(hours=F.lit(FRESH_HOURS)))


def lookup(ips: DataFrame, reputation: DataFrame) -> DataFrame:
    """Reputation of each requested source (column ``ip``), with a stand-in where missing.

    ``error`` is null for sources that have a record.
    """
    wanted = ips.where(F.col("ip") != "").select("ip").distinct()
    have = reputation.withColumn("has", F.lit(True))
    found = wanted.join(have, "ip", "left")
    stand_in = {"detected": F.lit(False), "reputation_score": F.lit(0), "threat_level": F.lit("UNKNOWN")}
    return found.withColumns({
        **{c: F.coalesce(c, v) for c, v in stand_in.items()},
        "error": F.when(F.col("has").isNull(), MISSING_ERROR),
    }).drop("has")


def enrich(rows: DataFrame, reputation: DataFrame, column: str = "source_ip", raise_severity: bool = True) -> DataFrame:
    """Attach reputation to rows with a source, as a struct; raise their severity by it.

    The join is left to the optimizer: the reputation table is broadcast when it is small,
    and a busy source is split when it is not.
    """
    side = reputation.select(
        F.col("ip").alias(column),
        F.struct(*[c for c in reputation.columns if c != "ip"]).alias("reputation"))
    joined = rows.join(side, column, "left")
    if raise_severity and "severity" in rows.columns:
        joined = joined.withColumn(
            "severity", lift("severity", F.col("reputation.threat_level"), F.col("reputation.detected")))
    return joined.select(*rows.columns, "reputation")


def flood_reputations(detections: DataFrame, reputation: DataFrame) -> DataFrame:
    """Flood detections with ``source_ip_reputations``, a map from source to its record.

    A detection lists twenty sources at most. Its severity is left as it is. Detections are
    written first, as they are used twice.
    """
    named = settle(detections.withColumn("detection", F.monotonically_increasing_id()), "floods")
    sources = named.select("detection", F.explode("source_ips").alias("ip"))
    found = lookup(sources.select("ip"), reputation).select(
        "ip", F.struct("detected", "reputation_score", "threat_level", "error").alias("record"))
    maps = (
        sources.join(found, "ip").groupBy("detection")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ip", "record")))).alias("source_ip_reputations"))
    )
    return named.join(maps, "detection", "left").drop("detection")


def classify(found: DataFrame) -> DataFrame:
    """Class of each looked-up source: malicious, suspicious, clean or unknown."""
    level = F.col("threat_level")
    kind = (
        F.when(F.col("error").isNotNull(), "unknown")
        .when(level.isin("CRITICAL", "HIGH") | F.col("detected"), "malicious")
        .when((level == "MEDIUM") | (F.coalesce("suspicious_count", F.lit(0)) > 0), "suspicious")
        .otherwise("clean")
    )
    return found.withColumn("class", kind)
