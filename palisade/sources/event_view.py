"""A log table derived from the generic `events` test table.

The test data has no security log, so one is computed from `events` by fixed formulas.
Each day's events are moved into the first six minutes of the day, which gives bursts;
sources, ports, users and rendered text follow from `user_id`, `event_type` and `props.k`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.times import DAY, from_micros, micros

SQUEEZE = 240  # a day becomes six minutes


def events_as_logs(events: DataFrame) -> DataFrame:
    """`events` as log records, rendered text included."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    at = micros("ts")
    slot = F.expr("user_id div 15")
    base = events.select(
        F.col("event_id").alias("log_id"),
        from_micros(at - at % DAY + F.floor((at % DAY) / SQUEEZE)).alias("timestamp"),
        F.concat(F.lit("10.0."), F.floor(slot / 256).cast("string"), F.lit("."), (slot % 256).cast("string"))
         .alias("source_ip"),
        kind.alias("kind"),
        k.alias("k"),
    )
    kind, k = F.col("kind"), F.col("k")
    login = kind.isin("error", "signup")
    by_kind = lambda **v: F.coalesce(*[F.when(kind == name, F.lit(x)) for name, x in v.items()])
    fields = base.select(
        "log_id", "timestamp", "source_ip", "kind", "k",
        F.when(login, 22).when(kind == "purchase", 3306)
         .when(k % 4 != 0, 8000 + k % 40).cast("int").alias("destination_port"),
        F.when(login | (kind == "purchase"), "TCP").when(k % 5 == 0, None)
         .when(k % 2 == 0, "UDP").otherwise("TCP").alias("protocol"),
        by_kind(error="auth.log", signup="auth.log", purchase="sql.log", view="ufw.log", click="iptables")
        .alias("log_source"),
        by_kind(error="SSH_FAILED_LOGIN", signup="SSH_LOGIN_SUCCESS", purchase="SQL_AUTH_FAILED",
                view="UFW_TRAFFIC", click="CONNECTION_ATTEMPT").alias("event_type"),
        F.when((kind == "purchase") & (k % 10 == 0), "CRITICAL")
         .otherwise(by_kind(error="HIGH", signup="LOW", purchase="HIGH", view="LOW", click="MEDIUM"))
         .alias("severity"),
        F.when(login, F.concat(F.lit("user"), (k % 7).cast("string"))).alias("username"),
    )
    return fields.select(
        "log_id", "timestamp", "source_ip", "destination_port", "protocol", "log_source",
        "event_type", "severity", "username", _rendered().alias("raw_log"),
    )


def _rendered():
    kind, k, ip = F.col("kind"), F.col("k"), F.col("source_ip")
    text = lambda c: c.cast("string")
    stamp = F.concat(
        F.date_format("timestamp", "MMM"), F.lit(" "),
        F.lpad(text(F.dayofmonth("timestamp")), 2, " "), F.lit(" "),
        F.date_format("timestamp", "HH:mm:ss"),
    )
    who = F.concat(F.when(kind == "signup", "Accepted password for ").otherwise("Failed password for "),
                   F.when((kind == "error") & (k % 3 == 0), "invalid user ").otherwise(""))
    ssh = F.concat(stamp, F.lit(" host1 sshd["), text(F.col("log_id")), F.lit("]: "), who, F.col("username"),
                   F.lit(" from "), ip, F.lit(" port "), text(40000 + k), F.lit(" ssh2"))
    sql = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" db1 mysqld: "),
                   F.when(k % 10 == 0, "select 1; -- ").when(k % 3 == 1, "denied login mysql")
                   .otherwise("login denied mysql"), F.lit(" from "), ip)
    packet = F.concat(
        F.lit("IN=eth0 OUT= SRC="), ip, F.lit(" DST=10.9.9.9"),
        F.coalesce(F.concat(F.lit(" PROTO="), F.col("protocol")), F.lit("")),
        F.coalesce(F.concat(F.lit(" DPT="), text(F.col("destination_port"))), F.lit("")),
    )
    ufw = F.concat(stamp, F.lit(" host1 kernel: [UFW AUDIT] "), packet)
    net = F.concat(stamp, F.lit(" host1 kernel: [1.5] "), packet,
                   F.when(k % 3 == 0, " SYN URGP=0").when(k % 3 == 1, " ACK URGP=0").otherwise(" DROP"))
    return (F.when(kind.isin("error", "signup"), ssh).when(kind == "purchase", sql)
            .when(kind == "view", ufw).otherwise(net))


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The derived log table of one data folder."""
    return events_as_logs(spark.read.parquet(f"{folder}/events.parquet"))


def logs_as_lines(logs: DataFrame) -> DataFrame:
    """The rendered text as raw lines with their source hints, ready for the parsers."""
    return logs.select(
        F.col("log_id").alias("line_id"),
        F.col("raw_log").alias("line"),
        F.col("log_source").alias("log_source_hint"),
    )
