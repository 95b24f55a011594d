"""Fixed schemas. Nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

# One parsed log record. `log_id` identifies a row; `log_date` partitions the table.
LOG_SCHEMA = T.StructType([
    T.StructField("log_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("log_source", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("raw_log", T.StringType()),
])

LOG_TABLE_SCHEMA = T.StructType([*LOG_SCHEMA.fields, T.StructField("log_date", T.DateType())])

# A raw line waiting to be parsed; the hint names the source it came from.
LINE_SCHEMA = T.StructType([
    T.StructField("line_id", T.LongType()),
    T.StructField("line", T.StringType()),
    T.StructField("log_source_hint", T.StringType()),
])

# Body of one reputation provider answer.
PROVIDER_SCHEMA = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("attributes", T.StructType([
            T.StructField("last_analysis_stats", T.StructType([
                T.StructField("malicious", T.IntegerType()),
                T.StructField("suspicious", T.IntegerType()),
                T.StructField("undetected", T.IntegerType()),
            ])),
            T.StructField("last_analysis_results", T.MapType(T.StringType(), T.StructType([
                T.StructField("category", T.StringType()),
                T.StructField("result", T.StringType()),
            ]))),
            T.StructField("categories", T.MapType(T.StringType(), T.StringType())),
            T.StructField("country", T.StringType()),
            T.StructField("asn", T.LongType()),
            T.StructField("as_owner", T.StringType()),
            T.StructField("last_analysis_date", T.LongType()),
        ])),
    ])),
])

REPUTATION_SCHEMA = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("detected", T.BooleanType()),
    T.StructField("reputation_score", T.IntegerType()),
    T.StructField("threat_level", T.StringType()),
    T.StructField("malicious_count", T.IntegerType()),
    T.StructField("suspicious_count", T.IntegerType()),
    T.StructField("total_engines", T.IntegerType()),
    T.StructField("last_analysis_date", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("asn", T.LongType()),
    T.StructField("as_owner", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("detection_names", T.ArrayType(T.StringType())),
    T.StructField("virustotal_url", T.StringType()),
    T.StructField("cached_at", T.TimestampNTZType()),
])
