"""Canonical events from the ``events`` table, in Spark and in DuckDB's SQL: the fixed mapping that queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import with_features

COLUMNS = {
    "event_id": "'EVT-' || lpad(CAST(no AS {string}), 8, '0')",
    "event_no": "no",
    "ts_us": "CAST(floor(no / 10) AS BIGINT) * 1000000",
    "src_ip": "CASE WHEN event_type = 'purchase' THEN '45.83.64.9' WHEN user_id % 7 = 0 THEN '10.20.0.' || CAST(user_id % 5 + 1 AS {string}) ELSE '45.83.64.' || CAST(user_id % 5 + 1 AS {string}) END",
    "dst_ip": "CASE WHEN event_type = 'purchase' THEN '10.1.0.9' WHEN event_type = 'signup' THEN '10.1.0.7' ELSE '10.1.1.' || CAST(no % 60 + 1 AS {string}) END",
    "src_port": "CAST(CASE WHEN user_id % 4 = 0 THEN 443 ELSE 40000 + k END AS INT)",
    "dst_port": "CAST(CASE WHEN event_type = 'purchase' THEN 80 WHEN k = 99 THEN 6443 ELSE CASE k % 10 WHEN 0 THEN 22 WHEN 1 THEN 3389 WHEN 2 THEN 445 WHEN 3 THEN 3306 WHEN 4 THEN 6379 WHEN 5 THEN 5985 WHEN 6 THEN 5900 WHEN 7 THEN 8080 WHEN 8 THEN 2375 ELSE 23 END END AS INT)",
    "protocol": "'TCP'",
    "action": "CASE WHEN event_type = 'purchase' OR floor(k / 10) < 8 THEN 'block' ELSE 'pass' END",
    "tcp_flags": "CASE no % 12 WHEN 5 THEN 'ACK' WHEN 6 THEN 'FIN' WHEN 7 THEN 'RST,ACK' WHEN 8 THEN 'FIN,PSH,URG' WHEN 9 THEN 'NONE' WHEN 10 THEN 'FIN,SYN' WHEN 11 THEN 'SYN,RST' ELSE 'SYN' END",
    "inbound_zone": "CASE user_id % 3 WHEN 0 THEN 'wan1-zone' WHEN 1 THEN 'lan-zone' END",
    "outbound_zone": "CASE k % 4 WHEN 0 THEN 'internal-zone' WHEN 1 THEN 'dmz_network' END",
    "translated_dst_ip": "CASE WHEN k % 9 = 0 THEN '10.12.0.' || CAST(k % 5 + 1 AS {string}) END",
    "translated_dst_port": "CAST(NULL AS INT)",
    "action_reason": "CASE WHEN k % 10 = 3 THEN 'blocked by spi' END",
    "event_outcome": "CAST(NULL AS {string})",
    "safe_message_excerpt": "''",
    "parse_status": "'parsed'",
}


#: A second mapping, for rules whose services or short groups the first has not: other ports, and sources that stay for 200 seconds.
OTHER_COLUMNS = COLUMNS | {
    "src_ip": "'45.' || CAST(83 + no % 3 AS {string}) || '.' || CAST(CAST(floor(no / 2000) AS BIGINT) % 256 AS {string}) || '.' || CAST(user_id % 5 + 1 AS {string})",
    "dst_port": "CAST(CASE k % 10 WHEN 0 THEN 1433 WHEN 1 THEN 1521 WHEN 2 THEN 5432 WHEN 3 THEN 9200 WHEN 4 THEN 27017 WHEN 5 THEN 6443 WHEN 6 THEN 10250 WHEN 7 THEN 21 WHEN 8 THEN 20 ELSE 2376 END AS INT)",
    "tcp_flags": "CASE no % 12 WHEN 5 THEN 'ACK' ELSE 'SYN' END",
}


def canonical_events(spark: SparkSession, sf_dir: str, columns: dict[str, str] = COLUMNS) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("no"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )
    return raw.select(*[F.expr(sql.replace("{string}", "STRING")).alias(name) for name, sql in columns.items()])


def featured_events(spark: SparkSession, sf_dir: str, columns: dict[str, str] = COLUMNS) -> DataFrame:
    return with_features(canonical_events(spark, sf_dir, columns))


def canonical_sql(columns: dict[str, str] = COLUMNS) -> str:
    made = ", ".join(f"{sql.replace('{string}', 'VARCHAR')} AS {name}" for name, sql in columns.items())
    return f"(SELECT {made} FROM (SELECT event_id AS no, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"
