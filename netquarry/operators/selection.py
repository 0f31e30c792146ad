"""Bounded selections that keep every stratum visible: places are reserved, the rest is filled in order.

Signals of an incident: its main one, the first of the current job, the first of each family and of each sequence type that matters, then the others in order
of their names. Events: the first of the current job, the first of the others, then by time. A selection is one pass: each row's best stratum by window
functions over the incident, then the first ``most``; so whoever decides a place is the row's least rank, not a loop.

Defined cases: repeated rows of one signal or event count once; a null flag is false; incidents without rows have no selection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .profiles import EXPOSURES, SEQUENCES

#: Families whose signals are kept in sight.
FAMILIES = tuple(sorted((*EXPOSURES, "network_scanning", "service_probing")))
_OTHER = 9_999


def chosen_signals(rows: DataFrame, most: int) -> DataFrame:
    """(incident_id, signal_id, stratum) of rows (incident_id, signal_id, rule, family, main, current). Places are given by stratum, then by signal_id."""
    one = rows.groupBy("incident_id", "signal_id").agg(F.max(F.coalesce("main", F.lit(False))).alias("main"), F.max(F.coalesce("current", F.lit(False))).alias("current"), F.min("rule").alias("rule"), F.min("family").alias("family"))
    first = lambda *by: F.row_number().over(W.partitionBy("incident_id", *by).orderBy("signal_id")) == 1
    place = lambda names, c: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c)).cast("int")
    one = one.withColumns({
        "_current": F.col("current") & first("current"), "_family": F.when(first("family"), F.nullif(place(FAMILIES, "family"), F.lit(0))), "_type": F.when(first("rule"), F.nullif(place(sorted(SEQUENCES), "rule"), F.lit(0))),
    })
    stratum = F.when(F.col("main"), 1).when(F.col("_current"), 2).when(F.col("_family").isNotNull(), 10 + F.col("_family")).when(F.col("_type").isNotNull(), 20 + F.col("_type")).otherwise(_OTHER)
    ranked = one.withColumn("stratum", stratum).withColumn("_r", F.row_number().over(W.partitionBy("incident_id").orderBy("stratum", "signal_id")))
    return ranked.where(F.col("_r") <= most).select("incident_id", "signal_id", "stratum")


def signals_sql(rows: str, most: int) -> str:
    """The same for DuckDB."""
    position = lambda names, c: f"list_position([{', '.join(repr(x) for x in names)}], {c})"
    return f"""SELECT incident_id, signal_id, CAST(stratum AS INT) AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY stratum, signal_id) AS r FROM (
SELECT incident_id, signal_id, CASE WHEN main THEN 1 WHEN current AND row_number() OVER (PARTITION BY incident_id, current ORDER BY signal_id) = 1 THEN 2
  WHEN row_number() OVER (PARTITION BY incident_id, family ORDER BY signal_id) = 1 AND family IN ({', '.join(repr(x) for x in FAMILIES)}) THEN 10 + {position(FAMILIES, 'family')}
  WHEN row_number() OVER (PARTITION BY incident_id, rule ORDER BY signal_id) = 1 AND rule IN ({', '.join(repr(x) for x in SEQUENCES)}) THEN 20 + {position(sorted(SEQUENCES), 'rule')} ELSE {_OTHER} END AS stratum
FROM (SELECT incident_id, signal_id, bool_or(coalesce(main, false)) AS main, bool_or(coalesce(current, false)) AS current, min(rule) AS rule, min(family) AS family FROM {rows} GROUP BY incident_id, signal_id))) WHERE r <= {most}"""


def chosen_events(rows: DataFrame, most: int) -> DataFrame:
    """(incident_id, event_id, reserved) of rows (incident_id, event_id, ts_us, current)."""
    one = rows.groupBy("incident_id", "event_id").agg(F.min("ts_us").alias("ts_us"), F.max(F.coalesce("current", F.lit(False))).alias("current"))
    first = F.row_number().over(W.partitionBy("incident_id", "current").orderBy("ts_us", "event_id")) == 1
    ranked = one.withColumn("reserved", first).withColumn("_r", F.row_number().over(W.partitionBy("incident_id").orderBy(F.when(F.col("reserved"), F.when(F.col("current"), 0).otherwise(1)).otherwise(2), "ts_us", "event_id")))
    return ranked.where(F.col("_r") <= most).select("incident_id", "event_id", "reserved")


def events_sql(rows: str, most: int) -> str:
    """The same for DuckDB."""
    return f"""SELECT incident_id, event_id, reserved FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY CASE WHEN reserved THEN CASE WHEN current THEN 0 ELSE 1 END ELSE 2 END, ts_us, event_id) AS r FROM (
SELECT *, row_number() OVER (PARTITION BY incident_id, current ORDER BY ts_us, event_id) = 1 AS reserved FROM {rows})) WHERE r <= {most}"""
