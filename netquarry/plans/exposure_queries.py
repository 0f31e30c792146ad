"""Queries over exposure incidents that a fixed mapping makes of the events, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import features_sql
from ..operators import exposure, scratch
from .incident_queries import _ENDS, _NAT, _RELATED
from .lowering import COLUMNS, canonical_sql, featured_events
from .queries import register

#: A mapping with a pause of 400 seconds after each 200.
_PAUSED = COLUMNS | {"ts_us": "CAST(floor(no / 10) AS BIGINT) * 1000000 + CAST(floor(no / 2000) AS BIGINT) * 400000000"}
FEATURED = features_sql(canonical_sql(_PAUSED))
_STRETCH = "CAST(floor(ts_us / 50000000) AS BIGINT)"
_ID = f"'EXP-' || src_ip || '-' || CAST(eff_port AS {{string}}) || '-' || CAST({_STRETCH} AS {{string}}) || CASE WHEN {_STRETCH} % 3 = 0 THEN '' WHEN allowed THEN '-a' ELSE '-b' END"
_MINE = "sensitive_service IS NOT NULL"
_TOLD = "CASE WHEN eff_port % 2 = 0 THEN 'low' ELSE 'critical' END"
_FACTS = f"""WITH facts AS MATERIALIZED (SELECT {_ID.replace('{string}', 'VARCHAR')} AS incident_id, *, {_TOLD} AS severity FROM {FEATURED} WHERE {_MINE}),
incidents AS MATERIALIZED (SELECT incident_id, severity AS told, min(ts_us) AS first_us, max(ts_us) AS last_us, 0.5::DOUBLE + CAST(count(*) % 40 AS DOUBLE) / 100 AS confidence, count(*) AS n_events, count(*) FILTER (WHERE allowed) AS n_allowed, count(*) FILTER (WHERE blocked) AS n_blocked FROM facts GROUP BY incident_id, severity),
measured AS MATERIALIZED (SELECT f.* FROM facts f JOIN incidents USING (incident_id) WHERE allowed OR n_allowed = 0), e AS (SELECT incident_id, event_id, {_ENDS} FROM measured),
back AS (SELECT DISTINCT a.incident_id FROM e a JOIN e c ON a.incident_id = c.incident_id AND a.event_id < c.event_id AND {_RELATED}),
m AS (SELECT incident_id, CASE WHEN bool_or(has_syn AND (has_ack OR has_rst OR has_fin)) OR incident_id IN (SELECT incident_id FROM back) THEN 4 WHEN bool_or(tcp_flags LIKE '%PSH%' OR tcp_flags LIKE '%URG%') THEN 3 WHEN count(*) > 1 THEN 2 WHEN min(tcp_flags) = 'SYN' THEN 0 ELSE 1 END AS power,
bool_or({_NAT}) AS nat_observed, bool_or(trans_private) AS inward, arg_min(sensitive_service, event_id) AS service, arg_min(critical_port, event_id) AS critical, arg_min(eff_dst, event_id) AS address, arg_min(eff_port, event_id) AS port, array_to_string(list_sort(list(event_id))[1:5], ',') AS evidence FROM measured GROUP BY incident_id),
d AS MATERIALIZED (SELECT incident_id, 'suspicious_activity' AS verdict, CASE WHEN n_allowed = 0 THEN told WHEN critical AND power >= 4 THEN 'critical' WHEN critical OR inward OR power > 1 THEN 'high' ELSE 'medium' END AS severity, confidence, power,
['syn_only', 'single_packet_non_syn', 'multi_packet_unidirectional', 'payload_bearing_unidirectional', 'bidirectional_transport'][power + 1] AS strength, CASE power WHEN 4 THEN 'bidirectional_observed' WHEN 3 THEN 'inbound_only_payload_bearing' ELSE 'outbound_only_single_packet' END AS direction,
n_events, n_allowed, n_blocked, nat_observed, service, CASE WHEN critical THEN 'critical_management' ELSE 'sensitive_remote_service' END AS sensitivity, address, port, evidence FROM incidents JOIN m USING (incident_id))"""


def _facts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = featured_events(spark, sf_dir, _PAUSED).where(_MINE).select(F.expr(_ID.replace("{string}", "STRING")).alias("incident_id"), "*", F.expr(_TOLD).alias("severity"), F.lit("firewall_exposure").alias("family"))
    rows = scratch.stored(rows, "exposures")
    return rows, rows.groupBy("incident_id", "family", "severity").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), (0.5 + (F.count("*") % 40).cast("double") / 100).alias("confidence"))


@register("exposure_dispositions", f"{_FACTS} SELECT * EXCLUDE (power) FROM d")
def exposure_dispositions(spark, sf_dir):
    """What each exposure incident shows."""
    rows, found = _facts(spark, sf_dir)
    return exposure.dispositions(found, rows)


@register("exposure_groups", f"""{_FACTS}, k AS (SELECT incident_id, min(src_ip) AS src_ip, min(sensitive_service) AS service, CASE WHEN bool_and(allowed) THEN 'allowed' WHEN bool_and(blocked) THEN 'blocked' END AS action_state, bool_or({_NAT}) AS nat_observed FROM facts GROUP BY incident_id),
o AS (SELECT k.*, first_us, last_us, max(last_us) OVER (PARTITION BY src_ip, service, action_state, nat_observed ORDER BY first_us, incident_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM k JOIN incidents USING (incident_id) WHERE action_state IS NOT NULL),
i AS MATERIALIZED (SELECT *, CAST(sum(CASE WHEN first_us > until + 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, service, action_state, nat_observed ORDER BY first_us, incident_id) AS BIGINT) AS burst FROM o),
h AS (SELECT src_ip, i.service, action_state, i.nat_observed, burst, count(*) AS n_members, min(first_us) AS first_us, max(last_us) AS last_us, arg_max(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity, max(confidence) AS confidence, arg_max(strength, power) AS strength,
array_to_string(list_sort(list(incident_id))[1:25], ',') AS members FROM i JOIN d USING (incident_id) GROUP BY ALL),
t AS (SELECT src_ip, service, action_state, nat_observed, burst, count(*) AS n_events, count(*) FILTER (WHERE allowed) AS n_allowed, count(*) FILTER (WHERE blocked) AS n_blocked, array_to_string(list_sort(list(DISTINCT eff_port))[1:15], ',') AS ports, array_to_string(list_sort(list(DISTINCT eff_dst))[1:10], ',') AS addresses
FROM (SELECT i.src_ip, i.service, i.action_state, i.nat_observed, i.burst, f.allowed, f.blocked, f.eff_port, f.eff_dst FROM i JOIN facts f USING (incident_id)) GROUP BY ALL)
SELECT *, 'suspicious_activity' AS verdict FROM h JOIN t USING (src_ip, service, action_state, nat_observed, burst)""")
def exposure_groups(spark, sf_dir):
    """Exposure incidents that belong together."""
    rows, found = _facts(spark, sf_dir)
    return scratch.stored(exposure.groups(found, rows, scratch.stored(exposure.dispositions(found, rows), "dispositions")), "groups")
