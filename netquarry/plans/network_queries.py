"""Rules and roll-ups by network over events with IPv6 addresses, spelled in several ways; with SQL that knows the networks of the mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups, rules, scratch
from .lowering import COLUMNS, canonical_sql, featured_events
from .queries import features_sql, register

_AT = "CAST(1 + no % 60 AS {string})"
#: Two of three sources and targets are IPv6: networks 2a02:8071:0:a::/64 and 2a02:8071:0:b::/64 look at 2001:db8::/64 and fd00:0:0:7::/64.
V6_COLUMNS = COLUMNS | {
    "src_ip": f"CASE WHEN no % 3 = 0 THEN {COLUMNS['src_ip']} WHEN user_id % 2 = 0 THEN '2A02:8071:0:a::' || CAST(user_id % 7 + 1 AS {{string}}) ELSE '2a02:8071::b:0:0:0:' || CAST(user_id % 7 + 1 AS {{string}}) END",
    "dst_ip": f"CASE WHEN no % 3 = 0 THEN {COLUMNS['dst_ip']} WHEN no % 4 = 0 THEN '2001:0db8::' || {_AT} WHEN no % 4 = 1 THEN '2001:DB8:0:0:0:0:0:' || {_AT} ELSE 'fd00:0:0:7::' || {_AT} END",
    "translated_dst_ip": "CAST(NULL AS {string})", "tcp_flags": "'SYN'",
}
_SWEEP = rules.BY_NAME["subnet_sweep"]
#: The networks of the mapping, by the beginnings of its texts.
_NETWORK = "CASE WHEN {ip} LIKE '2A02:%' THEN '2a02:8071:0:a::/64' WHEN {ip} LIKE '2a02:%' THEN '2a02:8071:0:b::/64' WHEN {ip} LIKE '2001:%' THEN '2001:db8::/64' WHEN {ip} LIKE 'fd00:%' THEN 'fd00:0:0:7::/64' ELSE regexp_replace({ip}, '[.][0-9]+$', '.0/24') END"
_FEATURED = f"(SELECT * REPLACE ({_NETWORK.format(ip='dst_ip')} AS net24) FROM {features_sql(canonical_sql(V6_COLUMNS))})"


@register("subnet_sweeps_of_both_families", f"SELECT entity, split_part(corr, '|', 2) AS net, severity, count(*) AS n_signals, max(n) AS most, min(first_us) AS first_us, max(last_us) AS last_us FROM ({rules.rule_sql(_SWEEP, _FEATURED)}) GROUP BY ALL")
def subnet_sweeps_of_both_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps of IPv4 and IPv6 networks: how often the rule fires for each source and network."""
    found = rules.evaluate(featured_events(spark, sf_dir, V6_COLUMNS), _SWEEP)
    return found.groupBy("entity", F.split_part("corr", F.lit("|"), F.lit(2)).alias("net"), "severity").agg(F.count("*").alias("n_signals"), F.max("n").alias("most"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


_ID = "src_ip || '-' || CAST(dst_port AS {string}) || '-' || CAST(CAST(floor(ts_us / 100000000) AS BIGINT) AS {string})"
_LIST = "array_to_string(list_sort(list(DISTINCT {x})), ',')"


@register("recon_groups_of_both_families", f"""WITH facts AS MATERIALIZED (SELECT {_ID.replace('{string}', 'VARCHAR')} AS incident_id, {_NETWORK.format(ip='src_ip')} AS cidr, * FROM {_FEATURED}),
own AS (SELECT *, 'network_scanning' AS family FROM facts WHERE incident_id IN (SELECT incident_id FROM facts GROUP BY incident_id HAVING bool_and(blocked))),
part AS (SELECT incident_id, cidr, min(ts_us) AS a, max(ts_us) AS z, CASE WHEN count(service) > 0 THEN 'services:' || {_LIST.format(x='service')} ELSE 'ports:' || {_LIST.format(x='dst_port')} END AS scope FROM own GROUP BY incident_id, cidr),
o AS (SELECT *, max(z) OVER (PARTITION BY cidr, scope ORDER BY a, incident_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM part),
i AS (SELECT *, sum(CASE WHEN a > until + 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY cidr, scope ORDER BY a, incident_id) AS island FROM o)
SELECT cidr, family, scope, count(DISTINCT src_ip) AS n_sources, count(DISTINCT event_id) AS n_events, count(DISTINCT dst_ip) AS n_targets, {_LIST.format(x='dst_port')} AS ports, min(ts_us) AS first_us, max(ts_us) AS last_us, array_to_string(list_sort(list(DISTINCT src_ip))[1:5], ',') AS sources
FROM own JOIN i USING (incident_id, cidr) GROUP BY cidr, family, scope, island""")
def recon_groups_of_both_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of wholly blocked reconnaissance by source network, IPv6 ones too."""
    rows = featured_events(spark, sf_dir, V6_COLUMNS).withColumns({"incident_id": F.expr(_ID.replace("{string}", "STRING")), "family": F.lit("network_scanning")})
    return rollups.recon_groups(scratch.stored(rows, "facts"))
