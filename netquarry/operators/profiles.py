"""Profiles: which campaign an incident belongs to across jobs, by three strategies that fail closed.

  source_target_sequence      sequences of one source against one destination
  protected_service_exposure  exposures of one destination, whoever reached it
  source_service_campaign     scans and probes of one source, by service; narrow ones by destinations too, sweeps by networks
A profile needs one protocol, an actor or a protected destination, and a service or port; what lacks one of them gets none, and is in no campaign.
Destinations, ports and networks become distinct (incident, kind, value) rows by one aggregation, of which each incident keeps the first few, so an
incident's events are never gathered. The key is a digest of the profile's canonical JSON.

Defined cases: incidents without events have no profile; null and blank values are none; more values than ``most`` of a kind are cut in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.features import subnet_sql

VERSION, MOST = "1", 20
#: Types of each strategy, services that hold several, and the key's mark.
SEQUENCES = ("scan_followed_by_allowed_connection", "blocked_then_allowed_same_service", "spi_followed_by_allowed_connection")
EXPOSURES = ("firewall_exposure", "firewall_policy")
FAMILIES = ("network_scanning", "service_probing", "network_anomaly")
BROAD = ("network_scan_horizontal", "low_and_slow_horizontal_scan", "multi_service_sweep", "repeated_blocked_scanner")
NARROW = ("network_scan_vertical", "low_and_slow_vertical_scan", "internal_lateral_scan")
SWEEPS, AMBIGUOUS, MARK = ("subnet_sweep",), ("database", "kubernetes", "docker"), "scv"


def tokens_sql() -> dict[str, str]:
    """What an event tells a profile, by kind; null: nothing."""
    own = f"eff_service IS NOT NULL AND eff_service NOT IN ({', '.join(map(repr, AMBIGUOUS))})"
    return {
        "protocol": "nullif(upper(trim(protocol)), '')", "dst": "nullif(trim(eff_dst), '')", "net": subnet_sql("eff_dst", "eff_v4"), "service": f"CASE WHEN {own} THEN upper(eff_service) END",
        "port": f"CASE WHEN eff_port IS NOT NULL AND NOT coalesce({own}, false) THEN lpad(CAST(eff_port AS {{string}}), 5, '0') END",
    }


V4 = r"CASE WHEN regexp_like(eff_dst, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN 1 END"


def tokens(held: DataFrame, events: DataFrame, most: int = MOST) -> DataFrame:
    """(incident_id, kind, n, first): how many values of each kind an incident's events have, and the first ``most``. held: (incident_id, event_id)."""
    rows = events.withColumn("eff_v4", F.expr(V4))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(sql.replace("{string}", "STRING")).alias("value")) for k, sql in tokens_sql().items()])
    rows = rows.select("event_id", each.alias("_t"))
    distinct = held.select("incident_id", "event_id").join(rows, "event_id").select("incident_id", F.explode("_t").alias("t")).select("incident_id", "t.*").where("value IS NOT NULL").distinct()
    n = distinct.groupBy("incident_id", "kind").agg(F.count("*").alias("n"))
    few = distinct.withColumn("_r", F.row_number().over(W.partitionBy("incident_id", "kind").orderBy("value"))).where(F.col("_r") <= most)
    return few.groupBy("incident_id", "kind").agg(F.array_sort(F.collect_list("value")).alias("first")).join(n, ["incident_id", "kind"])


def profiles(incidents: DataFrame, held: DataFrame, events: DataFrame, version: str = VERSION, most: int = MOST) -> DataFrame:
    """(incident_id, strategy, correlation_key, profile) of the incidents (incident_id, rule, family, primary_entity) that have a profile."""
    wide = tokens(held, events, most).groupBy("incident_id").pivot("kind", list(tokens_sql())).agg(F.first("n").alias("n"), F.first("first").alias("first"))
    x = incidents.select("incident_id", "rule", "family", F.nullif(F.trim("primary_entity"), F.lit("")).alias("actor")).join(wide, "incident_id")
    none = F.array().cast("array<string>")
    first = lambda kind: F.coalesce(f"{kind}_first", none)
    probe = F.col("rule").endswith("_probe") & (F.length("rule") > 6)
    services = F.when(probe, F.array(F.upper(F.expr("left(rule, length(rule) - 6)")))).otherwise(first("service"))
    ports = F.when(probe, none).otherwise(first("port"))
    usable = (F.col("protocol_n") == 1) & ((F.size(services) > 0) | (F.size(ports) > 0))
    to_one = F.col("dst_n") == 1
    sequence = F.col("rule").isin(*SEQUENCES) & F.col("actor").isNotNull() & to_one
    exposure = F.col("family").isin(*EXPOSURES) & to_one
    narrow, sweep = F.col("rule").isin(*NARROW), F.col("rule").isin(*SWEEPS)
    scopes = F.when(sweep, first("net")).when(narrow, first("dst")).otherwise(none)
    campaign = F.col("family").isin(*FAMILIES) & F.col("actor").isNotNull() & (F.col("rule").isin(*BROAD) | probe | ((narrow | sweep) & (F.size(scopes) > 0)))
    strategy = F.when(sequence, "source_target_sequence").when(exposure, "protected_service_exposure").when(campaign, "source_service_campaign")
    x = x.withColumn("strategy", F.when(usable, strategy)).where("strategy IS NOT NULL")
    parts = {
        "actor_entity": F.when(F.col("strategy") != "protected_service_exposure", F.col("actor")), "correlation_version": F.lit(version), "destination_ports": F.transform(ports, lambda p: p.cast("int")),
        "protected_entity": F.when(F.col("strategy") != "source_service_campaign", F.get("dst_first", F.lit(0))), "protocols": first("protocol"), "services": services, "strategy": F.col("strategy"),
        "target_scopes": F.when(F.col("strategy") == "source_service_campaign", F.transform(scopes, F.upper)).otherwise(none),
    }
    x = x.withColumn("profile", F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]), {"ignoreNullFields": "false"}))
    return x.select("incident_id", "strategy", F.concat(F.lit(f"{MARK}{version}:"), F.sha2("profile", 256)).alias("correlation_key"), "profile")


def profiles_sql(incidents: str, held: str, events: str) -> str:
    """The same for DuckDB."""
    quoted = lambda x: ", ".join(f"'{v}'" for v in x)
    each = ", ".join(f"{{'kind': '{k}', 'value': {sql.replace('{string}', 'VARCHAR')}}}" for k, sql in tokens_sql().items())
    of = lambda kind: f"coalesce(list_sort(list(value) FILTER (WHERE kind = '{kind}'))[1:{MOST}], [])"
    return f"""WITH ev AS (SELECT *, {V4.replace('regexp_like', 'regexp_matches')} AS eff_v4 FROM {events}), tok AS (SELECT DISTINCT incident_id, t.kind, t.value FROM (SELECT h.incident_id, unnest([{each}]) AS t FROM {held} h JOIN ev USING (event_id)) WHERE t.value IS NOT NULL),
wide AS (SELECT incident_id, count(*) FILTER (WHERE kind = 'protocol') AS protocol_n, count(*) FILTER (WHERE kind = 'dst') AS dst_n, {', '.join(f'{of(k)} AS {k}_first' for k in tokens_sql())} FROM tok GROUP BY incident_id),
x AS (SELECT i.incident_id, i.rule, i.family, nullif(trim(i.primary_entity), '') AS actor, i.rule LIKE '%\\_probe' ESCAPE '\\' AS probe, i.rule IN ({quoted(NARROW)}) AS narrow, i.rule IN ({quoted(SWEEPS)}) AS sweep, w.* EXCLUDE (incident_id) FROM {incidents} i JOIN wide w USING (incident_id)),
y AS (SELECT *, CASE WHEN probe THEN [upper(left(rule, length(rule) - 6))] ELSE service_first END AS services, CASE WHEN probe THEN [] ELSE port_first END AS ports, CASE WHEN sweep THEN net_first WHEN narrow THEN dst_first ELSE [] END AS scopes FROM x),
z AS (SELECT *, CASE WHEN protocol_n = 1 AND len(services) + len(ports) > 0 THEN CASE WHEN rule IN ({quoted(SEQUENCES)}) AND actor IS NOT NULL AND dst_n = 1 THEN 'source_target_sequence' WHEN family IN ({quoted(EXPOSURES)}) AND dst_n = 1 THEN 'protected_service_exposure'
  WHEN family IN ({quoted(FAMILIES)}) AND actor IS NOT NULL AND (rule IN ({quoted(BROAD)}) OR probe OR ((narrow OR sweep) AND len(scopes) > 0)) THEN 'source_service_campaign' END END AS strategy FROM y),
p AS (SELECT incident_id, strategy, CAST(to_json({{'actor_entity': CASE WHEN strategy <> 'protected_service_exposure' THEN actor END, 'correlation_version': '{VERSION}', 'destination_ports': list_transform(ports, lambda v: CAST(v AS INT)), 'protected_entity': CASE WHEN strategy <> 'source_service_campaign' THEN dst_first[1] END,
  'protocols': protocol_first, 'services': services, 'strategy': strategy, 'target_scopes': CASE WHEN strategy = 'source_service_campaign' THEN list_transform(scopes, lambda v: upper(v)) ELSE [] END}}) AS VARCHAR) AS profile FROM z WHERE strategy IS NOT NULL)
SELECT incident_id, strategy, '{MARK}{VERSION}:' || sha256(profile) AS correlation_key, profile FROM p"""
