"""What becomes of an incident: its route, the strength of its evidence, its ATT&CK context, its report and the digests of minor ones.

``facts``: see rollups. ``rules``: (incident_id, rule) of all signals of the incidents.

Defined cases: an incident without events gets the route of one that is not wholly blocked, and the weakest evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import relations

#: Rules whose incidents always get a row of their own; families and services with an ATT&CK technique; flags.
HIGH_VALUE = (
    "inbound_sensitive_service_allowed", "critical_management_service_exposed", "dnat_sensitive_service_exposure", "wan_to_lan_sensitive_service_allowed", "wan_to_dmz_administrative_service_allowed",
    "blocked_then_allowed_same_service", "multi_source_allowed_sensitive_service", "scan_followed_by_allowed_connection", "spi_followed_by_allowed_connection",
)
ENUMERATION = ("network_scanning", "service_probing", "lateral_movement_candidate")
REMOTE_ACCESS = ("ssh", "rdp", "telnet", "vpn")
RESPONSE, PAYLOAD = ("ACK", "RST", "FIN"), ("PSH", "URG")


def _has(*flags: str) -> Column:
    return F.arrays_overlap(F.split(F.coalesce("tcp_flags", F.lit("")), ","), F.array(*[F.lit(x) for x in flags]))


def desynchronized(rows: DataFrame, context: DataFrame) -> DataFrame:
    """(incident_id) of anomalies with an inspection's block of a reply without SYN, to which an allowed flow among the incident's context (with the event columns) is related."""
    replies = rows.where("family = 'network_anomaly' AND spi").where(_has(*RESPONSE) & ~_has("SYN"))
    one = relations._keyed(replies, True, ["incident_id"]).distinct()
    other = relations._keyed(context.where("allowed"), False, ["incident_id"]).distinct()
    fits = (F.col("a._p") == F.col("c._p")) | F.col("a._p").isNull() | F.col("c._p").isNull()
    return one.alias("a").join(other.alias("c"), (F.col("a.incident_id") == F.col("c.incident_id")) & (F.col("a._key") == F.col("c._key")) & fits, "left_semi").select("incident_id").distinct()


def routes(incidents: DataFrame, rules: DataFrame, rows: DataFrame, context: DataFrame) -> DataFrame:
    """(incident_id, route, reason)."""
    high = rules.where(F.col("rule").isin(*HIGH_VALUE)).groupBy("incident_id").agg(F.min("rule").alias("_high"))
    seen = rows.groupBy("incident_id").agg(F.bool_or("allowed").alias("_ok"), F.bool_and("blocked").alias("_blocked"))
    out = incidents.select("incident_id", "family", "severity").join(high, "incident_id", "left").join(seen, "incident_id", "left").join(desynchronized(rows, context).withColumn("_lost", F.lit(True)), "incident_id", "left")
    cases = (
        (F.col("_high").isNotNull(), "individual_triage", F.concat(F.lit("high_value_rule:"), "_high")), (F.col("_ok"), "individual_triage", F.lit("allowed_connection_observed")),
        (F.col("_lost"), "store_only", F.lit("verified_spi_state_desynchronization")), (~F.coalesce("_blocked", F.lit(False)), "individual_triage", F.lit("not_fully_blocked_conservative")),
        ((F.col("family") == "network_scanning") & (F.col("severity") == "low"), "digest", F.lit("low_severity_fully_blocked_scanner")), (F.lit(True), "deterministic_report", F.lit("fully_blocked_reconnaissance")),
    )
    route, reason = F, F
    for when, to, why in cases:
        route, reason = route.when(when, F.lit(to)), reason.when(when, why)
    return out.select("incident_id", route.alias("route"), reason.alias("reason"))


def evidence(incidents: DataFrame, rows: DataFrame) -> DataFrame:
    """(incident_id, strength): what the transport shows, an event counted once. Canonical events without packet counts stand for one packet each."""
    one = rows.dropDuplicates(["incident_id", "event_id"])
    seen = one.groupBy("incident_id").agg(F.count("*").alias("_n"), F.bool_or(_has("SYN") & _has(*RESPONSE)).alias("_shook"), F.bool_or(_has(*PAYLOAD)).alias("_sent"), F.min("tcp_flags").alias("_flags"))
    back = relations.answered(rows).withColumn("_back", F.lit(True))
    both = incidents.select("incident_id").join(seen, "incident_id", "left").join(back, "incident_id", "left")
    strength = F.when(F.col("_n").isNull(), "syn_only").when(F.col("_shook") | F.coalesce("_back", F.lit(False)), "bidirectional_transport").when(F.col("_sent"), "payload_bearing_unidirectional").when(F.col("_n") > 1, "multi_packet_unidirectional").when(F.col("_flags") == "SYN", "syn_only").otherwise("single_packet_non_syn")
    return both.select("incident_id", strength.alias("strength"))


def attack_context(rows: DataFrame) -> DataFrame:
    """(incident_id, technique, tactic, kind) by family, breadth, or a service for remote access (of several the least)."""
    one = rows.groupBy("incident_id", "family").agg(F.count_distinct("dst_port").alias("ports"), F.count_distinct("dst_ip").alias("dsts"), F.min("eff_service").alias("service"))
    broad = F.col("family").isin(*ENUMERATION) | (F.col("ports") >= 3) | (F.col("dsts") >= 3)
    pick = lambda a, b, c=None: F.when(broad, a).when(F.col("service").isin(*REMOTE_ACCESS), b).otherwise(c)
    return one.select("incident_id", pick("T1046", "T1133").alias("technique"), pick("TA0007", "TA0001").alias("tactic"), pick("behavioral", "context", "unsupported").alias("kind"))


def reports(incidents: DataFrame, rows: DataFrame) -> DataFrame:
    """(incident_id, report): a short text of what was seen and blocked: the first ten targets, the first fifteen ports, all services."""
    one = rows.groupBy("incident_id").agg(F.count_distinct("event_id").alias("n"), F.count_distinct(F.when(F.col("blocked"), F.col("event_id"))).alias("b"), F.count_distinct("dst_ip").alias("t"), F.array_sort(F.collect_set("dst_port")).alias("ports"), F.array_sort(F.collect_set("service")).alias("services"))
    first = rows.where("coalesce(dst_ip, '') <> ''").select("incident_id", "dst_ip").distinct().withColumn("_r", F.row_number().over(W.partitionBy("incident_id").orderBy("dst_ip"))).where("_r <= 10")
    first = first.groupBy("incident_id").agg(F.array_join(F.array_sort(F.collect_list("dst_ip")), ", ").alias("targets"))
    all_ = incidents.join(one, "incident_id").join(first, "incident_id", "left")
    or_else = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), F.lit(other))
    more = lambda n, most: F.when(n > most, ", ...").otherwise("")
    ports = F.concat(or_else(F.array_join(F.slice("ports", 1, 15).cast("array<string>"), ", "), "none observed"), more(F.size("ports"), 15))
    targets = F.concat(F.coalesce("targets", F.lit("unknown")), more(F.col("t"), 10))
    told = F.when((F.col("n") > 0) & (F.col("n") == F.col("b")), F.format_string("All %s observed events were blocked by the firewall.", "n")).otherwise(F.format_string("%s of %s observed events were blocked by the firewall.", "b", "n"))
    text = F.concat_ws("\n", F.concat(F.lit("activity: "), "rule", F.lit(" ("), "family", F.lit(")")), F.concat(F.lit("source: "), "entity"), F.format_string("events: %s total, %s blocked", "n", "b"),
        F.format_string("distinct targets: %s (%s)", F.col("t"), targets), F.concat(F.lit("ports: "), ports), F.concat(F.lit("services: "), or_else(F.array_join("services", ", "), "none classified")), told)
    return all_.select("incident_id", text.alias("report"))


def digests(incidents: DataFrame, rows: DataFrame, routed: DataFrame) -> DataFrame:
    """One row for each rule whose incidents go to the digest: counts, the first twenty sources, the ten commonest ports, the extent."""
    ids = routed.where("route = 'digest'").select("incident_id")
    own, seen = incidents.join(ids, "incident_id", "left_semi"), rows.join(ids, "incident_id", "left_semi")
    first = lambda df, by, n: df.withColumn("_r", F.row_number().over(W.partitionBy("rule").orderBy(*by))).where(F.col("_r") <= n).groupBy("rule")
    sources = first(own.where("coalesce(entity, '') <> ''").select("rule", "entity").distinct(), ["entity"], 20).agg(F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("sources"))
    ports = first(seen.where("dst_port IS NOT NULL").groupBy("rule", "dst_port").agg(F.count("*").alias("n")), [F.desc("n"), "dst_port"], 10)
    ports = ports.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "dst_port"))), lambda x: x["dst_port"].cast("string")), ",").alias("ports"))
    one = own.groupBy("rule").agg(F.count("*").alias("n_incidents"), F.count_distinct(F.nullif("entity", F.lit(""))).alias("n_sources"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    total = seen.groupBy("rule").agg(F.count_if("blocked").alias("n_blocked"), F.count_distinct("dst_ip").alias("n_targets"))
    return one.join(total, "rule").join(sources, "rule", "left").join(ports, "rule", "left")
