"""What exposure incidents show: a disposition of each, groups of those that belong together, and the priority of exposed assets.

Input: ``facts`` as in rollups, with the incident's severity, confidence, first_us and last_us in ``incidents``.

Defined cases: an incident without events is to be reviewed and keeps its severity; one without allowed events keeps its severity too; an event
counts once in an incident and once in a group; unknown severities rank lowest. Groups need one source, one service and one action; other
incidents are in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import routing
from .rollups import EXPOSURE
from .store import severity_rank

#: Strengths of evidence, weakest first, and how much of a list is shown.
STRENGTHS = ("syn_only", "single_packet_non_syn", "multi_packet_unidirectional", "payload_bearing_unidirectional", "bidirectional_transport", "application_evidence")
WEAK, PROVEN = STRENGTHS[:2], STRENGTHS[4:]
GROUP_SECONDS, SHOWN_MEMBERS, SHOWN_PORTS, SHOWN_ADDRESSES, SHOWN_EVIDENCE = 300, 25, 15, 10, 5


def strength_rank(strength: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in STRENGTHS]), strength) - 1


def translated() -> Column:
    return (F.coalesce(F.trim("translated_dst_ip"), F.lit("")) != "") | F.col("translated_dst_port").isNotNull()


def dispositions(incidents: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each exposure incident, measured on its allowed events if it has any. Events without packet counts stand for one packet each."""
    incidents = incidents.where(F.col("family").isin(*EXPOSURE))
    one = rows.where(F.col("family").isin(*EXPOSURE)).dropDuplicates(["incident_id", "event_id"])
    whole = one.groupBy("incident_id").agg(F.count("*").alias("n_events"), F.count_if("allowed").alias("n_allowed"), F.count_if("blocked").alias("n_blocked"))
    measured = one.join(whole.select("incident_id", "n_allowed"), "incident_id").where("allowed OR n_allowed = 0").drop("n_allowed")
    first = F.min_by(F.struct("eff_dst", "eff_port", "critical_port", "sensitive_service"), "event_id").alias("p")
    seen = measured.groupBy("incident_id").agg(first, F.bool_or(translated()).alias("nat_observed"), F.coalesce(F.bool_or("trans_private"), F.lit(False)).alias("inward"))
    shown = measured.select("incident_id", "event_id", F.row_number().over(W.partitionBy("incident_id").orderBy("event_id")).alias("r")).where(F.col("r") <= SHOWN_EVIDENCE)
    shown = shown.groupBy("incident_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("evidence"))
    strength = routing.evidence(incidents, measured)
    out = incidents.select("incident_id", F.col("severity").alias("told"), "confidence").join(strength, "incident_id").join(whole, "incident_id", "left").join(seen, "incident_id", "left").join(shown, "incident_id", "left")
    weak, proven = F.col("strength").isin(*WEAK), F.col("strength").isin(*PROVEN)
    sensitivity = F.when(F.col("p.critical_port"), "critical_management").when(F.col("p.sensitive_service").isNotNull(), "sensitive_remote_service").otherwise("other")
    judged = F.when(F.col("p.critical_port"), F.when(proven, "critical").otherwise("high")).when(weak & ~F.col("inward"), "medium").otherwise("high")
    direction = F.when(F.col("n_events").isNull(), "unknown").when(proven, "bidirectional_observed").when(F.col("strength") == "payload_bearing_unidirectional", "inbound_only_payload_bearing").otherwise("outbound_only_single_packet")
    return out.select(
        "incident_id", F.when(F.col("n_events").isNull(), "needs_review").otherwise("suspicious_activity").alias("verdict"),
        F.when(F.coalesce("n_allowed", F.lit(0)) > 0, judged).otherwise(F.col("told")).alias("severity"), "confidence", "strength", direction.alias("direction"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "n_allowed", "n_blocked")], F.coalesce("nat_observed", F.lit(False)).alias("nat_observed"),
        F.col("p.sensitive_service").alias("service"), sensitivity.alias("sensitivity"), F.col("p.eff_dst").alias("address"), F.col("p.eff_port").alias("port"), F.coalesce("evidence", F.lit("")).alias("evidence"),
    )


def groups(incidents: DataFrame, rows: DataFrame, judged: DataFrame, seconds: int = GROUP_SECONDS) -> DataFrame:
    """Exposure incidents of one exact source, service, action and translation, in runs without a pause of over ``seconds``.

    Incidents are reduced to one row each before they are put in order."""
    own = rows.where(F.col("family").isin(*EXPOSURE))
    name = F.coalesce("sensitive_service", F.lit(""))
    of = own.groupBy("incident_id").agg(
        F.min(F.when(F.col("src_ip") != "", F.col("src_ip"))).alias("src_ip"), F.max(F.when(F.col("src_ip") != "", F.col("src_ip"))).alias("_src"), F.min(name).alias("service"), F.max(name).alias("_service"),
        F.bool_and("allowed").alias("_a"), F.bool_and("blocked").alias("_b"), F.bool_or(translated()).alias("nat_observed"),
    )
    of = of.where("src_ip = _src AND service = _service AND service <> '' AND (_a OR _b)").select("incident_id", "src_ip", "service", F.when(F.col("_a"), "allowed").otherwise("blocked").alias("action_state"), "nat_observed")
    key = ["src_ip", "service", "action_state", "nat_observed"]
    members = of.join(incidents.select("incident_id", "first_us", "last_us"), "incident_id")
    order = W.partitionBy(*key).orderBy("first_us", "incident_id")
    new = F.col("first_us") > F.max("last_us").over(order.rowsBetween(W.unboundedPreceding, -1)) + seconds * 1_000_000
    members = members.withColumn("_new", F.coalesce(new, F.lit(False)).cast("long")).withColumn("burst", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    at = [*key, "burst"]
    joined = members.join(judged.select("incident_id", "severity", "confidence", "strength", "verdict"), "incident_id")
    heads = joined.groupBy(*at).agg(
        F.count("*").alias("n_members"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"),
        F.max("confidence").alias("confidence"), F.max_by("strength", strength_rank(F.col("strength"))).alias("strength"), F.bool_or(F.col("verdict") == "needs_review").alias("_review"),
    )
    place = F.row_number().over(W.partitionBy(*at).orderBy("incident_id"))
    named = members.withColumn("_r", place).where(F.col("_r") <= SHOWN_MEMBERS).groupBy(*at).agg(F.array_join(F.array_sort(F.collect_list("incident_id")), ",").alias("members"))
    told = members.select("incident_id", *at).join(own.select("incident_id", "event_id", "allowed", "blocked", "eff_port", "eff_dst"), "incident_id").dropDuplicates([*at, "event_id"])
    counts = told.groupBy(*at).agg(F.count("*").alias("n_events"), F.count_if("allowed").alias("n_allowed"), F.count_if("blocked").alias("n_blocked"))
    out = heads.join(named, at).join(counts, at)
    for column, shown, alias in (("eff_port", SHOWN_PORTS, "ports"), ("eff_dst", SHOWN_ADDRESSES, "addresses")):
        values = told.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).select(*at, column).distinct()
        first = values.withColumn("_r", F.row_number().over(W.partitionBy(*at).orderBy(column))).where(F.col("_r") <= shown)
        out = out.join(first.groupBy(*at).agg(F.array_join(F.array_sort(F.collect_list(column)).cast("array<string>"), ",").alias(alias)), at, "left")
    return out.withColumn("verdict", F.when(F.col("_review"), "needs_review").otherwise("suspicious_activity")).drop("_review")


def asset_priority(port_is_critical: Column, strength: Column) -> Column:
    """P1 to P3: by whether the asset's first port manages a whole system, and by the evidence."""
    proven, weak = strength.isin(*PROVEN), strength.isin(*WEAK)
    return F.when(port_is_critical, F.when(proven, "P1").otherwise("P2")).otherwise(F.when(weak, "P3").otherwise("P2"))
