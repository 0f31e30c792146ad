"""Dispositions and groups of exposure incidents on small fixtures of their cases."""

import pytest
from pyspark.sql import functions as F

from netquarry.functions.features import with_features
from netquarry.operators import exposure
from netquarry.plans.lowering import COLUMNS

S = 1_000_000
TYPES = {"event_no": "bigint", "ts_us": "bigint", "src_port": "int", "dst_port": "int", "translated_dst_port": "int"}


def facts(spark, incidents):
    """incidents: {id: (severity, [events as dicts])}; each becomes its rows with features, and its head."""
    plain = {"src_ip": "45.83.64.1", "dst_ip": "198.51.100.20", "src_port": 50000, "dst_port": 22, "protocol": "TCP", "action": "pass", "tcp_flags": "SYN", "inbound_zone": "wan1-zone", "parse_status": "parsed"}
    rows = [{**dict.fromkeys(COLUMNS), **plain, "event_id": f"{i}-{n}", "event_no": n, "ts_us": n * S, **e, "incident_id": i, "severity": severity} for i, (severity, events) in incidents.items() for n, e in enumerate(events)]
    schema = ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in (*COLUMNS, "incident_id", "severity"))
    table = with_features(spark.createDataFrame([tuple(r[c] for c in (*COLUMNS, "incident_id", "severity")) for r in rows], schema)).withColumn("family", F.lit("firewall_exposure"))
    heads = [(i, severity, "firewall_exposure", min((e.get("ts_us", n * S) for n, e in enumerate(events)), default=0), max((e.get("ts_us", n * S) for n, e in enumerate(events)), default=0), 0.8) for i, (severity, events) in incidents.items()]
    return spark.createDataFrame(heads, "incident_id string, severity string, family string, first_us long, last_us long, confidence double"), table


def test_dispositions_of_each_case(spark):
    answer = {"src_ip": "198.51.100.20", "dst_ip": "45.83.64.1", "src_port": 22, "dst_port": 50000, "tcp_flags": "ACK"}
    heads, rows = facts(spark, {
        "syn": ("low", [{}]), "push": ("low", [{"tcp_flags": "PSH,ACK"}]), "answered": ("low", [{}, answer]), "docker": ("low", [{"dst_port": 2375}]), "docker shook": ("low", [{"dst_port": 2375, "tcp_flags": "SYN,ACK"}]),
        "inward": ("low", [{"translated_dst_ip": "10.0.0.7"}]), "blocked": ("critical", [{"action": "block"}]), "mixed": ("low", [{"action": "block", "tcp_flags": "SYN,ACK"}, {"dst_port": 3389, "event_id": "z"}]), "none": ("medium", []),
    })
    again = rows.unionByName(rows)  # an event counts once
    got = {r.incident_id: (r.verdict, r.severity, r.strength, r.direction, r.n_events, r.n_allowed, r.sensitivity) for r in exposure.dispositions(heads, again).collect()}
    assert got["syn"] == ("suspicious_activity", "medium", "syn_only", "outbound_only_single_packet", 1, 1, "sensitive_remote_service")
    assert got["push"][1:4] == ("high", "payload_bearing_unidirectional", "inbound_only_payload_bearing")
    assert got["answered"][1:5] == ("high", "bidirectional_transport", "bidirectional_observed", 2)
    assert got["docker"][1] == "high" and got["docker shook"][1] == "critical" and got["docker"][6] == "critical_management"
    assert got["inward"][1:3] == ("high", "syn_only")
    assert got["blocked"][1] == "critical" and got["blocked"][5] == 0
    assert got["mixed"][1:6] == ("medium", "syn_only", "outbound_only_single_packet", 2, 1)
    assert got["none"] == ("needs_review", "medium", "syn_only", "unknown", 0, 0, "other")


def test_groups_need_one_source_service_and_action_and_end_at_pauses(spark):
    at = lambda seconds, **more: {"ts_us": seconds * S, **more}
    heads, rows = facts(spark, {
        "a": ("low", [at(0), at(100, dst_ip="198.51.100.21")]), "b": ("low", [at(400)]), "c": ("low", [at(701)]), "d": ("low", [at(0, action="block")]), "mixed": ("low", [at(0), at(1, action="block")]),
        "two sources": ("low", [at(0), at(1, src_ip="45.83.64.2")]), "two services": ("low", [at(0), at(1, dst_port=3389)]), "no service": ("low", [at(0, dst_port=12345)]),
    })
    got = {(r.members, r.action_state, r.burst, r.n_members, r.n_events, r.first_us // S, r.last_us // S, r.addresses) for r in exposure.groups(heads, rows, exposure.dispositions(heads, rows)).collect()}
    assert got == {("a,b", "allowed", 0, 2, 3, 0, 400, "198.51.100.20,198.51.100.21"), ("c", "allowed", 1, 1, 1, 701, 701, "198.51.100.20"), ("d", "blocked", 0, 1, 1, 0, 0, "198.51.100.20")}
    assert exposure.groups(heads.limit(0), rows.limit(0), exposure.dispositions(heads, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("critical", "strength", "priority"), [(True, "bidirectional_transport", "P1"), (True, "syn_only", "P2"), (False, "syn_only", "P3"), (False, "multi_packet_unidirectional", "P2"), (False, "application_evidence", "P2")])
def test_priority_of_assets(spark, critical, strength, priority):
    assert spark.range(1).select(exposure.asset_priority(F.lit(critical), F.lit(strength))).first()[0] == priority
