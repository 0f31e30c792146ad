"""Facts and hydrated evidence of incidents against a plain reading; queries against their SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.operators import facts
from netquarry.plans import queries

from .test_engine import events

RULES = [
    ("ssh_probe", "service_probing"), ("subnet_sweep", "network_scanning"), ("inbound_sensitive_service_allowed", "firewall_exposure"), ("spi_anomaly_burst", "network_anomaly"),
    ("spi_followed_by_allowed_connection", "network_intrusion_candidate"), ("blocked_then_allowed_same_service", "network_intrusion_candidate"),
]
HEAD = "incident_id string, rule string, family string, primary_entity string, first_us long, last_us long, n_targets long"
FLOW = ("packets", "bytes", "duration_ms", "translated_src_ip", "translated_src_port", "nat_type")


def flows(spark, rows):
    """Featured events with the fields of flows; each row's own, or null."""
    kinds = [T.LongType()] * 3 + [T.StringType(), T.IntegerType(), T.StringType()]
    schema = T.StructType([T.StructField("event_id", T.StringType()), *[T.StructField(n, k) for n, k in zip(FLOW, kinds, strict=True)]])
    more = spark.createDataFrame([(f"E{i:05}", *[r.get(n) for n in FLOW]) for i, r in enumerate(rows)], schema)
    return events(spark, [{k: v for k, v in r.items() if k not in FLOW} for r in rows]).join(more, "event_id")


def plain(rule, family, signals, own, context):
    """profile and facts of one incident; own: rows of events."""
    types, families = {rule, *(s[0] for s in signals)}, {family, *(s[1] for s in signals)}
    sequences = sorted(types & {"scan_followed_by_allowed_connection", "blocked_then_allowed_same_service", "spi_followed_by_allowed_connection"})
    no, ok = sum(r["action"] == "block" for r in own), sum(r["action"] == "pass" for r in own)
    first = lambda values: sorted({v for v in values if v not in (None, "", " ")})[:20]
    if sequences:
        return {"profile": "sequence", "sequence_types": sequences, "n_events": len(own), "n_blocked": no, "n_allowed": ok, "ports": None, "n_targets": None, "compromise_proven": False}
    if families & {"firewall_exposure", "firewall_policy"}:
        multi, size, longest = sum(r["action"] == "pass" and (r["packets"] or 0) > 1 for r in own), sum(r["bytes"] or 0 for r in own), max([r["duration_ms"] or 0 for r in own], default=0)
        nat = sum(any(r[c] not in (None, "", " ") for c in ("translated_dst_ip", "translated_src_ip", "nat_type")) for r in own)
        return {
            "profile": "firewall_exposure", "n_events": len(own), "n_blocked": no, "n_allowed": ok, "ports": first(r["dst_port"] for r in own), "sources": first(r["src_ip"] for r in own),
            "external_sources": first(r["src_ip"] for r in own if not r["src_ip"].startswith("10.")), "eff_ips": first(r["translated_dst_ip"] if r["translated_dst_ip"] not in (None, "", " ") else r["dst_ip"] for r in own),
            "n_nat": nat, "packets": sum(r["packets"] or 0 for r in own), "bytes": size, "max_duration_ms": longest, "n_multi_packet": multi, "n_single_packet": sum(r["action"] == "pass" and r["packets"] == 1 for r in own),
            "service": next((s for p in first(r["dst_port"] for r in own) if (s := {22: "ssh", 3389: "rdp", 445: "smb"}.get(p))), None) if own else None, "policy_allow": ok > 0,
            "related_flow": context, "transport_activity": multi > 0 or size > 200 or longest > 1000 or context, "syn_only": None, "protocols": None,
        }
    if families & {"network_scanning", "service_probing"}:
        tcp = [r for r in own if r["protocol"] == "tcp"]
        syn = sum(r["tcp_flags"] == "SYN" for r in tcp)
        return {"profile": "scan_probe", "n_events": len(own), "n_blocked": no, "n_allowed": None, "n_targets": 7, "ports": first(r["dst_port"] for r in own), "protocols": first(r["protocol"].upper() for r in own if r["protocol"]), "all_blocked": bool(own) and no == len(own), "n_syn": syn, "syn_only": bool(tcp) and syn == len(tcp), "bytes": None}
    return {"profile": "generic", "n_events": None, "primary_entity": None, "first_us": None, "incident_type": rule}


def test_facts_are_those_of_a_plain_reading(spark):
    rng = random.Random(5)
    rows, incidents, members, held, want = [], [], [], [], {}
    for i in range(40):
        rule, family = rng.choice(RULES)
        signals = rng.sample(RULES, rng.choice([0, 0, 1, 2]))
        n = rng.choice([0, 1, 3, 60])
        own = [dict(
            ts_us=i * 10**10 + j, src_ip=rng.choice(["10.1.1.1", "45.1.1.1", f"46.1.{i}.{j}"]), dst_ip=f"10.{i}.1.{rng.randrange(40)}", dst_port=rng.choice([22, 3389, 445, 60000 + j, None]), protocol=rng.choice(["tcp", "tcp", "udp", None]), tcp_flags=rng.choice(["SYN", "SYN", "ACK"]),
            action=rng.choice(["block", "block", "pass", None]), translated_dst_ip=rng.choice([None, "", " ", "10.9.9.9"]), src_port=1000 + j, packets=rng.choice([None, 1, 2]), bytes=rng.choice([None, 0, 90]), duration_ms=rng.choice([None, 5, 2000 if i % 3 == 0 else 0]), translated_src_ip=rng.choice([None, " ", "9.9.9.9"]), nat_type=rng.choice([None, "", "snat"]),
        ) for j in range(n)]
        if n == 1 and i % 2:  # quiet ones
            own[0] |= dict(packets=1, bytes=1, duration_ms=1, protocol="tcp", tcp_flags="SYN", action="block", dst_port=22)
        context = bool(n) and i % 4 == 1
        incidents.append((f"I{i}", rule, family, "45.1.1.1", i, i + 1, 7))
        members += [(f"I{i}", *s) for s in signals]
        held += [(f"I{i}", f"E{len(rows) + j:05}") for j in range(n)] * 2
        rows += own
        if context:
            rows.append({**own[0], "ts_us": own[0]["ts_us"] + 1_000_000, "src_ip": own[0]["dst_ip"], "dst_ip": own[0]["src_ip"], "src_port": own[0]["dst_port"], "dst_port": own[0]["src_port"], "translated_dst_ip": None, "protocol": own[0]["protocol"]})
        want[f"I{i}"] = plain(rule, family, signals, own, context)
    args = (spark.createDataFrame(incidents, HEAD), spark.createDataFrame(members, "incident_id string, rule string, family string"), spark.createDataFrame(held, "incident_id string, event_id string"))
    all_events = flows(spark, rows)
    got = {r.incident_id: r.asDict() for r in facts.facts(*args, all_events).collect()}
    assert set(got) == set(want) and len({w["profile"] for w in want.values()}) == 4
    for i, w in want.items():
        assert {k: got[i][k] for k in w} == w, i
    assert facts.facts(args[0].limit(0), args[1].limit(0), args[2], all_events).isEmpty()


def test_hydrated_incidents_keep_counts_and_bounded_evidence(spark):
    rows = [{"ts_us": i, "safe_message_excerpt": "x" * 600 if i else None} for i in range(6)]
    incidents = spark.createDataFrame([("I", "r"), ("J", "r")], "incident_id string, rule string")
    members = spark.createDataFrame([("I", "S1", True), ("I", "S1", False), ("I", "S2", None)], "incident_id string, signal_id string, current boolean")
    held = spark.createDataFrame([("I", f"E{i:05}", i == 1) for i in (0, 1, 1, 2, 9)], "incident_id string, event_id string, current boolean")
    got = {r.incident_id: r for r in facts.hydrated(incidents, members, held, events(spark, rows), 4).collect()}
    i, j = got["I"], got["J"]
    assert (i.n_signals, i.n_current_signals, i.n_events, i.n_current_events) == (2, 1, 4, 1)
    assert [(e.place, e.event_id, len(e.quote)) for e in i.evidence] == [(1, "E00000", 0), (2, "E00001", 500), (3, "E00002", 500)]  # the fourth is not stored any more
    assert (j.n_signals, j.n_events, j.evidence) == (0, 0, None)
    few = facts.hydrated(incidents, members, held, events(spark, rows), 2).where("incident_id = 'I'").select(F.size("evidence").alias("n"), "n_events").first()
    assert (few.n, few.n_events) == (2, 4)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["incident_facts", "hydrated_incidents"])
def test_fact_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in rows.collect()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))
