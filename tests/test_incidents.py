"""Relatedness, context, roll-ups and routes, against plain readings of their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from netquarry.functions.features import SERVICES
from netquarry.operators import relations, rollups, routing
from netquarry.plans import queries

SERVICE = {p: name for name, ports in SERVICES.items() for p in ports}
ENDS = "src_ip string, src_port int, dst_ip string, dst_port int, translated_dst_ip string, translated_dst_port int, protocol string"


def related(a, b):
    """As it is defined, set by set."""
    if a["protocol"] and b["protocol"] and a["protocol"].upper() != b["protocol"].upper():
        return False
    ends = lambda e: ({e["src_ip"]} - {None, ""}, {e["dst_ip"], e["translated_dst_ip"]} - {None, ""})
    ports = lambda e: ({e["src_port"]} - {None}, {e["dst_port"], e["translated_dst_port"]} - {None})
    (s1, d1), (s2, d2), (p1, q1), (p2, q2) = ends(a), ends(b), ports(a), ports(b)
    reverse = s1 & d2 and d1 & s2
    if not (s1 & s2 and d1 & d2 or reverse):
        return False
    if not (p1 | q1 | p2 | q2):
        return True
    named = lambda x: {SERVICE[p] for p in x if p in SERVICE}
    known = lambda x: {p for p in x if p < 1024 or p in SERVICE}
    return bool(p1 & p2 and q1 & q2 or p1 & q2 and q1 & p2 or named(p1 | q1) & named(p2 | q2) or reverse and (known(q1) & p2 or known(p1) & q2))


def flows(seed, n=40):
    pick = random.Random(seed)
    ips, ports = ["10.0.0.1", "10.0.0.2", "45.1.1.1", "45.1.1.2"], [22, 443, 3389, 50000, 50001, None]
    out = []
    for i in range(n):
        src = pick.choice(ips)
        others = [x for x in ips if x != src]
        out.append({"incident_id": f"I{i % 7}", "event_id": f"E{i:03}", "ts_us": pick.randrange(2000) * 1_000_000, "src_ip": src, "src_port": pick.choice(ports), "dst_ip": pick.choice([*others, None]), "dst_port": pick.choice(ports), "translated_dst_ip": pick.choice([None, None, "", *others]), "translated_dst_port": pick.choice([None, None, 22, 8443]), "protocol": pick.choice(["TCP", "tcp", "UDP", None, ""])})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_context_and_answers_are_those_of_all_pairs(spark, seed):
    rows, others = flows(seed), [{**r, "event_id": f"C{r['event_id']}"} for r in flows(seed + 100)] + flows(seed)[:5]
    schema = f"incident_id string, event_id string, ts_us long, {ENDS}"
    names = [x.split()[0] for x in schema.split(", ")]
    frame = lambda x: spark.createDataFrame([tuple(r[n] for n in names) for r in x], schema)
    want = set()
    for incident in {r["incident_id"] for r in rows}:
        own = [r for r in rows if r["incident_id"] == incident]
        first, last, ids = min(r["ts_us"] for r in own), max(r["ts_us"] for r in own), {r["event_id"] for r in own}
        want |= {(incident, c["event_id"]) for c in others if c["event_id"] not in ids and first - 300_000_000 <= c["ts_us"] <= last + 300_000_000 and any(related(r, c) for r in own)}
    found = relations.context(frame(rows), frame(others).drop("incident_id"))
    assert want and {(r.incident_id, r.event_id) for r in found.collect()} == want
    two = {a["incident_id"] for a in rows for b in rows if a["incident_id"] == b["incident_id"] and a["event_id"] < b["event_id"] and related(a, b)}
    assert {r.incident_id for r in relations.answered(frame(rows)).collect()} == two
    when = {c["event_id"]: c["ts_us"] for c in others}
    for most in (1, 3):
        got = {(r.incident_id, r.place, r.event_id) for r in relations.context(frame(rows), frame(others + others[:9]).drop("incident_id"), most=most).collect()}
        assert got == {(i, n, e) for i in {i for i, _ in want} for n, (_, e) in enumerate(sorted((when[e], e) for j, e in want if j == i)[:most], 1)}
    assert relations.context(frame([]), frame(others).drop("incident_id")).isEmpty() and relations.answered(frame([])).isEmpty()


def test_first_events_of_a_busy_flow_are_found_past_the_incidents_own(spark):
    schema = f"event_id string, ts_us long, {ENDS}"
    busy = [(f"E{i:04}", i * 2_000_000, "45.1.1.1", 50000 + i % 3, "10.0.0.1", 22, None, None, None if i % 50 == 7 else "TCP") for i in range(2500)]  # over an hour's bound
    every = spark.createDataFrame(busy, schema)
    own = every.where("substr(event_id, 3, 1) IN ('1', '2')").withColumn("incident_id", F.concat(F.lit("I"), F.substring("event_id", 2, 2)))
    got = {}
    for r in relations.context(own, every, most=20).collect():
        got.setdefault(r.incident_id, []).append((r.place, r.event_id))
    ids = [r[0] for r in busy]
    assert sorted(got) == ["I01", "I02", "I11", "I12", "I21", "I22"]
    for i, found in got.items():
        mine = [int(e[1:]) for e in ids if e[1:3] == i[1:]]
        near = [e for e in ids if min(mine) - 150 <= int(e[1:]) <= max(mine) + 150 and int(e[1:]) not in mine]
        assert sorted(found) == list(enumerate(near[:20], 1))


def test_only_two_events_make_an_answer(spark):
    one = [(f"I{i}", e, "10.0.0.1", sp, "45.1.1.1", dp, None, None, "TCP") for i, pairs in enumerate([[(50000, 443)], [(50000, 443), (50001, 443)], [(50000, 443), (50000, 443)], [(50000, 3389), (50001, 3389)]]) for e, (sp, dp) in enumerate(pairs)]
    frame = spark.createDataFrame(one + one, f"incident_id string, event_id long, {ENDS}")  # repeated rows of one event are one event
    assert {r.incident_id for r in relations.answered(frame).collect()} == {"I2", "I3"}


def test_bursts_are_anchored_at_their_first_source(spark):
    rows = [("1.2.3.4", 443, 3, 0, 30), ("1.2.3.5", 443, 4, 10, 55), ("1.2.3.6", 443, 9, 50, 70), ("1.2.3.7", 443, 3, 100, 110), ("1.2.3.8", 443, 2, 0, 1), ("1.2.4.4", 443, 9, 0, 30), ("x", 443, 9, 0, 30)]
    frame = spark.createDataFrame([(a, None if a == "x" else 1, p, n, s * 1_000_000, e * 1_000_000) for a, p, n, s, e in rows], "src_ip string, src_v4 long, src_port int, n long, first_us long, last_us long")
    got = sorted((r.sources, r.n_events) for r in rollups.source_port_clusters(frame).collect())
    assert got == [("1.2.3.4,1.2.3.5", 7), ("1.2.3.6,1.2.3.7", 12)]


def test_routes_in_their_order(spark):
    names = ("high", "ok", "lost", "mixed", "low", "rest", "none")
    family = {"lost": "network_anomaly", "low": "network_scanning"}
    incidents = spark.createDataFrame([(x, family.get(x, "service_probing"), "low") for x in names], "incident_id string, family string, severity string")
    schema = f"incident_id string, family string, allowed boolean, blocked boolean, spi boolean, tcp_flags string, {ENDS}"
    row = lambda x, ok, no, spi=False, flags="SYN": (x, family.get(x, "service_probing"), ok, no, spi, flags, "45.1.1.1", 443, "10.0.0.1", 50000, None, None, "TCP")
    rows = spark.createDataFrame([row("high", True, False), row("ok", True, False), row("lost", False, True, True, "RST,ACK"), row("mixed", False, False), row("low", False, True), row("rest", False, True)], schema)
    context = spark.createDataFrame([("lost", True, "10.0.0.1", 50123, "45.1.1.1", 443, None, None, "TCP"), ("low", True, "10.0.0.1", 50000, "45.1.1.1", 443, None, None, "TCP")], f"incident_id string, allowed boolean, {ENDS}")
    rules = spark.createDataFrame([("high", "ssh_probe"), ("high", "dnat_sensitive_service_exposure")], "incident_id string, rule string")
    got = {r.incident_id: (r.route, r.reason.split(":")[0]) for r in routing.routes(incidents, rules, rows, context).collect()}
    assert got["high"] == ("individual_triage", "high_value_rule") and got["ok"] == ("individual_triage", "allowed_connection_observed")
    assert got["lost"][0] == "store_only" and got["mixed"][0] == got["none"][0] == "individual_triage" and got["low"][0] == "digest" and got["rest"][0] == "deterministic_report"


NAMES = ("recon_groups", "source_port_clusters", "exposed_assets_of_incidents", "action_items", "funnel", "incident_context", "incident_routes", "evidence_strength", "attack_context", "incident_reports", "incident_digests")


def test_incident_queries_agree_with_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    for name in NAMES:
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        got = [tuple(r) for r in rows.collect()]
        assert got and sorted(map(repr, got)) == sorted(map(repr, want)), name


def test_context_shuffles_by_key_once(spark):
    """Incidents' events are reduced to keys where the incident is, and meet candidates in one exchange."""
    rows, others = flows(3), [{**r, "event_id": f"C{r['event_id']}"} for r in flows(103)]
    schema = f"incident_id string, event_id string, ts_us long, {ENDS}"
    names = [x.split()[0] for x in schema.split(", ")]
    frame = lambda x: spark.createDataFrame([tuple({**r, "protocol": "TCP"}[n] for n in names) for r in x], schema)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = relations.context(frame(rows), frame(others).drop("incident_id"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    by_key = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "_key" in x.split("hashpartitioning(")[1].split(")")[0]]
    assert len(by_key) == 1, by_key
