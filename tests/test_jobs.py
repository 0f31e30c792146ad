"""Profiles, merged bundles (batch, stream, plain) and stratified selections on hand-made rows; queries of the chain against their SQL."""

import hashlib
import ipaddress
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from netquarry.functions.features import with_features
from netquarry.operators import bundles, campaigns, profiles, scratch, selection
from netquarry.plans import queries
from netquarry.streaming import campaigns as streams

from .test_engine import events


def profiled(spark, rule, family, entity, rows, **more):
    df = events(spark, [{"ts_us": i, **r} for i, r in enumerate(rows)])
    held = df.select(F.lit("I").alias("incident_id"), "event_id")
    found = spark.createDataFrame([("I", rule, family, entity)], "incident_id string, rule string, family string, primary_entity string")
    got = profiles.profiles(found, held, df, **more).collect()
    return (got[0].strategy, json.loads(got[0].profile), got[0]) if got else None


def test_each_strategy_gives_its_profile(spark):
    strategy, p, row = profiled(spark, "scan_followed_by_allowed_connection", "network_intrusion_candidate", "45.1.1.1", [{"dst_port": 22}, {"dst_port": 3306}])
    assert strategy == "source_target_sequence" and p == {
        "actor_entity": "45.1.1.1", "correlation_version": "1", "destination_ports": [3306], "protected_entity": "10.0.0.1", "protocols": ["TCP"], "services": ["SSH"], "strategy": strategy, "target_scopes": [],
    }
    assert row.correlation_key == "scv1:" + hashlib.sha256(json.dumps(p, sort_keys=True, separators=(",", ":")).encode()).hexdigest() and json.dumps(p, sort_keys=True, separators=(",", ":")) == row.profile
    strategy, p, _ = profiled(spark, "dnat_sensitive_service_exposure", "firewall_exposure", "10.0.0.1", [{"src_ip": "45.1.1.1", "dst_port": 22, "translated_dst_ip": "10.5.5.5"}, {"src_ip": "46.1.1.1", "dst_port": 22, "dst_ip": "10.7.7.7", "translated_dst_ip": "10.5.5.5"}])
    assert strategy == "protected_service_exposure" and p["actor_entity"] is None and p["protected_entity"] == "10.5.5.5"
    strategy, p, _ = profiled(spark, "redis_probe", "service_probing", "45.1.1.1", [{"dst_ip": f"10.0.0.{i}", "dst_port": 6379} for i in range(5)])
    assert (strategy, p["services"], p["destination_ports"], p["target_scopes"], p["protected_entity"]) == ("source_service_campaign", ["REDIS"], [], [], None)
    _, p, _ = profiled(spark, "network_scan_vertical", "network_scanning", "45.1.1.1", [{"dst_port": 1000 + i} for i in range(30)])
    assert p["target_scopes"] == ["10.0.0.1"] and p["destination_ports"] == list(range(1000, 1020))
    _, p, _ = profiled(spark, "subnet_sweep", "network_scanning", "45.1.1.1", [{"dst_ip": f"10.0.{i % 2}.{i}", "dst_port": 445} for i in range(6)])
    assert p["target_scopes"] == ["10.0.0.0/24", "10.0.1.0/24"]
    _, p, _ = profiled(spark, "subnet_sweep", "network_scanning", "45.1.1.1", [{"dst_ip": x, "dst_port": 445} for x in ("2001:db8::1", "2001:DB8:0:0:5::", "2001:db8:0:7:1:2:3:4")])
    assert p["target_scopes"] == ["2001:DB8:0:7::/64", "2001:DB8::/64"]


@pytest.mark.parametrize("rule,family,entity,rows", [
    ("distributed_scan", "network_scanning", "10.0.0.1", [{}]),  # its owner is the destination
    ("tcp_null_scan", "network_scanning", "45.1.1.1", [{}]),
    ("ssh_probe", "service_probing", " ", [{"dst_port": 22}]),
    ("ssh_probe", "service_probing", "45.1.1.1", [{"dst_port": 22}, {"dst_port": 22, "protocol": "udp"}]),
    ("ssh_probe", "service_probing", "45.1.1.1", [{"dst_port": 22, "protocol": None}]),
    ("ssh_probe", "firewall_policy", "45.1.1.1", [{"dst_port": 22}, {"dst_port": 22, "dst_ip": "10.0.0.2"}]),
    ("network_scan_horizontal", "network_scanning", "45.1.1.1", [{"dst_port": None}]),
    ("spi_followed_by_allowed_connection", "network_intrusion_candidate", "45.1.1.1", [{"dst_port": 22}, {"dst_port": 22, "dst_ip": "10.0.0.2"}]),
    ("subnet_sweep", "network_scanning", "45.1.1.1", [{"dst_ip": "name", "dst_port": 22}]),
    ("ssh_probe", "service_probing", "45.1.1.1", []),
])
def test_profiles_fail_closed(spark, rule, family, entity, rows):
    assert profiled(spark, rule, family, entity, rows) is None


def test_networks_are_those_of_the_standard_library(spark):
    rng = random.Random(3)
    ips = ["::", "::1", "1::", "fe80::1:2:3", "1:0:0:4::", "0:0:0:1::2", "1:2:3:4:5:6:7:8"]
    for _ in range(60):
        a = ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & (rng.getrandbits(128) if rng.random() < 0.5 else (1 << 128) - (1 << rng.choice([16, 48, 80]))))
        ips += [str(a), a.exploded, str(a).upper()]
    df = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", F.expr(profiles.subnet_sql("ip", "CAST(NULL AS INT)")).alias("net"))
    for r in df.collect():
        assert r.net == str(ipaddress.ip_network(r.ip + "/64", strict=False)), r.ip


ARRIVAL = "key string, job long, arrival_id string, version string, first_us long, last_us long, now_us long, alive boolean, type string, family string, entity string, place long, severity string, confidence double, n_events long, n_signals long, evidence array<string>, complete boolean"


def arrivals(spark, n=160, seed=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        job, first = i // 4, rng.randrange(60) * 10_000
        rows.append((rng.choice("abcde"), job, f"x{i}", rng.choice(["1"] * 9 + ["2", None]), first, first + rng.randrange(-5, 300) * 1000, 1000 + job * 100_000 + (500_000 if job > 25 else 0), rng.choice([True] * 9 + [False, None]), rng.choice("tuv"), "f", rng.choice(["e", None]), rng.choice([3, 2, 1, None]),
                     rng.choice([*bundles.SEVERITY, None, "odd"]), rng.choice([0.5, 0.7, None]), rng.choice([0, 3, None]), rng.choice([1, 0]), rng.choice([None, [], [f"E{rng.randrange(40):02}" for _ in range(rng.randrange(14))]]), rng.choice([True, False, None])))
    rows += [(None, 1, "n", "1", 1, 2, 3, True, *[None] * 9, True), ("a", 1, "z", "1", None, 2, 3, True, *[None] * 9, True)]
    return spark.createDataFrame(rows, ARRIVAL)


@pytest.mark.parametrize("forget_us", [150_000, 10_000_000_000])
def test_bundles_of_a_table_and_of_a_stream_in_several_triggers(spark, tmp_path, forget_us):
    rows = arrivals(spark)
    table = bundles.replay(rows, 200_000, 300_000, forget_us)
    want = sorted(map(repr, table.collect()))
    assert len(want) == 160 and {r.decision for r in table.collect()} == {"first", "merge", "stale", "repair", "new_generation"} and any(r.promoted for r in table.collect())
    for i, (a, b) in enumerate([(0, 9), (10, 19), (20, 29), (30, 99)]):  # a trigger for each file, in order of the arrivals' clock
        rows.where(F.col("job").between(a, b)).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / f"w{i}").glob("part-*"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.run_available(streams.merged(stream, 200_000, 300_000, forget_us, "1 second"), "merged", 300)
    assert sorted(map(repr, got.select(*table.columns).collect())) == want
    assert bundles.replay(rows.limit(0)).count() == 0


def test_state_of_a_forgotten_key_is_dropped(spark, tmp_path):
    rows = arrivals(spark).where("key IS NOT NULL AND first_us IS NOT NULL")
    for i, (key, now) in enumerate([("old", 100_000), ("new", 5_000_000_000), ("new", 9_000_000_000), ("old", 9_500_000_000)]):
        rows.limit(1).withColumns({"key": F.lit(key), "now_us": F.lit(now).cast("long"), "alive": F.lit(True)}).select(*rows.columns).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"w{i}").glob("part-*")).rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.merged(stream, 200_000, 300_000, 1_000_000).writeStream.format("memory").queryName("forgotten").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    removed = sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress if p["stateOperators"])
    said = {(r.key, r.job, r.generation, r.decision) for r in spark.table("forgotten").collect()}
    assert removed >= 1 and {d for _, _, g, d in said if _ is not None} <= {"first", "merge", "stale", "new_generation"} and all(g == 1 for k, _, g, _ in said if k == "old")


def test_evidence_keeps_a_place_for_either_side():
    late = tuple(f"Z{i}" for i in range(10))
    early = tuple(f"A{i}" for i in range(10))
    assert bundles.merged_evidence(early, late) == (*early[:9], "Z0") and bundles.merged_evidence(late, early) == (*early[:9], "Z0")
    assert bundles.merged_evidence((), late) == late and bundles.merged_evidence(("A0",), ("A0", "B")) == ("A0", "B") and bundles.merged_evidence((), ()) == ()


def plain_signals(rows, most):
    by = {}
    for incident, sid, rule, family, main, current in rows:
        by.setdefault(incident, {}).setdefault(sid, [rule, family, False, False])
        by[incident][sid][2] |= bool(main)
        by[incident][sid][3] |= bool(current)
    out = set()
    for incident, own in by.items():
        order = []
        add = lambda ids: order.extend(sorted(ids)[:1]) if not set(sorted(ids)[:1]) <= set(order) else None
        order += sorted(s for s, x in own.items() if x[2])
        add([s for s, x in own.items() if x[3]])
        for f in selection.FAMILIES:
            add([s for s, x in own.items() if x[1] == f])
        for t in sorted(selection.SEQUENCES):
            add([s for s, x in own.items() if x[0] == t])
        order += [s for s in sorted(own) if s not in order]
        out |= {(incident, s) for s in order[:most]}
    return out


@pytest.mark.parametrize("most", [1, 3, 6])
def test_every_stratum_has_its_place(spark, most):
    rng, rows = random.Random(most), []
    for i in range(400):
        rule, family = rng.choice([("spi_followed_by_allowed_connection", "network_intrusion_candidate"), ("ssh_probe", "service_probing"), ("subnet_sweep", "network_scanning"), ("dnat_sensitive_service_exposure", "firewall_exposure"), ("wan", "firewall_policy"), ("tcp", "network_anomaly")])
        rows.append((f"I{rng.randrange(30)}", f"S{i:03}", rule, family, False, rng.choice([True, False, None])))
    rows += [(i, "S9", "tcp", "network_anomaly", True, False) for i in {r[0] for r in rows}]
    df = spark.createDataFrame(rows + rows[:20], "incident_id string, signal_id string, rule string, family string, main boolean, current boolean")
    got = selection.chosen_signals(df, most).collect()
    assert {(r.incident_id, r.signal_id) for r in got} == plain_signals(rows, most) and len(got) == len({r[0] for r in rows}) * most
    assert selection.chosen_signals(df.limit(0), most).isEmpty()


def test_events_of_both_jobs_are_kept(spark):
    rows = [("I", f"E{i}", i, i in (7, 8)) for i in range(9)] + [("J", "E1", 1, None), ("J", "E1", 1, False)]
    df = spark.createDataFrame(rows, "incident_id string, event_id string, ts_us long, current boolean")
    got = sorted((r.incident_id, r.event_id, r.reserved) for r in selection.chosen_events(df, 3).collect())
    assert got == [("I", "E0", True), ("I", "E1", False), ("I", "E7", True), ("J", "E1", True)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["incidents", "raw_incidents", "profile_campaigns", "merged_campaigns", "stream_merged_campaigns", "parsed_events", "ingestion_counts", "container_fingerprints", "exposure_groups", "cleanup_verdicts"])
def test_chain_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in rows.collect()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))
