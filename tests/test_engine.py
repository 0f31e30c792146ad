"""Features, rules, merging and store operators on hand-made rows."""

import ipaddress
import os
import random

import pytest
from pyspark.sql import functions as F

from netquarry.functions.features import with_features
from netquarry.operators import rules, scratch, signals, store, suppression
from netquarry.plans import queries
from netquarry.plans.lowering import COLUMNS

SCHEMA = "event_id string, event_no long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, action string, tcp_flags string, inbound_zone string, outbound_zone string, translated_dst_ip string, translated_dst_port int, action_reason string, event_outcome string, safe_message_excerpt string, parse_status string"
DEFAULT = dict(src_ip="45.83.64.9", dst_ip="10.0.0.1", src_port=49152, dst_port=443, protocol="TCP", action="block", tcp_flags="SYN", inbound_zone=None, outbound_zone=None, translated_dst_ip=None, translated_dst_port=None, action_reason=None, event_outcome=None, safe_message_excerpt="", parse_status="parsed")


def events(spark, rows):
    out = [{**DEFAULT, "event_id": f"E{i:05}", "event_no": i, **r} for i, r in enumerate(rows)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    assert set(names) == set(COLUMNS)
    return with_features(spark.createDataFrame([tuple(r[n] for n in names) for r in out], SCHEMA))


def test_address_classes_are_those_of_the_standard_library(spark):
    ips = ["0.0.0.0", "0.1.2.3", "10.1.2.3", "100.64.1.1", "127.0.0.1", "169.254.1.1", "172.16.0.1", "172.32.0.1", "192.0.0.1", "192.0.2.1", "192.168.1.1", "198.18.0.1", "198.51.100.7", "203.0.113.9", "224.0.0.1", "240.0.0.1", "255.255.255.255", "8.8.8.8", "45.83.64.9", "192.0.0.9", "192.0.0.170"]
    bad = ["", None, "1.2.3", "1.2.3.256", "a.b.c.d", "01.2.3.4", "1.2.3.4 "]
    got = {r.src_ip: r for r in events(spark, [{"src_ip": x, "ts_us": 0} for x in ips + bad]).collect()}
    for x in ips:
        a = ipaddress.ip_address(x)
        usable = not (a.is_loopback or a.is_multicast or a.is_unspecified or a.is_link_local)
        assert (got[x].src_usable, got[x].src_private, got[x].src_public) == (usable, usable and a.is_private, usable and a.is_global), x
    for x in bad:
        assert (got[x].src_v4, got[x].src_usable, got[x].src_private, got[x].src_public) == (None, False, False, False), x


def test_classes_of_ipv6_are_those_of_the_standard_library(spark):
    pick = random.Random(6)
    blocks = ["::/127", "::/96", "100::/64", "2001::/23", "2001:1::/64", "2001:1::/125", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28", "2001:db8::/32", "2002::/16", "3fff::/20", "3fff:1000::/20", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8", "64:ff9b::/96", "64:ff9b:1::/48", "2000::/3", "2001:200::/23", "101::/32", "::/0"]
    ips = set()
    for b in blocks:
        net = ipaddress.ip_network(b)
        for n in {0, 1, 2, net.num_addresses - 1, *(pick.randrange(net.num_addresses) for _ in range(12))}:
            a = net[n % net.num_addresses]
            ips |= {str(a), a.exploded, str(a).upper(), ":".join(g.lstrip("0") or "0" for g in a.exploded.split(":"))}
    ips |= {"::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3::5:6:7:8"}
    bad = [":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4::5:6:7:8", "12345::", "g::", "::1:", "1:2:3:4:5:6:7:8::"]
    made = events(spark, [{"src_ip": x, "dst_ip": x, "ts_us": 0} for x in sorted(ips) + bad]).select("src_ip", "src_class", "ips_valid", "src_usable", "src_private", "src_public", "net24").collect()
    for r in made:
        try:
            a = ipaddress.ip_address(r.src_ip)
        except ValueError:
            assert (r.src_class, r.ips_valid, r.src_usable) == (None, False, False), r.src_ip
            continue
        assert r.src_ip not in bad and r.ips_valid and r.net24 == str(ipaddress.ip_network(f"{a}/64", strict=False)), r.src_ip
        if a.ipv4_mapped:
            continue
        usable = not (a.is_loopback or a.is_multicast or a.is_unspecified or a.is_link_local)
        assert (r.src_usable, r.src_private, r.src_public) == (usable, usable and a.is_private, usable and a.is_global), r.src_ip


def test_flags_zones_and_nulls(spark):
    got = events(spark, [
        {"ts_us": 0, "action": " Denied ", "inbound_zone": "Corp_WAN2", "outbound_zone": "x dmz"}, {"ts_us": 0, "action": None, "tcp_flags": None, "protocol": None, "dst_port": None, "dst_ip": None, "src_ip": None},
        {"ts_us": 0, "action": "deny", "tcp_flags": "SYN,ACK", "inbound_zone": "wander"}, {"ts_us": 0, "safe_message_excerpt": "Blocked by SPI", "dst_port": 2222, "translated_dst_ip": " ", "translated_dst_port": 22},
    ]).orderBy("event_id").collect()
    assert got[0].blocked and not got[0].blocked_legacy and got[0].wan_in and got[0].dmz_out and got[0].syn and got[0].probe
    assert not any(got[1][c] for c in ("blocked", "allowed", "syn", "spi", "wan_in", "external", "exposable")) and got[1].proto == "UNKNOWN"
    assert got[2].blocked_legacy and not got[2].syn and not got[2].wan_in
    assert got[3].spi and got[3].spi_block and got[3].service == "ssh" and got[3].eff_dst == "10.0.0.1" and got[3].eff_port == 22


def scan(n, step=1_000_000, **more):
    return [{"ts_us": i * step, "dst_ip": f"10.0.0.{i + 1}", **more} for i in range(n)]


@pytest.mark.parametrize("n,fires", [(9, 0), (10, 1), (11, 2)])
def test_threshold_of_the_horizontal_scan(spark, n, fires):
    assert rules.evaluate(events(spark, scan(n)), rules.BY_NAME["network_scan_horizontal"]).count() == fires


@pytest.mark.parametrize("seconds,fires", [(300, 1), (301, 0)])
def test_window_bound_is_inclusive(spark, seconds, fires):
    rows = scan(10, 0)
    rows[-1]["ts_us"] = seconds * 1_000_000
    assert rules.evaluate(events(spark, rows), rules.BY_NAME["network_scan_horizontal"]).where(f"last_us = {seconds}000000").count() == fires


def test_ties_and_input_order(spark):
    rows = scan(14, 0)
    want = sorted((r.event_id, r.n) for r in rules.evaluate(events(spark, rows), rules.BY_NAME["network_scan_horizontal"]).collect())
    assert want == [(f"E{i:05}", i + 1) for i in range(9, 14)]
    shuffled = events(spark, rows).repartition(3).orderBy(F.rand(1))
    assert sorted((r.event_id, r.n) for r in rules.evaluate(shuffled, rules.BY_NAME["network_scan_horizontal"]).collect()) == want


def test_sequences_need_earlier_related_blocks(spark):
    rule = rules.BY_NAME["blocked_then_allowed_same_service"]
    block = [{"ts_us": i, "dst_port": 22} for i in range(3)]
    assert rules.evaluate(events(spark, [*block, {"ts_us": 9, "dst_port": 22, "action": "pass"}]), rule).count() == 1
    assert rules.evaluate(events(spark, [*block[:2], {"ts_us": 9, "dst_port": 22, "action": "pass"}, block[2] | {"ts_us": 10}]), rule).count() == 0
    assert rules.evaluate(events(spark, [*block, {"ts_us": 9, "dst_port": 23, "action": "pass"}]), rule).count() == 0
    assert rules.evaluate(events(spark, block), rule).count() == 0


def test_fixed_source_port_groups(spark):
    rule, late = rules.BY_NAME["fixed_source_port_scan"], 1_768_478_400_000_000
    base = {"src_port": 443, "inbound_zone": "wan1"}
    group = lambda n, src, step=1_000_000, ports=(1000, 1001, 1002), **more: [{**base, "src_ip": src, "ts_us": late + i * step, "dst_port": ports[i % 3], **more} for i in range(n)]
    rows = [
        *group(9, "45.0.0.1"), *group(10, "45.0.0.2"), *group(5, "45.0.0.3", ports=(22, 1001, 1002)), *group(4, "45.0.0.4"), *group(5, "45.0.0.5", 75_000_000), *group(5, "45.0.0.6", 75_250_000), *group(5, "45.0.0.7", ports=(1, 1, 2)),
        *group(5, "45.0.0.8", action="pass"), *group(5, "45.0.0.9", ports=(22, 1001, 1002), action="pass"), *group(5, "45.0.0.10", action="other"), *group(5, None, src_port=53), *group(5, "45.0.0.11", src_port=1),
    ]
    shuffled = events(spark, rows).repartition(3)
    got = {r.entity: r for r in rules.evaluate(shuffled, rule).collect()}
    assert {k: (r.n, r.t, r.p, r.severity) for k, r in got.items()} == {
        "45.0.0.1": (9, 1, 3, "low"), "45.0.0.2": (10, 1, 3, "medium"), "45.0.0.3": (5, 1, 3, "low"), "45.0.0.5": (5, 1, 3, "low"), "45.0.0.8": (5, 1, 3, "medium"), "45.0.0.9": (5, 1, 3, "high"),
        "45.0.0.10": (5, 1, 3, "low"), None: (5, 1, 3, "low"),
    }
    one = got["45.0.0.2"]
    assert one.first_id == "E00009" and one.event_id == "E00018" and one.ids_sum == sum(range(9, 19)) and one.last_us - one.first_us == 9_000_000
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("f", shuffled.toPandas())
    want = con.execute(f"SELECT {', '.join(rules.OUT)} FROM ({rules.rule_sql(rule, 'f')})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in rules.OUT)) for r in got.values())


def random_events(spark, n, seed, seconds=900):
    """Events with ties, nulls, odd addresses and several services, around a real time."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        rows.append(dict(
            ts_us=1_768_478_400_000_000 + rng.randrange(seconds) * 1_000_000, src_ip=rng.choice(["45.83.64.9", "45.83.64.9", "45.83.64.9", "10.0.0.5", None, "", "bad"]), dst_ip=rng.choice([f"10.0.0.{i}" for i in range(12)] + [None]),
            dst_port=rng.choice([22, 22, 22, 3389, 445, 6379, 0, None, 8080]), src_port=rng.choice([443, 50000]), action=rng.choice(["block", "block", "deny", "pass", "Drop ", None]), tcp_flags=rng.choice(["SYN", "SYN", "SYN", "NONE", "FIN", "SYN,ACK", None]),
            inbound_zone=rng.choice(["wan", None, "lan"]), outbound_zone=rng.choice(["lan", "dmz", "", " ", None]), protocol=rng.choice(["TCP", "TCP", "tcp", "UDP", None]), action_reason=rng.choice([None, None, "spi"]), translated_dst_ip=rng.choice([None, None, "10.9.9.9"]),
        ))
    base = dict(src_ip="45.83.64.77", dst_ip="10.0.0.1", dst_port=22, inbound_zone="wan")
    rows += [{**base, "ts_us": 1_768_478_400_000_000 + i * 1_000_000, "action": "pass" if i in (4, 5, 9) else "block"} for i in range(10)]
    return events(spark, rows)


def test_all_rules_together_are_those_of_the_self_joins(spark):
    duckdb = pytest.importorskip("duckdb")
    df = random_events(spark, 700, 1).repartition(3)
    got = [tuple(r) for r in rules.evaluate_all(df, rules.RULES).select(*rules.OUT).collect()]
    con = duckdb.connect()
    con.register("f", df.toPandas().convert_dtypes())
    want = con.execute(" UNION ALL ".join(f"SELECT {', '.join(rules.OUT)} FROM ({rules.rule_sql(r, 'f')})" for r in rules.RULES)).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len({r[0] for r in got}) > 10
    assert rules.evaluate_all(df.limit(0), rules.RULES).count() == 0


CHOSEN = [rules.BY_NAME[n] for n in ("network_scan_horizontal", "ssh_probe", "blocked_then_allowed_same_service", "critical_management_service_exposed", "inbound_sensitive_service_allowed")]


def listed_signals(df):
    """Raw signals with their events' ids, by looking at all earlier events of the key: (rule, entity, corr, first_us, last_us, event_id, ids)."""
    out = []
    for rule in CHOSEN:
        rows = sorted((r for r in rules.members(df, rule).collect()), key=lambda r: (r.ts_us, r.event_id))
        fired = {(r.key, r.event_id) for r in rules.evaluate(df, rule).collect()}
        for r in rows:
            if (r.key, r.event_id) in fired:
                ids = [x for x in rows if x.key == r.key and 0 <= r.ts_us - x.ts_us <= r["size"] and (x.ts_us, x.event_id) <= (r.ts_us, r.event_id) and x.inside]
                out.append((rule.name, r.entity or "", r.key, ids[0].ts_us, r.ts_us, r.event_id, {x.event_id for x in ids} | {r.event_id}))
    return out


def plain_merge(raw):
    """Each signal of a rule and key meets the last merged one of these."""
    done = []
    for r in sorted(raw, key=lambda r: (*r[:5], r[5])):
        if done and done[-1][6:] == [r[2]] and done[-1][:2] == [r[0], r[1]] and r[6] & done[-1][4] and r[3] - done[-1][3] <= 300_000_000:
            done[-1][3], done[-1][4], done[-1][5] = max(done[-1][3], r[4]), done[-1][4] | r[6], done[-1][5] + 1
        else:
            done.append([r[0], r[1], r[3], r[4], set(r[6]), 1, r[2]])
    return [x[:6] for x in done]


def plain_clusters(merged, ids, scope):
    """(signal, anchor) by comparing each signal with all anchors."""
    names = [n for tier in signals.PRECEDENCE for n in tier]
    key = lambda m: (names.index(m.rule) if m.rule in names else len(names), -signals.SEVERITY.index(m.severity), -m.confidence, m.first_us, m.rule, m.signal_id)
    families = {r.name: r.family for r in rules.RULES}
    anchors, out = [], {}
    for m in sorted(merged, key=key):
        best = None
        for a in anchors:
            common = len(ids[a.signal_id] & ids[m.signal_id])
            share = common / min(len(ids[a.signal_id]), len(ids[m.signal_id]))
            gap = max(m.first_us - a.last_us, a.first_us - m.last_us)
            exposures = {families[a.rule], families[m.rule]} <= {"firewall_exposure", "firewall_policy"} and ids[a.signal_id] == ids[m.signal_id] and scope[a.signal_id] & scope[m.signal_id]
            if (a.entity == m.entity and share >= 0.7 or a.entity != m.entity and exposures) and gap <= 300_000_000 and (best is None or (-share, key(a)) < best[0]):
                best = ((-share, key(a)), a.signal_id)
        if best is None:
            anchors.append(m)
        out[m.signal_id] = best[1] if best else m.signal_id
    return out


CHOSEN += [rules.BY_NAME[n] for n in ("dnat_sensitive_service_exposure", "wan_to_lan_sensitive_service_allowed")]


@pytest.mark.parametrize("seed,stretch", [(2, 3_600_000_000), (3, 60_000_000)])
def test_merging_bridge_clusters_and_incidents(spark, monkeypatch, seed, stretch):
    monkeypatch.setattr(signals, "HOUR", stretch)  # runs cross the bounds of short stretches
    df = scratch.stored(random_events(spark, 260, seed, 1500), "events")
    raw = listed_signals(df)
    found = scratch.stored(signals.all_signals(df, CHOSEN), "raw")
    assert found.where("reason IS NOT NULL").isEmpty()
    merged = scratch.stored(signals.merge(signals.numbered(signals.active(found))), "merged")
    bridge = scratch.stored(signals.signal_events(df, found, merged, CHOSEN), "bridge")
    ids, scope = {}, {m.signal_id: {m.entity} - {""} for m in merged.collect()}
    for r in bridge.collect():
        ids.setdefault(r.signal_id, set()).add(r.event_id)
        scope[r.signal_id] |= {r.tgt} - {None, ""}
    rows = merged.collect()
    assert sorted([m.rule, m.entity, m.first_us, m.last_us, sorted(ids[m.signal_id]), m.n_merged] for m in rows) == sorted([*m[:4], sorted(m[4]), m[5]] for m in plain_merge(raw))
    found = scratch.stored(signals.cluster(merged, bridge), "clusters")
    assert {r.signal_id: r.anchor_id for r in found.collect()} == plain_clusters(rows, ids, scope)
    incidents = signals.incidents(merged, found, bridge, df).collect()
    assert len(incidents) == len({r.anchor_id for r in found.collect()})
    sequences = [r for r in incidents if r.rule == "blocked_then_allowed_same_service"]
    assert sequences and all(r.n_allowed > 0 and r.severity in ("medium", "high", "critical") for r in sequences)
    entities = {m.signal_id: m.entity for m in rows}
    assert any(entities[s] != entities[a] for s, a in ((r.signal_id, r.anchor_id) for r in found.collect()))
    details = signals.signal_details(merged, bridge).collect()
    assert all(d.n_events == len(ids[d.signal_id]) and d.n_targets == len({r.tgt for r in bridge.collect() if r.signal_id == d.signal_id} - {None, ""}) and set(d.evidence) <= ids[d.signal_id] and len(d.evidence) == min(3, d.n_events) for d in details[:12])


def test_rows_grow_with_the_events_where_two_keys_alternate(spark):
    chosen = [rules.BY_NAME[n] for n in ("inbound_sensitive_service_allowed", "critical_management_service_exposed")]
    df = scratch.stored(events(spark, [{"ts_us": i * 1_000_000, "dst_ip": f"10.0.0.{i % 2}", "dst_port": 22, "action": "pass", "inbound_zone": "wan"} for i in range(1200)]), "events")
    found = signals.correlated(df, chosen)
    sizes = {k: x.count() for k, x in found.items()}
    assert sizes["raw"] == 1200 and sizes["merged"] == 2 and sizes["bridge"] == 1200 and sizes["incidents"] == 2, sizes
    assert signals.shared_events(found["bridge"], ["entity"]).isEmpty()


def test_suppression_by_counted_marks(spark):
    late = [{"ts_us": i * 1_000_000, "src_ip": "45.9.9.9", "src_port": 443, "dst_port": 40_000 + i, "tcp_flags": "RST", "action_reason": "blocked by spi"} for i in range(7)]
    repeated = [{**x, "src_ip": "45.9.9.8", "dst_port": 40_000} for x in late]
    probe = lambda src, to: [{"ts_us": i * 1_000_000, "src_ip": src, "dst_port": 22, "dst_ip": to if i == 5 else f"10.0.0.{i}"} for i in range(9)]
    df = events(spark, [*late, *repeated, *probe("45.1.1.1", "10.0.0.5"), *probe("45.2.0.1", "10.8.0.1"), *probe("45.3.0.1", "10.9.0.2"), *probe("45.4.0.1", "10.8.0.1")])
    policy = suppression.Policy((), ("45.1.0.0/16", "0.0.0.0/0"), ("10.9.0.0/24",), (("45.2.0.0/16", "10.8.0.0/16"),))
    got = sorted((r.rule, r.entity, r.n, r.reason) for r in signals.all_signals(df, [rules.BY_NAME[n] for n in ("spi_anomaly_burst", "ssh_probe")], policy).collect())
    by = {}
    for rule, entity, n, reason in got:
        by.setdefault((rule, entity), {})[n] = reason
    assert set(by["spi_anomaly_burst", "45.9.9.9"].values()) == {suppression.LATE} and set(by["spi_anomaly_burst", "45.9.9.8"].values()) == {None}
    assert by["ssh_probe", "45.1.1.1"] == {n: "source" for n in range(5, 10)} and by["ssh_probe", "45.2.0.1"] == {5: None, **{n: "pair" for n in range(6, 10)}}
    assert by["ssh_probe", "45.3.0.1"] == {5: None, **{n: "destination" for n in range(6, 10)}} and set(by["ssh_probe", "45.4.0.1"].values()) == {None}
    assert suppression.refused(policy.sources) == ["0.0.0.0/0"]


def plain_absorb(found):
    """found: (id, type, entity, first, last, events); the larger first, each against all kept ones, whose events grow."""
    kept, out = [], {}
    for x in sorted(found, key=lambda x: (-len(x[5]), x[3], x[0])):
        fits = [k for k in kept if k[1:3] == list(x[1:3]) and k[3] <= x[4] and x[3] <= k[4] and (k[5] <= x[5] or x[5] <= k[5] or len(k[5] & x[5]) / len(k[5] | x[5]) >= 0.5)]
        if fits:
            k = min(fits, key=lambda k: (-len(k[5]), k[3], k[0]))
            k[3], k[4], k[5] = min(k[3], x[3]), max(k[4], x[4]), k[5] | x[5]
            out[x[0]] = k[0]
        else:
            kept.append(list(x))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_overlapping_incidents_are_absorbed_as_by_a_plain_fold(spark, seed):
    rng, found = random.Random(seed), []
    for i in range(60):
        first, size = rng.randrange(40), rng.randrange(1, 9)
        found.append((f"I{i:02}", rng.choice("ab"), rng.choice("xy"), first, first + rng.randrange(12), frozenset(rng.sample(range(14), size))))
    held = spark.createDataFrame([(x[0], f"E{e}") for x in found for e in x[5]], "incident_id string, event_id string")
    rows = spark.createDataFrame([(*x[:5], len(x[5])) for x in found], "incident_id string, type string, entity string, first_us long, last_us long, n long")
    assert {r.incident_id: r.keeper_id for r in signals.overlapping(rows, held).collect()} == plain_absorb(found)
    assert signals.overlapping(rows.limit(0), held.limit(0)).count() == 0


@pytest.mark.parametrize("rows,severity", [
    ([{"dst_port": 3389, "dst_ip": f"10.0.0.{i}"} for i in range(19)], "low"), ([{"dst_port": 3389, "dst_ip": f"10.0.0.{i}"} for i in range(38)], "medium"),
    ([{"dst_port": 3389, "action": "pass", "inbound_zone": "wan"}], "high"), ([{"dst_port": 6379, "action": "pass", "inbound_zone": "wan"}], "critical"), ([{"dst_port": 623, "action": "pass", "inbound_zone": "wan"}], "critical"),
    ([{"dst_port": 443, "dst_ip": "10.0.0.1"}] * 120, "high"),
])
def test_severity_of_incidents(spark, rows, severity):
    """Blocked probes are low, or medium over many targets; allowed connections by service; floods keep the signal's severity."""
    df = events(spark, [{**r, "ts_us": i * 100_000} for i, r in enumerate(rows)])
    df = scratch.stored(df, "events")
    chosen = [rules.BY_NAME[n] for n in ("network_scan_horizontal", "rdp_probe", "network_flood_dos", "critical_management_service_exposed", "inbound_sensitive_service_allowed")]
    assert max((r.severity for r in signals.correlated(df, chosen)["incidents"].collect()), key=signals.SEVERITY.index) == severity


def test_keyset_pages_have_no_gap_and_no_repeat(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else float(i % 5)) for i in range(60)], "id long, v double")
    seen, after = [], None
    while True:
        page = store.keyset_page(df, "v", "id", 8, after).collect()
        seen += [r.id for r in page[:8]]
        if len(page) <= 8:
            break
        after = (page[7].v, page[7].id)
    assert seen == [r.id for r in df.orderBy(F.col("v").desc_nulls_last(), "id").collect()]


def test_versions_outbox_and_archive(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    first = store.project_versions(spark.createDataFrame([], "k long, hash string, version int"), docs, "k").drop("changed")
    second = store.project_versions(first, spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "k long, v string"), "k")
    assert {(r.k, r.version, r.changed) for r in second.collect()} == {(1, 1, False), (2, 2, True), (3, 1, True)}
    box = store.enqueue(spark.createDataFrame([("x", 1)], "dedup_key string, n int"), spark.createDataFrame([("x", 2), ("y", 3), ("y", 3)], "dedup_key string, n int"))
    assert sorted((r.dedup_key, r.n) for r in box.collect()) == [("x", 1), ("y", 3)]
    assert store.archive(docs, f"{tmp_path}/a", "k").first()[:3] == (2, 1, 2)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_queries_agree_with_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("events", "documents", "pages", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name in ("rule_network_scan_horizontal", "rule_fixed_source_port_scan", "rule_blocked_then_allowed_same_service", "rule_critical_management_service_exposed", "recon_rollup", "search_incidents", "failed_then_success", "content_pages"):
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        columns = ", ".join(rows.columns)
        want = con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
        got = [tuple(r) for r in rows.collect()]
        assert got and sorted(map(repr, got)) == sorted(map(repr, want)), name
