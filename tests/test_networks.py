"""Networks of addresses against the standard library; queries over both families against their SQL."""

import ipaddress
import os
import random

import pytest

from netquarry.operators import rollups
from netquarry.plans import queries

from .test_engine import events


def spelled(rng, a):
    """The address in one of its spellings."""
    if a.version == 4:
        return str(a)
    return rng.choice([str(a), a.exploded, a.exploded.upper(), str(a).upper(), ":".join(x.lstrip("0") or "0" for x in a.exploded.split(":"))])


def test_networks_are_those_of_the_standard_library(spark):
    rng = random.Random(9)
    made = [ipaddress.ip_address(rng.choice([0x20010DB8 << 96, 0xFD << 120, 0, rng.getrandbits(128)]) | rng.getrandbits(rng.choice([8, 40, 64, 70, 90]))) for _ in range(150)]
    made = [a for a in made if not a.is_unspecified and "." not in str(a) and a.version == 6] + [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(20)]
    rows = [(spelled(rng, a), str(ipaddress.ip_network(f"{a}/{24 if a.version == 4 else 64}", strict=False))) for a in made]
    bad = ["", None, "fe80::1%eth0", "::ffff:1.2.3.4", "1::2::3", "a:b", "10.0.0", "10.0.0.256"]
    got = {r.dst_ip: r.net24 for r in events(spark, [{"dst_ip": x, "ts_us": 0} for x, _ in rows] + [{"dst_ip": x, "ts_us": 0} for x in bad]).collect()}
    assert {x: got[x] for x, _ in rows} == dict(rows) and not any(got[x] for x in bad)


def test_groups_of_an_ipv6_network_show_its_first_sources(spark):
    rows = [{"ts_us": i * 1_000_000, "src_ip": f"2001:db8:{i % 2}::{i:x}", "dst_ip": f"10.0.0.{i % 9}", "dst_port": 22} for i in range(400)] + [{"ts_us": 0, "src_ip": x, "dst_port": 22} for x in ("name", None, "1::2::3")]
    facts = events(spark, rows).selectExpr("*", "'I' AS incident_id", "'network_scanning' AS family")
    got = {r.cidr: r for r in rollups.recon_groups(facts).collect()}
    assert sorted(got) == ["2001:db8:1::/64", "2001:db8::/64"]
    for k, net in ((0, "2001:db8::/64"), (1, "2001:db8:1::/64")):
        mine = sorted(r["src_ip"] for r in rows[:400] if int(r["src_ip"].split(":")[2]) == k)
        assert (got[net].n_sources, got[net].n_events, got[net].n_targets, got[net].scope, got[net].sources) == (200, 200, 9, "services:ssh", ",".join(mine[:5]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["subnet_sweeps_of_both_families", "recon_groups_of_both_families"])
def test_queries_of_networks_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in rows.collect()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))
