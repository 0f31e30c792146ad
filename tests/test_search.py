"""Search pages, cursors and suppression."""

import ipaddress
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netquarry.operators import search, suppression
from netquarry.plans import queries


def test_settings_and_cursors_are_checked():
    for bad in ({"size": 0}, {"size": 201}, {"among": {"a": tuple(range(21))}}, {"between": {"a": (2, 1)}}, {"between": {"a": (datetime(2026, 1, 1), None)}}):
        with pytest.raises(ValueError):
            search.Criteria(**bad)
    own = search.Criteria(sort="confidence")
    text = search.cursor(b"secret", "incidents", own, 0.5, "I7")
    assert search.place(b"secret", "incidents", own, text) == (0.5, "I7")
    for secret, resource, criteria, given in ((b"other", "incidents", own, text), (b"secret", "events", own, text), (b"secret", "incidents", search.Criteria(sort="severity"), text), (b"secret", "incidents", own, "x" + text[1:]), (b"secret", "incidents", own, "?")):
        with pytest.raises(ValueError):
            search.place(secret, resource, criteria, given)


def test_pages_follow_each_other(spark):
    rows = [(f"I{i:02}", ("low", "high", "medium", "critical", "strange")[i % 5], None if i == 7 else i % 3, ["T1", "T2"][: i % 3]) for i in range(23)]
    df = spark.createDataFrame(rows, "id string, severity string, n long, marks array<string>")
    events = spark.createDataFrame([("I01",), ("I01",), ("I03",)], "incident string")
    ids, after = [], None
    while True:
        page = search.search(df, search.Criteria(sort="severity", size=4, after=after), "id", {"events": (events, "incident")})
        page = page.withColumn("rank", search.severity_rank(F.col("severity"))).orderBy(F.desc("rank"), "id").collect()
        ids += [r.id for r in page[:4]]
        assert all(r.events == {"I01": 2, "I03": 1}.get(r.id, 0) for r in page)
        if len(page) < 5:
            break
        after = (page[3].rank, page[3].id)
    order = ("critical", "high", "medium", "low", "strange")
    assert ids == [r[0] for r in sorted(rows, key=lambda r: (order.index(r[1]), r[0]))]
    have = lambda **x: {r.id for r in search.matching(df, search.Criteria(**x), "id").collect()}
    assert have(contains={"marks": "T2"}) == {r[0] for r in rows if "T2" in r[3]} and have(prefix={"id": "I1"}) == {r[0] for r in rows if r[0].startswith("I1")} and not have(prefix={"id": "I%"})
    assert have(between={"n": (1, 1)}) == {r[0] for r in rows if r[2] == 1} and have(among={"severity": ()}) == {r[0] for r in rows}
    assert have(linked=((events, "incident", False),)) == {r[0] for r in rows} - {"I01", "I03"} and have(either=(("n = 1", "severity = 'low'"), False)) == {r[0] for r in rows if r[2] != 1 and r[1] != "low"}
    assert search.search(df.limit(0), search.Criteria(sort="n"), "id").isEmpty()


def test_blocks_are_those_of_the_standard_library(spark):
    ips = ["10.0.0.0", "10.255.255.255", "11.0.0.0", "45.83.64.9", "0.0.0.0", "255.255.255.255", "1.2.3", "", None, "::1", "01.2.3.4"]
    blocks = ["10.0.0.0/8", "45.83.64.9/30", "45.83.64.9", "0.0.0.0/0", "::/0", "bad", "1.2.3.4/33"]
    df = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", *[suppression.within(suppression.number(F.col("ip")), b).alias(f"b{i}") for i, b in enumerate(blocks)])
    for r in df.collect():
        for i, b in enumerate(blocks):
            try:
                want = b not in ("0.0.0.0/0", "::/0") and ipaddress.IPv4Address(r.ip or "") in ipaddress.IPv4Network(b, strict=False)
            except ValueError:
                want = False
            assert r[f"b{i}"] == want, (r.ip, b)


def test_reasons_for_suppression(spark):
    schema = "signal_id string, event_id string, tgt string, src_port int, dst_port int, dst_ip string, tcp_flags string, action string, action_reason string, blocked boolean"
    late = lambda s, i, **x: tuple({**dict(signal_id=s, event_id=f"E{i}", tgt="10.0.0.1", src_port=443, dst_port=40000 + i, dst_ip="10.0.0.1", tcp_flags="RST", action="block", action_reason="Blocked by SPI", blocked=True), **x}.values())
    rows = [late("late", 1), late("late", 2), late("late", 2), late("one", 1), late("ports", 1), late("ports", 2, dst_port=40001), late("low", 1), late("low", 2, dst_port=80), late("flags", 1), late("flags", 2, tcp_flags="RST,ACK,FIN"), late("null", 1), late("null", 2, src_port=None)]
    rows += [late("scan", 1), late("scan", 2), late("to", 1, tgt="10.9.0.2"), late("to", 2, tgt="10.9.0.1"), late("pair", 1, tgt="10.8.0.1")]
    rules = {"scan": "ssh_probe", "to": "ssh_probe", "pair": "ssh_probe", "rule": "telnet_probe", "source": "ssh_probe", "none": "ssh_probe"}
    entity = {"source": "45.1.1.1", "pair": "45.2.0.1", "none": None}
    signals = spark.createDataFrame([(s, rules.get(s, "spi_anomaly_burst"), entity.get(s, "9.9.9.9")) for s in ("late", "one", "ports", "low", "flags", "null", "scan", "to", "pair", "rule", "source", "none")], "signal_id string, rule string, entity string")
    policy = suppression.Policy(("telnet_probe",), ("45.1.0.0/16", "0.0.0.0/0"), ("10.9.0.0/24",), (("45.2.0.0/16", "10.8.0.0/16"),))
    got = {r.signal_id: r.reason for r in suppression.reasons(signals, spark.createDataFrame(rows, schema), policy).collect()}
    assert got == {"late": suppression.LATE, "to": "destination 10.9.0.1 is allowed", "pair": "pair 45.2.0.1 -> 10.8.0.1 is allowed", "rule": "rule telnet_probe is allowed", "source": "source 45.1.1.1 is allowed"}
    assert suppression.reasons(signals.limit(0), spark.createDataFrame([], schema), policy).isEmpty()


def test_search_queries_agree_with_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("events", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    for name in ("search_incidents_page", "search_events_page", "search_signals_page", "search_jobs_page", "suppressed_signals"):
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
        want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        got = [tuple(r) for r in rows.collect()]
        assert got and sorted(map(repr, got)) == sorted(map(repr, want)), name
        if name == "suppressed_signals":
            assert {r[1].split()[0] for r in got} == {"late_rst_from_established_service", "rule", "source", "pair", "destination"}
