"""Parsers on a mixed file."""

import json
from datetime import UTC, datetime
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from netquarry.sources import records


def test_mixed_file(spark, tmp_path):
    lines = [
        json.dumps({"start": "2026-01-15T12:00:00+02:00", "src": "192.0.2.1", "dst": "10.0.0.1", "sourcePort": 5, "destinationPort": 22, "proto": "TCP", "deviceAction": "Blocked by SPI", "tcpFlags": "SA", "deviceInboundZone": "wan1"}),
        json.dumps({"timestamp": 1768478400, "client_ip": "1.2.3.4", "server_ip": "5.6.7.8", "dport": 443, "action": "allow"}),
        json.dumps({"time": "2026-01-15T12:00:00Z", "source": {"address": "1.1.1.1"}, "destination": {"address": "2.2.2.2", "port": 80}, "status": "deny"}),
        r"CEF:0|v|p|1|100|name|5|src=9.9.9.9 dst=8.8.8.8 spt=1 dpt=2 proto=UDP act=drop msg=a\=b",
        "<34>1 2026-01-15T12:00:00Z host app 1 ID - message", "garbage", "", json.dumps({"timestamp": "x", "src": "999.1.1.1", "action": "a"}), "{broken",
    ]
    (tmp_path / "mixed.log").write_text("\n".join(lines))
    events, failures = records.parse(records.read_lines(spark, str(tmp_path)))
    got = {(r.parser, r.src_ip, r.dst_ip, r.dst_port, r.protocol, r.action, r.tcp_flags) for r in events.collect()}
    assert got == {
        ("firewall", "192.0.2.1", "10.0.0.1", 22, "tcp", "block", "SYN,ACK"), ("generic", "1.2.3.4", "5.6.7.8", 443, None, "allow", None), ("generic", "1.1.1.1", "2.2.2.2", 80, None, "deny", None),
        ("cef", "9.9.9.9", "8.8.8.8", 2, "udp", "drop", None), ("syslog", None, None, None, None, None, None),
    }
    assert sorted(r.reason for r in failures.collect()) == ["semantically_invalid", "unsupported", "unsupported"]


def test_syslog_times_and_firewall_markers(spark):
    year = datetime.now(UTC).year
    lines = {
        "<34>Jan 15 12:00:00 host app: msg": ("syslog", datetime(year, 1, 15, 12)), "<34>Oct  5 22:14:15 host su[12]: a: b ": ("syslog", datetime(year, 10, 5, 22, 14, 15)),
        "<13>host app: no date": ("syslog", None), "<13>Xyz 15 12:00:00 host app: no month": ("syslog", None), "<13>Jan 32 12:00:00 host app: no day": ("syslog", None),
        "<165>1 2026-07-10T09:51:40+03:00 host app 1234 ID47 - message": ("syslog", datetime(2026, 7, 10, 6, 51, 40)), "<34>2 - host app  1 ID [a b] message": ("syslog", None),
        '{"start": "2026-01-15T12:00:00Z", "src": "192.0.2.1", "rule": 7}': ("firewall", datetime(2026, 1, 15, 12)), '{"start": "2026-01-15T12:00:00Z", "src": "192.0.2.1", "proto": "TCP", "diag": null}': ("firewall", datetime(2026, 1, 15, 12)),
        '{"time": "2026-01-15T12:00:00Z", "src": "192.0.2.1"}': ("generic", datetime(2026, 1, 15, 12)),
    }
    bad = ['{"pf": 1, "x": 2}', "<34>no tag here", "<12345>host app: msg", "34>host app: msg"]
    raw = spark.createDataFrame([("f", x) for x in [*lines, *bad]], "source string, raw string")
    found, failures = records.parse(raw)
    got = {r.event_id: (r.parser, r.at) for r in found.select("event_id", "parser", records.F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")).collect()}
    ids = {x: f"EVT-{sha256(b'f').hexdigest()[:8]}-{sha256(x.encode()).hexdigest()[:16]}" for x in lines}
    assert got == {ids[x]: (kind, at and f"{at:%Y-%m-%d %H:%M:%S}") for x, (kind, at) in lines.items()}
    assert sorted(r.preview for r in failures.where("reason = 'unsupported'").collect()) == sorted(bad)


def test_flags(spark):
    rows = [("S",), ("syn ack",), ("",), (None,), ("-",), ("XYZ",), ("FPU",), ("WE",)]
    got = [r[0] for r in spark.createDataFrame(rows, "f string").select(records.tcp_flags(records.F.col("f"))).collect()]
    assert got == ["SYN", "SYN,ACK", "NONE", None, "NONE", None, "FIN,PSH,URG", "ECE,CWR"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_texts_without_offset_are_utc_in_every_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("2026-01-15T12:00:00",), ("2026-01-15 12:00:00.5",), ("2026-01-15T12:00:00+02:00",), ("2026-01-15T12:00:00Z",), ("2026-01-15",), ("1768478400",), ("nonsense",), (None,)]
        got = [r[0] for r in spark.createDataFrame(rows, "x string").select(F.unix_micros(records.timestamp(F.col("x")))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    noon = 1_768_478_400_000_000
    assert got == [noon, noon + 500_000, noon - 7_200_000_000, noon, noon - 43_200_000_000, noon, None, None]


def test_inspection_blocks_keep_their_reason(spark):
    lines = [f'{{"start": "2026-01-15T12:00:0{i}Z", "src": "45.83.64.9", "dst": "10.0.0.{i}", "proto": "TCP", "deviceAction": "{a}", "tcpFlags": "S"}}' for i, a in enumerate(["blocked by spi"] * 5 + ["block", "pass"])]
    found, failed = records.parse(spark.createDataFrame([("f", x) for x in lines], "source string, raw string"))
    got = found.orderBy("ts").collect()
    assert failed.count() == 0 and [r.action for r in got] == ["block"] * 6 + ["pass"] and [r.action_reason for r in got] == ["blocked by spi"] * 5 + [None] * 2
