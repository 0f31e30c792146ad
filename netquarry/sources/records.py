"""Raw records to canonical events: lines of JSON (firewall or generic), CEF and syslog, told apart and parsed by built-in expressions.

Defined cases: blank lines are skipped; a line that no parser takes, or whose addresses or ports are not valid, is a failure with its
reason, never lost; null and missing fields stay null. Syslog lines of RFC 3164 name no year and no zone: the current year and UTC are
taken (null where that year lacks the day), and without a date their time is null. Lines longer than MAX_BYTES are failures. Line numbers count within a file only if
it is one partition, so records are named by the hash of source and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 1 << 20
#: Field names that mean the same; of several present the last one counts.
ALIASES = {
    "src_ip": ("src_ip", "source_ip", "source.address", "client_ip", "src"),
    "dst_ip": ("dst_ip", "destination_ip", "destination.address", "server_ip", "dst"),
    "src_port": ("src_port", "source_port", "source.port", "sport"),
    "dst_port": ("dst_port", "destination_port", "destination.port", "dport"),
    "time": ("timestamp", "time", "event_time", "event.created", "start", "@timestamp"),
    "action": ("action", "event_action", "disposition", "status", "deviceAction"),
}
#: Letters and names of flags, and protocols.
FLAGS = {"F": "FIN", "S": "SYN", "R": "RST", "P": "PSH", "A": "ACK", "U": "URG", "E": "ECE", "W": "CWR"}
PROTOCOLS = ("tcp", "udp", "icmp", "icmpv6", "gre", "esp", "ah")
#: More fields of firewall records.
FIREWALL_TEXTS = {
    "inbound_interface": "deviceInboundInterface", "outbound_interface": "deviceOutboundInterface", "inbound_rule_set": "deviceInboundRuleSet", "outbound_rule_set": "deviceOutboundRuleSet",
    "source_username": "sourceUserName", "translated_src_ip": "sourceTranslatedAddress", "translated_dst_ip": "destinationTranslatedAddress", "event_type": "type",
}
FIREWALL_NUMBERS = {"translated_src_port": "sourceTranslatedPort", "translated_dst_port": "destinationTranslatedPort", "bytes": "bytes", "packets": "packets", "duration_ms": "durationMs"}
_CEF = r"^CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
_SYSLOG_5424 = r"^<(\d{1,4})>[1-9]\d{0,2}\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$"
_SYSLOG_3164 = r"^<(\d{1,4})>(?:([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\s+)?(\S+)\s([^:]+):\s"
_V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, raw): the lines of text files, without blank ones."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("raw")).where(F.trim("raw") != "")


def tcp_flags(text: Column) -> Column:
    """Canonical flags in fixed order; "NONE" for an explicit none, null for null or unknown tokens."""
    up = F.upper(F.trim(text))
    words = F.array_remove(F.split(up, r"[\s,|]+"), "")
    names = F.array(*[F.lit(x) for x in FLAGS.values()])
    ordered = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
    pick = lambda has: F.array_join(F.array_compact(F.array(*[F.when(has(n), F.lit(n)) for n in ordered])), ",")
    letter = {name: c for c, name in FLAGS.items()}
    return (
        F.when(text.isNull() | (F.length(text) > 128), None)
        .when(up.isin("", "0", "NONE", "NULL", "-"), "NONE")
        .when(F.size(F.array_except(words, names)) == 0, pick(lambda n: F.array_contains(words, n)))
        .when(up.rlike("^[FSRPAUEW]+$"), pick(lambda n: up.contains(letter[n])))
    )


def timestamp(text: Column) -> Column:
    """ISO text (without offset: UTC) or an epoch in seconds, milli- or microseconds by its size."""
    number = text.try_cast("double")
    epoch = F.when(number < 2e10, number * 1e6).when(number < 2e13, number * 1e3).otherwise(number).cast("long")
    full = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), F.concat(F.trim(text), F.lit("T00:00:00"))).otherwise(F.trim(text))
    # the session's zone must not count
    zoned = F.when(full.rlike(r"(?:[Zz]|UTC|GMT|[+-]\d{1,2}(?::?\d{2})?)$") & full.contains(":"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(number.isNotNull(), F.timestamp_micros(epoch)).otherwise(zoned.try_cast("timestamp"))


def syslog_time(line: Column) -> Column:
    """The time of a line of RFC 5424, or else of RFC 3164."""
    part = lambda i: F.regexp_extract(line, _SYSLOG_3164, i).try_cast("int")
    month = F.floor((F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.regexp_extract(line, _SYSLOG_3164, 2)) + 2) / 3).cast("int")
    year = F.year(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
    old = F.when(part(3).isNotNull(), F.try_make_timestamp(year, month, part(3), part(4), part(5), part(6), F.lit("UTC")))
    return F.when(line.rlike(_SYSLOG_5424), timestamp(F.regexp_extract(line, _SYSLOG_5424, 2))).otherwise(old)


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a generator, so that the optimizer doesn't copy their expressions into all that names them."""
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_made")
    return rows.select("*", made).select(*rows.columns, "_made.*")


def parse(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, failures) of a frame (source, raw)."""
    field = lambda name: F.get_json_object("raw", "$." + name if "@" not in name else f"$['{name}']")
    alias = lambda kind: F.coalesce(*[field(n) for n in reversed(ALIASES[kind])])
    body = F.regexp_extract("raw", _CEF, 8)
    ext = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(body, rf"(?:^|.*\s){k}=(.*?)(?=\s+\w+=|$)", 1), r"\\([=|\\])", "$1"), F.lit(""))
    is_json = F.col("raw").rlike(r"^\s*\{") & F.expr("try_parse_json(raw) IS NOT NULL")
    marks = field("deviceAction").isNotNull().cast("int") + (field("src").isNotNull() | field("dst").isNotNull()).cast("int") + field("proto").isNotNull().cast("int")
    # the fourth marker counts by the field's presence; with it, one more will do
    pf = is_json & F.coalesce(F.arrays_overlap(F.json_object_keys("raw"), F.array(*[F.lit(x) for x in ("pf", "diag", "rule")])), F.lit(False))
    line = F.trim(F.col("raw"), F.lit(" \t\r\n"))
    known = sum((alias(k).isNotNull().cast("int") for k in ("time", "src_ip", "dst_ip", "action")), F.lit(0))
    kind = F.when(F.octet_length("raw") > MAX_BYTES, None).when(is_json & ((marks >= 3) | (pf & (marks >= 1))), "firewall").when(F.col("raw").rlike(_CEF), "cef").when(line.rlike(_SYSLOG_5424) | line.rlike(_SYSLOG_3164), "syslog").when(is_json & (known >= 2), "generic")
    by = lambda firewall, cef, generic, syslog=None: F.when(F.col("parser") == "firewall", firewall).when(F.col("parser") == "cef", cef).when(F.col("parser") == "generic", generic).when(F.col("parser") == "syslog", syslog)
    act = F.lower(field("deviceAction"))
    firewall_action = F.when(act.isin("allow", "pass", "accepted", "accept"), "pass").when(act.rlike("block|deny|drop"), "block").otherwise(act)
    protocol = F.lower(by(field("proto"), ext("proto"), F.lit(None)))
    rows = _once(raw.withColumn("parser", kind), {
        "event_id": F.concat(F.lit("EVT-"), F.substring(F.sha2("source", 256), 1, 8), F.lit("-"), F.substring(F.sha2("raw", 256), 1, 16)),
        "ts": by(timestamp(F.coalesce(field("start"), field("end"))), timestamp(F.coalesce(ext("rt"), ext("start"))), timestamp(alias("time")), syslog_time(line)),
        "src_ip": by(field("src"), ext("src"), alias("src_ip")), "dst_ip": by(field("dst"), ext("dst"), alias("dst_ip")),
        "src_port": by(field("sourcePort"), ext("spt"), alias("src_port")).try_cast("int"), "dst_port": by(field("destinationPort"), ext("dpt"), alias("dst_port")).try_cast("int"),
        "protocol": F.when(protocol.isin(*PROTOCOLS), protocol).when(protocol.isNotNull(), "other"),
        "action": by(firewall_action, ext("act"), alias("action")), "tcp_flags": F.when(F.col("parser") == "firewall", tcp_flags(field("tcpFlags"))),
        "inbound_zone": F.when(F.col("parser") == "firewall", field("deviceInboundZone")), "outbound_zone": F.when(F.col("parser") == "firewall", field("deviceOutboundZone")),
        **{name: F.when(F.col("parser") == "firewall", field(of)) for name, of in FIREWALL_TEXTS.items()},
        **{name: F.when(F.col("parser") == "firewall", field(of).try_cast("long")) for name, of in FIREWALL_NUMBERS.items()},
        # an action that names stateful inspection keeps that as its reason
        "action_reason": F.when(F.col("parser") == "firewall", F.coalesce(field("deviceActionReason"), F.when(act.contains("spi"), act))),
    })
    bad_ip = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(_V4) & ~F.col(c).rlike(r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$")
    bad_port = lambda c: F.coalesce(~F.col(c).between(0, 65535), F.lit(False))
    why = F.when(F.octet_length("raw") > MAX_BYTES, "too long").when(F.col("parser").isNull(), "unsupported").when(bad_ip("src_ip") | bad_ip("dst_ip") | bad_port("src_port") | bad_port("dst_port"), "semantically_invalid")
    rows = _once(rows, {"reason": why})
    return rows.where("reason IS NULL").drop("raw", "reason"), rows.where("reason IS NOT NULL").select("source", "reason", F.left("raw", F.lit(500)).alias("preview"))
