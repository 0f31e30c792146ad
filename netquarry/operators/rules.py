"""The detection rules as data, and the operators that evaluate them.

A window rule looks, at each event in (ts, event_id) order within its key, at the events of the last ``seconds`` up to and with that
one (the bound included), and fires where ``having`` holds. Aggregates: n (events), t (distinct targets), p (distinct ports), q
(distinct services), b (blocked), s (SYN), first_us, span (seconds). A sequence rule looks, at each allowed event, at the earlier
blocked ones of its key within the window (n counts these and the allowed event); ``related`` tells that one of them went to the same
destination and service. A group rule looks once at all events of its key, and has two aggregates more: ok (allowed) and x (events to a sensitive port).

How it scales: time is cut into stretches of STRETCH windows, so a window spans at most two of them: an event is copied to the next stretch if that begins
within its window, and (rule, key, stretch) is the shuffle key: a hot source is split by time, and no task has to sort more of it
than STRETCH + 1 windows. Within them all aggregates are running sums over events that enter and leave: no window is gathered, and the
cost per event does not depend on the window's size. Each result belongs to the bucket of its last event. Only the columns that a rule needs are
shuffled, and rules that need the same sorts share one shuffle (those that count at most one value, those that count more, sequences). Group rules take partial aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.features import CRITICAL_PORTS, SENSITIVE_PORTS


@dataclass(frozen=True)
class Rule:
    name: str
    key: tuple[str, ...]
    where: str
    having: str
    entity: str
    severity: str
    confidence: tuple[float, float]
    threshold: int
    seconds: int = 300
    target: str = "dst_ip"
    port: str = "dst_port"
    blocked: str = "blocked"
    kind: str = "window"  # or sequence, group
    strength: str = "n"  # the count that confidence grows with
    family: str = "network_scanning"


_VALID = "ips_valid"
_PORTS = "ips_valid AND dst_port IS NOT NULL"
_SYN_HALF = "(proto <> 'TCP' OR 2 * s >= n)"
_X = "exposable AND allowed"
_SENSITIVE = f"dst_port IN ({', '.join(map(str, (*SENSITIVE_PORTS, *CRITICAL_PORTS)))})"


def _probe(name: str, ports: str, having: str = "n >= 5 AND t >= 3 AND 10 * b >= 6 * n AND 2 * s >= n", severity: str = "high", confidence=(0.7, 0.95), threshold: int = 5) -> Rule:
    return Rule(name, ("src_ip",), f"{_VALID} AND tcp AND dst_port IN ({ports})", having, "src_ip", f"'{severity}'", confidence, threshold, family="service_probing")


def _flags(name: str, where: str, having: str, severity: str = "medium", family: str = "network_scanning", threshold: int = 5) -> Rule:
    return Rule(name, ("src_ip",), f"{_VALID} AND tcp AND {where}", having, "src_ip", f"'{severity}'", (0.75, 0.95) if severity == "high" else (0.65, 0.9), threshold, family=family)


_WIDE = "n >= 5 AND (t >= 3 OR p >= 3) AND 10 * b >= 6 * n"

RULES: tuple[Rule, ...] = (
    Rule("network_scan_horizontal", ("src_ip", "dst_port", "proto_raw"), "coalesce(src_ip, '') <> '' AND coalesce(dst_port, 0) <> 0", f"n >= 10 AND t >= 8 AND 10 * b >= 6 * n AND {_SYN_HALF}", "src_ip", "CASE WHEN t > 16 THEN 'high' ELSE 'medium' END", (0.6, 0.9), 10, blocked="blocked_legacy"),
    Rule("network_scan_vertical", ("src_ip", "dst_ip", "proto_raw"), "coalesce(src_ip, '') <> '' AND coalesce(dst_ip, '') <> ''", f"n >= 10 AND p >= 8 AND 10 * b >= 6 * n AND {_SYN_HALF}", "src_ip", "CASE WHEN p > 16 THEN 'high' ELSE 'medium' END", (0.6, 0.9), 10, port="nullif(dst_port, 0)", blocked="blocked_legacy"),
    Rule("fixed_source_port_scan", ("src_ip", "src_port"), "src_port IN (53, 80, 443) AND probe AND wan_in AND dst_ip IS NOT NULL AND dst_port IS NOT NULL", "n >= 5 AND p >= 3 AND span <= 300", "src_ip", "CASE WHEN ok = 0 AND n < 10 THEN 'low' WHEN ok > 0 AND x > 0 THEN 'high' ELSE 'medium' END", (0.6, 0.9), 5, kind="group"),
    Rule("rdp_probe", ("src_ip",), "tcp AND dst_port = 3389 AND src_ip IS NOT NULL", "n >= 5 AND t >= 3 AND 10 * b >= 6 * n AND 2 * s >= n", "src_ip", "'high'", (0.7, 0.95), 5, blocked="blocked_legacy", family="service_probing"),
    Rule("ssh_probe", ("src_ip",), "tcp AND dst_port = 22 AND src_ip IS NOT NULL", "n >= 5 AND t >= 3 AND 10 * b >= 6 * n AND 2 * s >= n", "src_ip", "'high'", (0.7, 0.95), 5, blocked="blocked_legacy", family="service_probing"),
    Rule("spi_anomaly_burst", ("src_ip",), "spi AND src_ip IS NOT NULL", "n >= 5 AND t >= 1", "src_ip", "'medium'", (0.5, 0.85), 5, family="network_anomaly"),
    Rule("network_flood_dos", ("src_ip", "dst_ip", "coalesce(dst_port, 0)", "proto_raw"), "src_ip IS NOT NULL AND dst_ip IS NOT NULL", "n >= 100 AND 10 * b >= 8 * n", "src_ip", "'high'", (0.7, 0.9), 100, seconds=60, blocked="blocked_legacy", family="network_dos"),
    Rule("low_and_slow_horizontal_scan", ("src_ip", "dst_port", "proto"), _PORTS, f"n >= 12 AND t >= 8 AND span >= 900 AND 10 * b >= 6 * n AND {_SYN_HALF}", "src_ip", "'medium'", (0.65, 0.9), 12, seconds=3600),
    Rule("low_and_slow_vertical_scan", ("src_ip", "dst_ip", "proto"), _PORTS, f"n >= 12 AND p >= 8 AND span >= 900 AND 10 * b >= 6 * n AND {_SYN_HALF}", "src_ip", "'medium'", (0.65, 0.9), 12, seconds=3600),
    Rule("repeated_blocked_scanner", ("src_ip", "proto"), "src_class IS NOT NULL AND (dst_ip IS NULL OR dst_class IS NOT NULL) AND NOT spi AND coalesce(trim(action), '') <> '' AND (NOT tcp OR probe)", "n >= 6 AND 10 * b >= 8 * n AND (t >= 2 OR p >= 2)", "src_ip", "'low'", (0.55, 0.8), 6),
    Rule("distributed_scan", ("dst_ip", "dst_port", "proto"), _PORTS, "n >= 12 AND t >= 6 AND 10 * b >= 8 * n AND (proto <> 'TCP' OR 10 * s >= 6 * n) AND (dst_port NOT IN (80, 443) OR (10 * b >= 9 * n AND 10 * s >= 8 * n))", "dst_ip", "'medium'", (0.7, 0.9), 12, target="src_ip"),
    Rule("internal_lateral_scan", ("src_ip",), "src_private AND dst_private AND src_ip <> dst_ip AND tcp AND dst_port IN (22, 135, 139, 445, 3389, 5900, 5985, 5986)", "n >= 5 AND t >= 3 AND 10 * b >= 6 * n AND 2 * s >= n", "src_ip", "'high'", (0.75, 0.95), 5, family="lateral_movement_candidate"),
    Rule("multi_service_sweep", ("src_ip",), f"{_VALID} AND tcp AND service IS NOT NULL", "n >= 8 AND q >= 3 AND t >= 3 AND 10 * b >= 6 * n AND 2 * s >= n", "src_ip", "'high'", (0.75, 0.95), 8, family="service_probing"),
    Rule("subnet_sweep", ("src_ip", "net24", "dst_port", "proto"), f"{_PORTS} AND net24 IS NOT NULL", f"n >= 8 AND t >= 6 AND 10 * b >= 6 * n AND {_SYN_HALF}", "src_ip", "'medium'", (0.65, 0.9), 8),
    Rule("scan_followed_by_allowed_connection", ("src_ip",), f"{_VALID} AND dst_port IS NOT NULL AND action IS NOT NULL AND (blocked OR allowed)", "b >= 5 AND (t >= 2 OR p >= 2) AND related", "src_ip", "'high'", (0.8, 0.95), 5, seconds=600, kind="sequence", strength="b", family="network_intrusion_candidate"),
    _probe("smb_probe", "139, 445"),
    _probe("vnc_probe", "5900, 5901, 5902, 5903, 5904, 5905"),
    _probe("winrm_probe", "5985, 5986"),
    *(_probe(f"{name}_probe", str(port)) for name, port in (("mssql", 1433), ("oracle", 1521), ("mysql", 3306), ("postgresql", 5432), ("redis", 6379), ("elasticsearch", 9200), ("mongodb", 27017))),
    _probe("kubernetes_api_probe", "6443"),
    _probe("kubelet_probe", "10250"),
    _probe("docker_daemon_probe", "2375, 2376"),
    _probe("web_admin_panel_probe", "8000, 8080, 8443, 8888, 9000, 9443, 10000", "n >= 8 AND t >= 5 AND 10 * b >= 8 * n AND 10 * s >= 6 * n", "medium", (0.65, 0.9), 8),
    _probe("telnet_probe", "23", severity="medium"),
    _probe("ftp_probe", "20, 21", severity="medium"),
    _flags("tcp_null_scan", "tcp_flags = 'NONE'", _WIDE),
    _flags("tcp_xmas_scan", "tcp_flags = 'FIN,PSH,URG'", _WIDE),
    _flags("tcp_fin_scan", "tcp_flags = 'FIN'", _WIDE),
    _flags("tcp_ack_scan", "tcp_flags = 'ACK'", "n >= 10 AND (t >= 3 OR p >= 3) AND 100 * b >= 85 * n", threshold=10),
    _flags("tcp_syn_fin_anomaly", "has_syn AND has_fin", "n >= 5 AND (t >= 3 OR p >= 3) AND 10 * b >= 8 * n", "high", "network_anomaly"),
    _flags("tcp_syn_rst_anomaly", "has_syn AND has_rst", "n >= 5 AND (t >= 3 OR p >= 3) AND 10 * b >= 8 * n", family="network_anomaly"),
    _flags("repeated_tcp_reset_anomaly", "has_rst AND NOT has_syn", "n >= 10 AND (t >= 3 OR p >= 3) AND 10 * b >= 6 * n", family="network_anomaly", threshold=10),
    Rule("spi_followed_by_allowed_connection", ("src_ip",), f"{_PORTS} AND tcp AND (spi_block OR allowed)", "b >= 3 AND related", "src_ip", "'high'", (0.8, 0.95), 3, seconds=600, kind="sequence", strength="b", blocked="spi_block", family="network_intrusion_candidate"),
    Rule("inbound_sensitive_service_allowed", ("src_ip", "eff_dst", "sensitive_service"), f"{_X} AND sensitive_service IS NOT NULL AND external", "n >= 1", "src_ip", "'medium'", (0.65, 0.9), 1, target="eff_dst", port="eff_port", family="firewall_exposure"),
    Rule("critical_management_service_exposed", ("src_ip", "eff_dst", "eff_port"), f"{_X} AND critical_port AND (wan_in OR trans_private) AND NOT inside", "n >= 1", "src_ip", "'high'", (0.8, 0.95), 1, target="eff_dst", port="eff_port", family="firewall_exposure"),
    Rule("dnat_sensitive_service_exposure", ("eff_dst", "eff_port"), f"{_X} AND sensitive_service IS NOT NULL AND trans_private AND (src_public OR wan_in) AND NOT inside", "n >= 1", "eff_dst", "'high'", (0.8, 0.95), 1, target="src_ip", port="eff_port", family="firewall_exposure"),
    Rule("wan_to_lan_sensitive_service_allowed", ("eff_dst", "sensitive_service"), f"{_X} AND sensitive_service IS NOT NULL AND wan_in AND (lan_out OR coalesce(outbound_zone, '') = '') AND NOT inside", "n >= 2", "eff_dst", "'high'", (0.8, 0.95), 2, target="src_ip", port="eff_port", family="firewall_policy"),
    Rule("wan_to_dmz_administrative_service_allowed", ("eff_dst", "admin_service"), f"{_X} AND admin_service IS NOT NULL AND wan_in AND dmz_out AND NOT inside", "n >= 3", "eff_dst", "'medium'", (0.65, 0.9), 3, target="src_ip", port="eff_port", family="firewall_policy"),
    Rule("blocked_then_allowed_same_service", ("src_ip", "eff_dst", "service_or_port"), "exposable AND service_or_port IS NOT NULL AND ((blocked AND NOT spi) OR allowed)", "b >= 3", "src_ip", "'high'", (0.8, 0.95), 3, seconds=600, kind="sequence", target="eff_dst", port="eff_port", family="network_intrusion_candidate"),
    Rule("multi_source_allowed_sensitive_service", ("eff_dst", "sensitive_service"), f"{_X} AND sensitive_service IS NOT NULL AND src_public AND eff_private", "n >= 5 AND t >= 3", "eff_dst", "'high'", (0.8, 0.95), 5, target="src_ip", port="eff_port", family="firewall_exposure"),
)
BY_NAME = {r.name: r for r in RULES}

OUT = ("rule", "entity", "corr", "event_id", "n", "t", "p", "b", "s", "first_us", "last_us", "ids_sum", "severity", "confidence")
_NULL = "\\u0001"
#: Of how many windows a stretch of time is made, and the rules all of whose distinct counts a mark of suppression may ask for.
STRETCH, WHOLE = 4, ("spi_anomaly_burst",)
#: The numbers of the addresses that rules name.
_V4 = {"src_ip": "src_v4", "dst_ip": "dst_v4", "eff_dst": "CASE WHEN coalesce(trim(translated_dst_ip), '') <> '' THEN trans_v4 ELSE dst_v4 END"}


def _confidence(rule: Rule) -> str:
    base, most = rule.confidence
    n, k = rule.strength, rule.threshold
    return f"round(CASE WHEN {n} < {k} THEN {base} * {n} / {k} ELSE least({base} + (1.0 - 1.0 / (1.0 + 0.5 * ({n} / CAST({k} AS DOUBLE) - 1.0))) * ({most} - {base}), {most}) END, 6)"


def _least(rule: Rule) -> str:
    return f"{'b' if rule.kind == 'sequence' else 'n'} >= {max(1, rule.threshold)} AND ({rule.having})"


def _corr(keys: Iterable[str], string: str, null: str = "") -> str:
    return " || '|' || ".join(f"coalesce(CAST({k} AS {string}), '{null}')" for k in keys)


def _form(rule: Rule, carry: bool) -> dict[str, str]:
    """The columns that all rules share, for one rule. inside: whether the event counts in windows (of sequences, blocked ones do)."""
    sequence = rule.kind == "sequence"
    service = "service" if "q >=" in rule.having or sequence else "CAST(src_port AS STRING)" if carry else "CAST(NULL AS STRING)"
    return {
        "rule": f"'{rule.name}'", "key": _corr(rule.key, "STRING", _NULL), "entity": rule.entity, "proto": "proto" if "proto" in rule.key or "proto" in rule.having else "CAST(NULL AS STRING)",
        "dst_port": "dst_port" if "dst_port" in rule.having else "CAST(NULL AS INT)", "event_id": "event_id", "event_no": "event_no", "ts_us": "ts_us", "tgt": f"CAST({rule.target} AS STRING)", "port": f"CAST({rule.port} AS INT)",
        "svc": service, "bl": rule.blocked, "syn": "syn", "ok": "allowed" if rule.kind != "window" else "true", "dport": "dst_port" if sequence else "CAST(NULL AS INT)",
        "sens": _SENSITIVE if rule.kind == "group" else "false", "inside": rule.blocked if sequence else "true", "sequence": f"{sequence}", "size": f"{rule.seconds * 1_000_000}L",
    }


def _counted(rule: Rule, marks: bool, lean: bool) -> tuple[str, ...]:
    """The distinct counts (t, p, q) that a rule is asked for; lean: only those that decide something."""
    if lean and not (marks and rule.name in WHOLE):
        return tuple(c for c in "tpq" if re.search(rf"\b{c}\b", f"{rule.having} {rule.severity}"))
    return ("t", "p", "q") if marks or "q >=" in rule.having else ("t", "p")


def _by_rule(values: Iterable[str]) -> str:
    """SQL that takes, by the number ``rule``, one of the given texts; equal ones share a case."""
    by: dict[str, list[str]] = {}
    for i, sql in enumerate(values):
        by.setdefault(sql, []).append(str(i))
    *some, (last, _) = sorted(by.items(), key=lambda x: len(x[1]))
    return f"CASE {' '.join(f'WHEN rule IN ({", ".join(of)}) THEN {sql}' for sql, of in some)} ELSE {last} END" if some else last


def _shared(events: DataFrame, chosen: list[Rule], forms: list[dict[str, str]], carry: Iterable[str]) -> DataFrame:
    """A row, in the given columns, for each event and rule that looks at it; in SQL ``rule`` is the rule's place in ``chosen``."""
    if len(chosen) == 1:
        return events.where(F.expr(chosen[0].where)).withColumn("rule", F.lit(0)).selectExpr(*[f"{sql} AS {name}" for name, sql in forms[0].items()], *carry)
    looks = F.array_compact(F.array(*[F.when(F.expr(rule.where), F.lit(i)) for i, rule in enumerate(chosen)]))
    return events.withColumn("rule", F.explode(looks)).selectExpr(*[f"{_by_rule(form[name] for form in forms)} AS {name}" for name in forms[0]], *carry)


def members_of(events: DataFrame, chosen: list[Rule], carry: Iterable[str] = (), columns: Iterable[str] | None = None) -> DataFrame:
    """The events that rules look at, in the form that all rules share and in one pass: a row for each event and rule that looks at it.

    carry: columns of the events that come along. Rules without services then have source ports in their place. columns: those of the form that are wanted."""
    carry = list(carry)
    forms = [_form(rule, bool(carry)) for rule in chosen]
    names = list(columns or forms[0])
    return _shared(events, chosen, [{name: form[name] for name in names} for form in forms], carry)


def members(events: DataFrame, rule: Rule, carry: Iterable[str] = ()) -> DataFrame:
    """The same of one rule."""
    return members_of(events, [rule], carry)


def _slots(rule: Rule, form: dict[str, str], counted: tuple[str, ...], width: int, at: int, marks: bool) -> dict[str, str]:
    """The form of one rule for ``_slid``: its place, and the values that it counts in slots v0, v1, ..., which all have one type."""
    values = [f"CAST({form[{'t': 'tgt', 'p': 'port', 'q': 'svc'}[c]]} AS STRING)" for c in counted] + ["CAST(NULL AS STRING)"] * (width - len(counted))
    names = ["key", "entity", "proto", "dst_port", "event_id", "event_no", "ts_us", "bl", "syn", "ok", "inside", "sequence", "size"]
    names += ["tgt", "dport", "svc"] if rule.kind == "sequence" else ["tgt"] if marks else []
    numbers = {"tgt_v4": _V4[rule.target], "entity_v4": _V4[rule.entity]} if marks else {}
    return {"rule": f"{at}", **{name: form[name] for name in names}, **{f"v{i}": x for i, x in enumerate(values)}, **numbers}


def _slid(rows: DataFrame, width: int, sequences: bool, marks: Iterable[str] = ()) -> DataFrame:
    """Each event's window as running sums: an event enters its own stretch of time (and the next one, if that begins within its window), and leaves it ``size`` later
    (after all events of that time). Of a counted value the first of overlapping stays enters, and the last leaves.

    Every row costs the same, however many events its window has; one shuffle by (rule, key, stretch) serves all sorts, whose first column is a number that differs between groups."""
    long = f"(size * {STRETCH})"
    own = F.expr(f"(ts_us - pmod(ts_us, {long})) div {long}")
    rows = rows.withColumn("own", own).withColumn("bucket", F.explode(F.when(F.expr(f"inside AND pmod(ts_us, {long}) >= {long} - size"), F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))))
    rows = rows.withColumn("hash", F.xxhash64("rule", "key", "bucket")).repartition("hash")
    group = ["hash", "rule", "bucket", "key"]
    order = W.partitionBy(*group, "inside").orderBy("ts_us", "event_id")
    rows = rows.withColumn("following", F.lead(F.struct("ts_us", "event_id")).over(order))
    for v in (f"v{i}" for i in range(width)):
        by = W.partitionBy(*group, "inside", v).orderBy("ts_us", "event_id")
        new = F.col("inside") & F.col(v).isNotNull()
        rows = rows.withColumns({f"{v}_in": new & F.coalesce(F.lag("ts_us").over(by) + F.col("size") < F.col("ts_us"), F.lit(True)), f"{v}_out": new & F.coalesce(F.lead("ts_us").over(by) > F.col("ts_us") + F.col("size"), F.lit(True))}).drop(v)
    if sequences:
        last = {}
        for v in ("dport", "svc"):
            by = W.partitionBy(*group, "tgt", v).orderBy("ts_us", "event_id").rowsBetween(W.unboundedPreceding, -1)
            last[v] = F.col(v).isNotNull() & (F.max(F.when(F.col("inside"), F.col("ts_us"))).over(by) >= F.col("ts_us") - F.col("size"))
        rows = rows.withColumn("related", F.col("tgt").isNotNull() & (F.coalesce(last["dport"], F.lit(False)) | F.coalesce(last["svc"], F.lit(False)))).drop("tgt", "dport", "svc")
    else:
        rows = rows.withColumn("related", F.lit(True))
    step = lambda at, phase, sign: F.struct(at.alias("at"), F.lit(phase).alias("phase"), sign.cast("int").alias("sign"))
    enter, leave = step(F.col("ts_us"), 0, F.col("inside").cast("int")), step(F.col("ts_us") + F.col("size"), 1, F.lit(-1))
    rows = rows.withColumn("step", F.explode(F.when(F.expr(f"inside AND ts_us + size < (bucket + 1) * {long}"), F.array(enter, leave)).otherwise(F.array(enter))))
    run = W.partitionBy(*group).orderBy("step.at", "step.phase", "event_id").rowsBetween(W.unboundedPreceding, 0)
    sign = F.col("step.sign").cast("long")
    total = lambda x: F.sum(sign * x).over(run)
    change = lambda v: F.when(sign > 0, F.col(f"{v}_in").cast("long")).when(sign < 0, -F.col(f"{v}_out").cast("long")).otherwise(0)
    own_place = F.struct("ts_us", "event_id")
    first = F.coalesce(F.max(F.when(sign < 0, F.col("following"))).over(run), F.min(F.when(sign > 0, own_place)).over(run))
    rows = rows.withColumns({
        "n": total(F.lit(1)), "b": total(F.col("bl").cast("long")), "s": total(F.col("syn").cast("long")), "ids_sum": total(F.col("event_no")), "first": first,
        **{f"c{i}": F.sum(change(f"v{i}")).over(run) for i in range(width)}, **{f"n_{m}": total(F.col(m).cast("long")) for m in marks},
    })
    return rows.where("step.phase = 0 AND bucket = own AND ok")


def _grouped(rows: DataFrame, marks: Iterable[str] = ()) -> DataFrame:
    """Each group's aggregates (partial sums first)."""
    place = F.struct("ts_us", "event_id")
    rows = rows.groupBy("rule", "key", "entity", "proto", "dst_port").agg(
        F.count("*").alias("n"), F.count_distinct("tgt").alias("t"), F.count_distinct("port").alias("p"), F.count_distinct("svc").alias("q"), F.count_if("bl").alias("b"), F.count_if("syn").alias("s"), F.count_if("ok").alias("ok"), F.count_if("sens").alias("x"),
        F.min(place).alias("first"), F.max(place).alias("last"), F.sum("event_no").alias("ids_sum"),
        *[F.count_if(m).alias(f"n_{m}") for m in marks],
    )
    return rows.withColumns({"ts_us": F.col("last.ts_us"), "event_id": F.col("last.event_id"), "related": F.lit(True)})


def _fired(windows: DataFrame, chosen: list[Rule], marks: Iterable[str] = ()) -> DataFrame:
    windows = windows.withColumns({"first_us": F.col("first.ts_us"), "first_id": F.col("first.event_id")}).withColumn("span", F.expr("(ts_us - first_us) / 1000000.0D"))
    if any(r.kind == "sequence" for r in chosen):  # the allowed event belongs to the signal
        windows = windows.withColumns({"ids_sum": F.expr("ids_sum + IF(sequence, event_no, 0L)"), "n": F.expr("n + IF(sequence, 1L, 0L)"), **{f"n_{m}": F.expr(f"n_{m} + IF(sequence AND {m}, 1L, 0L)") for m in marks}})
    case = lambda of: _by_rule(of(r) for r in chosen)
    return windows.where(F.expr(case(_least))).selectExpr(
        case(lambda r: f"'{r.name}'") + " AS rule", "entity", f"replace(key, '{_NULL}', '') AS corr", "event_id", "n", "t", "p", "b", "s", "first_us", "ts_us AS last_us", "ids_sum",
        f"{case(lambda r: r.severity)} AS severity", f"{case(_confidence)} AS confidence", "key", "first_id", *(["q"] if marks else []), *[f"n_{m}" for m in marks],
    )


def evaluate_all(events: DataFrame, chosen: Iterable[Rule], carry: Iterable[str] = (), marks: dict[str, Column] | None = None, lean: bool = False) -> DataFrame:
    """Signals (OUT, and key and first_id) of rules over featured events. A signal's events are those of its rule and key from (first_us, first_id) to
    (last_us, event_id); of sequences only the blocked ones and the last. Window and sequence rules share a shuffle with those that need the same sorts.

    marks: names of conditions (over tgt_v4 and entity_v4, the addresses as numbers, and the carried columns) whose events each signal counts as n_<name>;
    with them comes q, for rules without services the distinct source ports. lean: of t, p and q a rule has only those that decide something (WHOLE: all), the others are null.

    Defined cases: events with null in a key column that ``where`` does not exclude form a group of their own; equal timestamps are
    ordered by event_id; rows with equal time and event_id are events in an order of chance. No events: no signals."""
    chosen, marks, carry = list(chosen), marks or {}, list(carry)
    out = None
    parts: dict[tuple, list[Rule]] = {}
    wanted = {r.name: _counted(r, bool(marks), lean) for r in chosen}
    for r in chosen:
        parts.setdefault((r.kind, r.kind == "window" and len(wanted[r.name]) > 1), []).append(r)
    for (kind, _), part in parts.items():
        forms = [_form(r, bool(carry)) for r in part]
        width = 0 if kind == "group" else max(len(wanted[r.name]) for r in part)
        if kind == "group":
            forms = [{**form, "rule": f"{i}", **({"tgt_v4": _V4[r.target], "entity_v4": _V4[r.entity]} if marks else {})} for i, (r, form) in enumerate(zip(part, forms, strict=True))]
        else:
            forms = [_slots(r, form, wanted[r.name], width, i, bool(marks)) for i, (r, form) in enumerate(zip(part, forms, strict=True))]
        rows = _shared(events, part, forms, carry)
        if marks:
            rows = rows.withColumns({m: F.coalesce(x, F.lit(False)) for m, x in marks.items()}).drop("tgt_v4", "entity_v4", *(c for c in carry if c not in marks))
        if kind == "group":
            found = _grouped(rows, marks)
        else:
            rows = rows if kind == "sequence" else rows.drop("tgt")
            found = _slid(rows, width, kind == "sequence", marks)
            slot = lambda c: _by_rule(f"c{wanted[r.name].index(c)}" if c in wanted[r.name] else "CAST(NULL AS BIGINT)" if lean else "0L" for r in part)  # noqa: E731, B023
            found = found.withColumns({c: F.expr(slot(c)) for c in "tpq"})
        one = _fired(found, part, marks)
        out = one if out is None else out.unionByName(one)
    return out


def evaluate(events: DataFrame, rule: Rule) -> DataFrame:
    return evaluate_all(events, [rule])


def rule_sql(rule: Rule, featured: str, marks: dict[str, str] | None = None) -> str:
    """The same by a self-join, for DuckDB. marks: conditions over the featured columns, {tgt} and {entity}."""
    marks = marks or {}
    size = rule.seconds * 1_000_000
    sequence = rule.kind == "sequence"
    agg = f"count(*){' + 1' if sequence else ''} AS n, count(DISTINCT b.tgt) AS t, count(DISTINCT b.port) AS p, count(DISTINCT b.service) AS q, count(*) FILTER (WHERE b.bl) AS b, count(*) FILTER (WHERE b.syn) AS s, min(b.ts_us) AS first_us, min((b.ts_us, b.event_id)) AS first_place, CAST(sum(b.event_no){' + any_value(a.event_no)' if sequence else ''} AS BIGINT) AS ids_sum, {'bool_or(b.tgt = a.tgt AND (b.dst_port = a.dst_port OR b.service = a.service))' if sequence else 'true'} AS related"
    conditions = "".join(f", coalesce({x.format(tgt=rule.target, entity=rule.entity)}, false) AS {m}" for m, x in marks.items())
    if marks and "q >=" not in rule.having and not sequence:
        agg = agg.replace("b.service", "b.src_port")
    agg += "".join(f", count(*) FILTER (WHERE b.{m}){f' + max(CAST(a.{m} AS INT))' if sequence else ''} AS n_{m}" for m in marks)
    rows = f"SELECT *{conditions}, {rule.target} AS tgt, {rule.port} AS port, {rule.blocked} AS bl, {rule.entity} AS entity, {_corr(rule.key, 'VARCHAR')} AS corr, {', '.join(f'{k} AS key{i}' for i, k in enumerate(rule.key))} FROM {featured} WHERE {rule.where}"
    keys = [*[f"key{i}" for i in range(len(rule.key))], "corr", "proto", "entity"]
    if "dst_port" in rule.having:
        keys.append("dst_port")
    if rule.kind == "group":
        agg += f", count(*) FILTER (WHERE b.allowed) AS ok, count(*) FILTER (WHERE b.{_SENSITIVE}) AS x"
        joined = f"SELECT {', '.join(f'b.{k}' for k in keys)}, max_by(b.event_id, (b.ts_us, b.event_id)) AS event_id, max(b.ts_us) AS ts_us, {agg} FROM f b GROUP BY {', '.join(f'b.{k}' for k in keys)}"
    else:
        order = "b.bl AND (b.ts_us < a.ts_us OR (b.ts_us = a.ts_us AND b.event_id < a.event_id))" if sequence else "b.ts_us < a.ts_us OR (b.ts_us = a.ts_us AND b.event_id <= a.event_id)"
        same = " AND ".join(f"a.key{i} IS NOT DISTINCT FROM b.key{i}" for i in range(len(rule.key)))
        joined = f"SELECT {', '.join(f'a.{k}' for k in keys)}, a.event_id, a.ts_us, {agg} FROM f a JOIN f b ON {same} AND b.ts_us >= a.ts_us - {size}::BIGINT AND ({order}) {'WHERE a.allowed' if sequence else ''} GROUP BY {', '.join(f'a.{k}' for k in keys)}, a.event_id, a.ts_us"
    return f"""
WITH f AS MATERIALIZED ({rows}), g AS (SELECT *, (ts_us - first_us) / 1000000.0 AS span FROM ({joined}))
SELECT '{rule.name}' AS rule, entity, corr, event_id, n, t, p, b, s, first_us, ts_us AS last_us, ids_sum, {rule.severity} AS severity, CAST({_confidence(rule)} AS DOUBLE) AS confidence{', q' * bool(marks)}{''.join(f', n_{m}' for m in marks)}
FROM g WHERE {_least(rule)}"""
