"""The whole way from records to incidents: first records, eligibility, rules, suppression, runs, clusters, incidents, and what is left over; with SQL for comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import features_sql, with_features
from ..operators import campaigns, entrance, profiles, rules, scratch, selection, signals, suppression
from ..sources import containers, records
from .lowering import COLUMNS, canonical_events, canonical_sql
from .queries import raw_sql, register

_LATE = "user_id % 10 = 3"
#: A mapping with records that came twice, failed parses, events without time, resets of closed connections, and rare allowed targets.
CHAIN = COLUMNS | {
    "event_id": "'EVT-' || lpad(CAST(CASE WHEN no % 20 = 1 THEN no - 1 ELSE no END AS {string}), 8, '0')",
    "ts_us": "CASE WHEN k % 37 <> 36 THEN CAST(floor(no / 10) AS BIGINT) * 1000000 END",
    "src_ip": f"CASE WHEN {_LATE} THEN '198.18.0.4' ELSE {COLUMNS['src_ip']} END",
    "src_port": f"CASE WHEN {_LATE} THEN 443 ELSE {COLUMNS['src_port']} END",
    "dst_ip": f"CASE WHEN {_LATE} THEN '10.1.0.8' WHEN no % 100 = 12 AND CAST(floor(no / 3000) AS BIGINT) % 4 = 1 THEN '10.9.9.9' WHEN no % 100 = 14 AND CAST(floor(no / 3000) AS BIGINT) % 4 = 2 THEN '10.9.8.8' ELSE {COLUMNS['dst_ip']} END",
    "dst_port": f"CASE WHEN {_LATE} THEN CAST(33000 + no % 30000 AS INT) ELSE {COLUMNS['dst_port']} END",
    "action": f"CASE WHEN {_LATE} THEN 'block' ELSE {COLUMNS['action']} END",
    "tcp_flags": f"CASE WHEN {_LATE} THEN 'RST' ELSE {COLUMNS['tcp_flags']} END",
    "action_reason": f"CASE WHEN {_LATE} THEN 'blocked by spi' ELSE {COLUMNS['action_reason']} END",
    "parse_status": "CASE WHEN k % 41 = 40 THEN 'failed' WHEN k % 41 = 39 THEN 'semantically_invalid' ELSE 'parsed' END",
    "raw_record_hash": "'h'",
}
POLICY = suppression.Policy(("telnet_probe",), ("45.83.64.5/32",), ("10.9.9.9/32",), (("45.83.64.2/32", "10.9.8.0/24"), ("10.20.0.0/16", "10.9.8.8/32")))
_MARKS = {
    "late": "action_reason = 'blocked by spi' AND blocked AND src_port = 443 AND dst_port >= 32768 AND tcp_flags IN ('RST', 'RST,ACK')",
    "to": "{tgt} = '10.9.9.9'",
    "pair": "{tgt} LIKE '10.9.8.%' AND ({entity} = '45.83.64.2' OR ({entity} LIKE '10.20.%' AND {tgt} = '10.9.8.8'))",
}
_REASON = "CASE WHEN rule = 'spi_anomaly_burst' AND n_late = n AND n >= 2 AND p = n AND q = 1 AND t = 1 THEN 'late_rst_from_established_service' WHEN rule = 'telnet_probe' THEN 'rule' WHEN entity = '45.83.64.5' THEN 'source' WHEN n_to > 0 THEN 'destination' WHEN n_pair > 0 THEN 'pair' END"


def eligible(spark: SparkSession, sf_dir: str, columns: dict[str, str] = CHAIN) -> DataFrame:
    """Featured events that the rules may see, stored."""
    rows = entrance.eligible(entrance.first_records(canonical_events(spark, sf_dir, columns), F.col("event_no")))
    return scratch.stored(with_features(rows), "featured")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return signals.correlated(eligible(spark, sf_dir), policy=POLICY)


def _first(columns: dict[str, str] = CHAIN) -> str:
    return f"(SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY event_id, raw_record_hash ORDER BY event_no) AS _r FROM {canonical_sql(columns)}) WHERE _r = 1 AND ts_us IS NOT NULL AND parse_status NOT IN ('failed', 'unsupported_schema', 'semantically_invalid'))"


_FIRST = _first()


def _members_sql(rule: rules.Rule) -> str:
    key = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in rule.key)
    return f"SELECT '{rule.name}' AS rule, {key} AS key, event_id, ts_us, CAST({rule.target} AS VARCHAR) AS tgt, {rule.blocked if rule.kind == 'sequence' else 'true'} AS inside FROM featured WHERE {rule.where}"


_NAMES = [n for tier in signals.PRECEDENCE for n in tier]
_FAMILIES = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.family}'" for r in rules.RULES) + " END"
_LEVEL = "list_position(['informational', 'low', 'medium', 'high', 'critical'], severity)"
def _base(source: str) -> str:
    """Tables of the chain, for DuckDB, over canonical events that rules may see."""
    return f"""WITH RECURSIVE featured AS MATERIALIZED (SELECT * FROM {features_sql(source)}),
raw AS MATERIALIZED (SELECT *, {_REASON} AS reason FROM ({raw_sql(_MARKS)})),
named AS (SELECT *, 'SIG-' || upper(substr(sha256(concat_ws('|', rule, '1.0.0', entity, CASE WHEN n_merged > 1 THEN 'merged ' ELSE '' END || corr, first_us, first_id, last_us, event_id)), 1, 12)) AS signal_id FROM ({signals.merge_sql('SELECT * FROM raw WHERE reason IS NULL')})),
merged AS MATERIALIZED (SELECT *, {_FAMILIES} AS family, coalesce(list_position({_NAMES}, rule), {len(_NAMES) + 1}) AS place, {_LEVEL} AS level FROM named),
members AS ({' UNION ALL '.join(_members_sql(r) for r in rules.RULES)}),
bridge AS MATERIALIZED (SELECT DISTINCT signal_id, m.entity, m.rule, x.event_id, x.ts_us, x.tgt FROM members x JOIN merged m ON m.rule = x.rule AND m.key = x.key AND (x.ts_us, x.event_id) >= (m.first_us, m.first_id) AND (x.ts_us, x.event_id) <= (m.last_us, m.event_id)
  WHERE x.inside OR EXISTS (SELECT 1 FROM raw r WHERE r.reason IS NULL AND r.rule = x.rule AND r.key = x.key AND r.event_id = x.event_id)),
sizes AS (SELECT signal_id, count(*) AS n, list_sort(list(event_id)) AS ids, list(tgt) FILTER (WHERE tgt <> '') AS tgts FROM bridge GROUP BY signal_id),
own AS MATERIALIZED (SELECT m.*, n, ids, list_append(coalesce(tgts, []), m.entity) AS scope, row_number() OVER (ORDER BY place, -level, -confidence, first_us, rule, signal_id) AS turn FROM merged m JOIN sizes USING (signal_id)),
common AS (SELECT a.signal_id AS a, b.signal_id AS b, count(*) AS common FROM bridge a JOIN bridge b ON a.event_id = b.event_id AND a.entity = b.entity AND a.signal_id <> b.signal_id GROUP BY a.signal_id, b.signal_id
  UNION ALL SELECT a.signal_id, b.signal_id, a.n FROM own a JOIN own b ON a.ids = b.ids AND a.entity <> b.entity AND list_has_any(a.scope, b.scope) WHERE a.family IN ('firewall_exposure', 'firewall_policy') AND b.family IN ('firewall_exposure', 'firewall_policy')),
cand AS MATERIALIZED (SELECT c.a AS signal_id, c.b AS anchor, row_number() OVER (PARTITION BY c.a ORDER BY common / least(x.n, y.n) DESC, y.turn) AS rank FROM common c JOIN own x ON x.signal_id = c.a JOIN own y ON y.signal_id = c.b
  WHERE y.turn < x.turn AND 10 * common >= 7 * least(x.n, y.n) AND greatest(x.first_us - y.last_us, y.first_us - x.last_us) <= {signals.MERGE_SECONDS}000000),
st AS (SELECT 0 AS round, signal_id, CASE WHEN signal_id NOT IN (SELECT signal_id FROM cand) THEN signal_id END AS anchor_id FROM own
  UNION ALL SELECT s.round + 1, s.signal_id, CASE WHEN s.anchor_id IS NOT NULL THEN s.anchor_id WHEN g.waiting = 0 THEN coalesce(g.best, s.signal_id) END
  FROM st s LEFT JOIN (SELECT c.signal_id, count(*) FILTER (WHERE t.anchor_id IS NULL) AS waiting, arg_min(c.anchor, c.rank) FILTER (WHERE t.anchor_id = t.signal_id) AS best FROM cand c JOIN st t ON t.signal_id = c.anchor GROUP BY c.signal_id) g ON g.signal_id = s.signal_id
  WHERE EXISTS (SELECT 1 FROM st WHERE anchor_id IS NULL)),
clusters AS MATERIALIZED (SELECT signal_id, anchor_id FROM st WHERE round = (SELECT max(round) FROM st))"""


_BASE = _base(_FIRST)


@register("suppressed_by_rule", f"WITH featured AS MATERIALIZED (SELECT * FROM {features_sql(_FIRST)}) SELECT rule, reason, count(*) AS n, count(DISTINCT entity) AS n_entities, min(first_us) AS first_us, max(last_us) AS last_us FROM (SELECT *, {_REASON} AS reason FROM ({raw_sql(_MARKS)})) GROUP BY rule, reason")
def suppressed_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many raw signals of each rule are suppressed, and why (null: not)."""
    raw = signals.all_signals(eligible(spark, sf_dir), policy=POLICY)
    return scratch.stored(raw.groupBy("rule", "reason").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("n_entities"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")), "suppressed")


_INCIDENTS = f"""mine AS (SELECT c.anchor_id, m.* FROM clusters c JOIN own m USING (signal_id)),
best AS (SELECT anchor_id, round(avg(confidence), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY confidence DESC, signal_id) AS r FROM mine) WHERE r <= 3 GROUP BY anchor_id),
span AS (SELECT anchor_id, min(first_us) AS first_us, max(last_us) AS last_us, count(*) AS n_signals, max(level) - 1 AS level FROM mine GROUP BY anchor_id),
seen AS (SELECT anchor_id, event_id, bool_or(signal_id = anchor_id) AS anchors FROM bridge JOIN clusters USING (signal_id) GROUP BY anchor_id, event_id),
targets AS (SELECT anchor_id, count(DISTINCT tgt) FILTER (WHERE tgt <> '') AS n_targets FROM bridge JOIN clusters USING (signal_id) GROUP BY anchor_id),
ports AS (SELECT anchor_id, max(ports) AS ports FROM (SELECT anchor_id, eff_dst, count(DISTINCT eff_port) FILTER (WHERE allowed AND sensitive_service IS NOT NULL AND NOT critical_port) AS ports FROM seen JOIN featured USING (event_id) GROUP BY anchor_id, eff_dst) GROUP BY anchor_id),
facts AS (SELECT anchor_id, count(*) AS n_events, count(*) FILTER (WHERE allowed) AS n_allowed, count(*) FILTER (WHERE blocked) AS n_blocked, count(DISTINCT eff_dst) AS n_dst, count(*) FILTER (WHERE allowed AND critical_port) AS critical,
  min(coalesce(translated_dst_ip, dst_ip)) FILTER (WHERE anchors) AS asset, min(src_ip) FILTER (WHERE anchors) AS source FROM seen JOIN featured USING (event_id) GROUP BY anchor_id),
judged AS (SELECT o.rule, o.family, o.entity, s.*, f.* EXCLUDE (anchor_id), p.ports, b.confidence, t.n_targets, CAST(n_events > 500 OR n_dst > 50 AS INT) AS volume FROM span s JOIN own o ON o.signal_id = s.anchor_id JOIN facts f USING (anchor_id) JOIN ports p USING (anchor_id) JOIN best b USING (anchor_id) JOIN targets t USING (anchor_id))
SELECT 'INC-' || substr(anchor_id, 5, 12) AS incident_id, rule, family, entity, CASE WHEN family IN ('firewall_exposure', 'firewall_policy') THEN coalesce(asset, entity) ELSE entity END AS primary_entity, coalesce(source, entity) AS title_source, first_us, last_us, n_signals, n_events,
  n_allowed, n_blocked, n_dst, n_targets, confidence,
  (['informational', 'low', 'medium', 'high', 'critical'])[1 + CASE WHEN family IN ('network_anomaly', 'network_dos') THEN least(4, level + volume) WHEN n_allowed = 0 AND family IN ('network_scanning', 'service_probing', 'lateral_movement_candidate') THEN CASE WHEN n_dst >= 25 THEN 2 ELSE 1 END
    WHEN n_allowed > 0 THEN least(4, CASE WHEN critical > 0 THEN 4 WHEN ports > 0 THEN 3 ELSE 2 END + CAST(n_dst <= 2 AND ports >= 2 AS INT) + volume) ELSE 1 END] AS severity FROM judged"""


@register("incidents", f"{_BASE}, {_INCIDENTS}")
def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of all rules' active signals, before overlapping ones are merged."""
    return _tables(spark, sf_dir)["first_incidents"]


@register("incidents_merged")
def incidents_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents after the overlapping ones of a type and owner are merged; a fold by size, tested against a plain one."""
    return _tables(spark, sf_dir)["incidents"]


@register("signal_details", f"""{_BASE}, few AS (SELECT signal_id, list(event_id ORDER BY r) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY ts_us, event_id) AS r FROM bridge) WHERE r <= 3 GROUP BY signal_id)
SELECT signal_id, rule, entity, n_merged, count(*) AS n_events, count(DISTINCT tgt) FILTER (WHERE tgt <> '') AS n_targets, min(tgt) FILTER (WHERE tgt <> '') AS first_target, array_to_string(any_value(evidence), ',') AS evidence
FROM bridge JOIN few USING (signal_id) JOIN (SELECT signal_id, n_merged FROM merged) USING (signal_id) GROUP BY signal_id, rule, entity, n_merged""")
def signal_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged signals with targets, counts and their first three events."""
    found = _tables(spark, sf_dir)
    return signals.signal_details(found["merged"], found["bridge"]).select("signal_id", "rule", "entity", "n_merged", "n_events", "n_targets", "first_target", F.array_join("evidence", ",").alias("evidence"))


@register("contract_violations", f"""{_BASE}, d AS (SELECT m.rule, m.entity, m.first_us, m.last_us, m.confidence, count(*) AS n, count(DISTINCT tgt) FILTER (WHERE tgt <> '') AS n_targets FROM bridge JOIN merged m USING (signal_id) GROUP BY signal_id, m.rule, m.entity, m.first_us, m.last_us, m.confidence),
f AS (SELECT rule, unnest(list_filter([CASE WHEN entity = '' THEN 'entity' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN last_us < first_us THEN 'times' END, CASE WHEN n_targets < 1 THEN 'targets' END], lambda x: x IS NOT NULL)) AS fault FROM d)
SELECT r.rule, fault, n, n_faults FROM (SELECT rule, count(*) AS n FROM d GROUP BY rule) r LEFT JOIN (SELECT rule, fault, count(*) AS n_faults FROM f GROUP BY rule, fault) USING (rule)""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged signals of each rule, and how many break the contract of signals, by fault (null: none does)."""
    found = _tables(spark, sf_dir)
    details = scratch.stored(signals.signal_details(found["merged"], found["bridge"]), "details")
    faults = signals.violations(details).groupBy("rule", "fault").agg(F.count("*").alias("n_faults"))
    return details.groupBy("rule").agg(F.count("*").alias("n")).join(faults, "rule", "left").select("rule", "fault", "n", "n_faults")


@register("uncorrelated_events", f"""{_BASE} SELECT src_ip, count(*) AS n, count(*) FILTER (WHERE event_id NOT IN (SELECT event_id FROM bridge)) AS n_uncorrelated, min(event_id) FILTER (WHERE event_id NOT IN (SELECT event_id FROM bridge)) AS first_id FROM featured GROUP BY src_ip""")
def uncorrelated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: eligible events, and those that no incident has."""
    events = eligible(spark, sf_dir)
    held = signals.correlated(events, policy=POLICY)["bridge"].select("event_id").distinct().withColumn("_held", F.lit(True))
    rows = events.select("event_id", "src_ip").join(held, "event_id", "left").withColumn("_free", F.col("_held").isNull())
    return rows.groupBy("src_ip").agg(F.count("*").alias("n"), F.count_if("_free").alias("n_uncorrelated"), F.min(F.when(F.col("_free"), F.col("event_id"))).alias("first_id"))


_HELD = """facts AS (SELECT 'INC-' || substr(anchor_id, 5, 12) AS incident_id, event_id, bool_or(signal_id = anchor_id) AS anchors FROM bridge JOIN clusters USING (signal_id) GROUP BY anchor_id, event_id),
heads AS (SELECT 'INC-' || substr(c.anchor_id, 5, 12) AS incident_id, o.rule, o.family, CASE WHEN o.family IN ('firewall_exposure', 'firewall_policy') THEN coalesce(a.asset, o.entity) ELSE o.entity END AS primary_entity, s.first_us, s.last_us
  FROM (SELECT DISTINCT anchor_id FROM clusters) c JOIN own o ON o.signal_id = c.anchor_id JOIN (SELECT anchor_id, min(m.first_us) AS first_us, max(m.last_us) AS last_us FROM clusters JOIN merged m USING (signal_id) GROUP BY anchor_id) s USING (anchor_id)
  JOIN (SELECT incident_id, min(coalesce(translated_dst_ip, dst_ip)) FILTER (WHERE anchors) AS asset FROM facts JOIN featured USING (event_id) GROUP BY incident_id) a ON a.incident_id = 'INC-' || substr(c.anchor_id, 5, 12))"""
_PROFILES = f"{_BASE}, {_HELD}, profiles AS MATERIALIZED ({profiles.profiles_sql('heads', 'facts', 'featured')})"


def _profiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Incidents before overlapping ones are merged, and their profiles."""
    events = eligible(spark, sf_dir)
    found = signals.correlated(events, policy=POLICY)
    return found["first_incidents"], profiles.profiles(found["first_incidents"], found["held"], events)


@register("incident_profiles", f"{_PROFILES} SELECT h.incident_id, h.rule, h.family, strategy, correlation_key, profile FROM heads h LEFT JOIN profiles USING (incident_id)")
def incident_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each incident of the engine, or none."""
    found, own = _profiled(spark, sf_dir)
    return found.select("incident_id", "rule", "family").join(own, "incident_id", "left")


JOB_US, WINDOW_US, TTL_US = 60_000_000, 120_000_000, 300_000_000


@register("profile_campaigns", f"""{_PROFILES}, arrivals AS MATERIALIZED (SELECT correlation_key AS key, first_us // {JOB_US} AS job, min(first_us) AS first_us, max(last_us) AS last_us FROM profiles JOIN heads USING (incident_id) GROUP BY 1, 2),
o AS MATERIALIZED (SELECT *, (job + 1) * {JOB_US} AS now_us, row_number() OVER (PARTITION BY key ORDER BY job) AS r FROM arrivals),
s AS (SELECT key, job, r, 'first' AS decision, CAST(1 AS BIGINT) AS generation, first_us AS a, last_us AS z, now_us + {TTL_US} AS e FROM o WHERE r = 1
UNION ALL SELECT key, job, r, d, CASE WHEN d IN ('stale', 'merge') THEN generation ELSE generation + 1 END, CASE d WHEN 'stale' THEN a WHEN 'merge' THEN least(a, first_us) ELSE first_us END, CASE d WHEN 'stale' THEN z WHEN 'merge' THEN greatest(z, last_us) ELSE last_us END,
CASE WHEN d = 'stale' THEN e ELSE now_us + {TTL_US} END
FROM (SELECT o.key, o.job, o.r, o.first_us, o.last_us, o.now_us, s.generation, s.a, s.z, s.e, CASE WHEN s.e <= o.now_us OR o.first_us > s.z + {WINDOW_US} THEN 'new_generation' WHEN o.last_us < s.a - {WINDOW_US} THEN 'stale' ELSE 'merge' END AS d FROM s JOIN o ON o.key = s.key AND o.r = s.r + 1))
SELECT key, job, decision, generation, a AS campaign_first_us, z AS campaign_last_us FROM s""")
def profile_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's incidents as arrivals of jobs of a minute, keyed by their profiles, against the state of their campaigns."""
    found, own = _profiled(spark, sf_dir)
    rows = own.join(found.select("incident_id", "first_us", "last_us"), "incident_id").groupBy(F.col("correlation_key").alias("key"), F.expr(f"first_us div {JOB_US}").alias("job")).agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    rows = rows.withColumns({"arrival_id": F.lit(""), "version": F.lit("1"), "now_us": (F.col("job") + 1) * JOB_US, "alive": F.lit(True)})
    return campaigns.replay(rows, WINDOW_US, TTL_US).select("key", "job", "decision", "generation", "campaign_first_us", "campaign_last_us")


_STRATA = f"""{_BASE}, mine AS (SELECT 'INC-' || substr(anchor_id, 5, 12) AS incident_id, o.signal_id, o.rule, o.family, o.signal_id = anchor_id AS main, o.last_us % 7 = 0 AS current FROM clusters JOIN own o USING (signal_id))"""


@register("selected_signals", f"{_STRATA} {selection.signals_sql('mine', 3)}")
def selected_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three signals of each incident by strata: the anchor, one of the current job (here by time), families and sequences that matter, and others in order."""
    found = _tables(spark, sf_dir)
    rows = found["merged"].join(found["first_clusters"], "signal_id")
    rows = rows.select(F.concat(F.lit("INC-"), F.substring("anchor_id", 5, 12)).alias("incident_id"), "signal_id", "rule", signals.family_of(F.col("rule")).alias("family"), (F.col("signal_id") == F.col("anchor_id")).alias("main"), (F.col("last_us") % 7 == 0).alias("current"))
    return selection.chosen_signals(rows, 3)


@register("selected_events", f"""{_BASE}, held AS (SELECT DISTINCT 'INC-' || substr(anchor_id, 5, 12) AS incident_id, b.event_id, f.ts_us, f.event_no % 3 = 0 AS current FROM bridge b JOIN clusters USING (signal_id) JOIN featured f ON f.event_id = b.event_id) {selection.events_sql('held', 5)}""")
def selected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events of each incident: the first of the current job and the first of others have a place, the rest go by time."""
    events = eligible(spark, sf_dir)
    found = signals.correlated(events, policy=POLICY)
    held = found["held"].join(events.select("event_id", "ts_us", (F.col("event_no") % 3 == 0).alias("current")), "event_id")
    return selection.chosen_events(held, 5)


_TEXT = """'"' || CAST({x} AS {string}) || '"'"""
_FIELDS = {
    "start": "CAST(ts_us / 1000000 AS BIGINT)", "src": "CASE WHEN parse_status = 'semantically_invalid' THEN '999.1.1.1' ELSE src_ip END", "dst": "dst_ip", "sourcePort": "src_port", "destinationPort": "dst_port", "proto": "protocol", "deviceAction": "action",
    "deviceActionReason": "action_reason", "tcpFlags": "tcp_flags", "deviceInboundZone": "inbound_zone", "deviceOutboundZone": "outbound_zone", "destinationTranslatedAddress": "translated_dst_ip", "packets": "event_no % 5 + 1", "bytes": "event_no % 5 * 60 + 60", "id": "event_no",
}
#: Firewall lines of the chain's events, in SQL that Spark and DuckDB share; some are no records, and some name no address.
_RAW = "CASE WHEN parse_status = 'failed' THEN 'garbage line ' || CAST(event_no AS {string}) ELSE '{' || " + " || ',' || ".join(f"""'"{name}":' || coalesce({_TEXT.replace('{x}', sql)}, 'null')""" for name, sql in _FIELDS.items()) + " || '}' END"


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, raw, event_no): a line for each event; every twentieth came twice."""
    rows = canonical_events(spark, sf_dir, CHAIN | {"event_id": "CAST(no AS {string})"})
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("event_no") % 20 == 0, 2).otherwise(1)))
    return scratch.stored(rows.select(F.lit("lines").alias("source"), F.expr(_RAW.replace("{string}", "STRING")).alias("raw"), "event_no", twice.alias("_n")).drop("_n"), "lines")  # what files would hold


_LINES = f"(SELECT *, {_RAW.replace('{string}', 'VARCHAR')} AS raw FROM {canonical_sql(CHAIN | {'event_id': 'CAST(no AS {string})'})})"
_PARSED = f"(SELECT * EXCLUDE (raw) REPLACE ('EVT-' || substr(sha256('lines'), 1, 8) || '-' || substr(sha256(raw), 1, 16) AS event_id, 'tcp' AS protocol) FROM {_LINES} WHERE parse_status = 'parsed')"


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found, failures = records.parse(raw_lines(spark, sf_dir))
    found = scratch.stored(found, "parsed")  # each event is parsed once
    return found.withColumns({"ts_us": F.unix_micros("ts"), "safe_message_excerpt": F.lit(""), "event_outcome": F.lit(None).cast("string"), "parse_status": F.lit("parsed"), "raw_record_hash": F.col("event_id")}), failures


@register("parsed_events", f"SELECT event_id, event_no, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, action, action_reason, tcp_flags, inbound_zone, outbound_zone, translated_dst_ip, event_no % 5 + 1 AS packets, event_no % 5 * 60 + 60 AS bytes, CASE WHEN event_no % 20 = 0 THEN 2 ELSE 1 END AS n_lines FROM {_PARSED}")
def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firewall lines to canonical events, and how many lines each came in."""
    names = ("event_id", "event_no", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "action", "action_reason", "tcp_flags", "inbound_zone", "outbound_zone", "translated_dst_ip", "packets", "bytes")
    return _parsed(spark, sf_dir)[0].groupBy(*names).agg(F.count("*").cast("int").alias("n_lines"))


@register("ingestion_counts", f"""WITH l AS (SELECT parse_status, ts_us, CASE WHEN event_no % 20 = 0 THEN 2 ELSE 1 END AS n FROM {_LINES})
SELECT CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n) FILTER (WHERE parse_status = 'parsed') AS BIGINT) AS n_parsed, CAST(sum(n) FILTER (WHERE parse_status = 'failed') AS BIGINT) AS n_unsupported, CAST(sum(n) FILTER (WHERE parse_status = 'semantically_invalid') AS BIGINT) AS n_invalid, CAST(sum(n - 1) FILTER (WHERE parse_status = 'parsed') AS BIGINT) AS n_repeated, count(*) FILTER (WHERE parse_status = 'parsed' AND ts_us IS NOT NULL) AS n_eligible FROM l""")
def ingestion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the lines: parsed, refused and why, repeated, seen by the rules."""
    found, failures = _parsed(spark, sf_dir)
    once = found.groupBy("event_id").agg(F.count("*").alias("n"), F.max(F.col("ts_us").isNotNull()).alias("timed"))  # equal lines have one id
    a = once.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_parsed"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"), F.count_if("timed").alias("n_eligible"))
    b = failures.agg(F.count_if(F.col("reason") == "unsupported").alias("n_unsupported"), F.count_if(F.col("reason") == "semantically_invalid").alias("n_invalid"), F.count("*").alias("n_bad"))
    return a.join(b).select((F.col("n_parsed") + F.col("n_bad")).alias("n_lines"), "n_parsed", "n_unsupported", "n_invalid", "n_repeated", "n_eligible")  # two rows of totals


@register("raw_incidents", f"{_base(f'(SELECT * FROM {_PARSED} WHERE ts_us IS NOT NULL)')}, {_INCIDENTS}")
def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: raw lines, parsing, first records, eligibility, rules, suppression, incidents."""
    rows = _parsed(spark, sf_dir)[0]
    events = scratch.stored(with_features(entrance.eligible(entrance.first_records(rows, F.col("event_no")))), "featured")
    return signals.correlated(events, policy=POLICY)["first_incidents"]


#: Records of several shapes, with braces, quotes and escapes in their texts, in SQL that Spark and DuckDB share.
_RECORD = """CASE no % 4 WHEN 0 THEN '{"user":' || CAST(user_id AS {string}) || ',"msg":"a } ' || chr(92) || '" { ] , b"}' WHEN 1 THEN '{"props":{"k":' || CAST(k AS {string}) || ',"deep":{"a":{"b":{"c":1}}}},"tags":["x}",{"y":1}],"ok":true}'
WHEN 2 THEN '{"type":"' || event_type || '","none":null,"half":0.5}' ELSE '{}' END"""
_GROUP = 200


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("no"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@register("container_fingerprints", """SELECT CASE event_id % 4 WHEN 0 THEN 'msg:str,user:int' WHEN 1 THEN 'ok:bool,props:{deep:{a:{b:dict}},k:int},tags:list' WHEN 2 THEN 'half:float,none:NoneType,type:str' ELSE '' END AS fingerprint, count(*) AS n,
CAST(sum(length(CASE event_id % 4 WHEN 0 THEN '{"user":' || user_id || ',"msg":"a } ' || chr(92) || '" { ] , b"}' WHEN 1 THEN '{"props":{"k":' || json_extract_string(props, '$.k') || ',"deep":{"a":{"b":{"c":1}}}},"tags":["x}",{"y":1}],"ok":true}' WHEN 2 THEN '{"type":"' || event_type || '","none":null,"half":0.5}' ELSE '{}' END)) AS BIGINT) AS n_chars FROM events GROUP BY 1""")
def container_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of files of JSON arrays, by shape. The arrays (of a bounded number of events each) are written first."""
    made = _raw_events(spark, sf_dir).select((F.col("no") / _GROUP).cast("long").alias("g"), F.expr(_RECORD.replace("{string}", "STRING")).alias("raw"))
    arrays = made.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("raw"), ", "), F.lit("]")).alias("value")).select("value")
    path = f"{scratch.folder(spark)}/arrays-{uuid.uuid4().hex}"
    arrays.write.text(path)
    found, _ = containers.read_objects(spark, path)
    return found.groupBy(containers.fingerprint(F.col("raw")).alias("fingerprint")).agg(F.count("*").alias("n"), F.sum(F.length("raw")).alias("n_chars"))
