"""Queries over incidents: roll-ups, context, routes, evidence, reports and digests, on incidents that a fixed mapping makes of the events, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import SERVICES, features_sql
from ..operators import relations, rollups, routing, rules, scratch, search, suppression
from .lowering import COLUMNS, canonical_sql, featured_events
from .queries import FEATURED, register

_BUCKET = "CAST(CAST(floor(ts_us / {seconds}000000) AS BIGINT) AS {{string}})"
#: Which incidents an event belongs to: (condition, columns).
MEMBERSHIPS = (
    ("true", {
        "incident_id": "'INC-' || src_ip || '-' || CAST(dst_port AS {string}) || CASE WHEN dst_port % 2 = 0 AND dst_port <> 3306 THEN '' WHEN allowed THEN '-a' ELSE '-b' END || '-' || " + _BUCKET.format(seconds=100).replace("{{", "{").replace("}}", "}"),
        "rule": "CASE dst_port WHEN 22 THEN 'ssh_probe' WHEN 23 THEN 'repeated_blocked_scanner' WHEN 445 THEN 'smb_probe' WHEN 3306 THEN 'spi_anomaly_burst' WHEN 8080 THEN 'web_admin_panel_probe' ELSE 'network_scan_horizontal' END",
        "family": "CASE WHEN dst_port = 3306 THEN 'network_anomaly' WHEN CAST(floor(ts_us / 400000000) AS BIGINT) % 2 = 0 THEN 'network_scanning' ELSE 'service_probing' END",
        "severity": "CASE WHEN dst_port IN (23, 3389) THEN 'low' WHEN dst_port % 4 = 0 THEN 'high' ELSE 'medium' END",
        "entity": "src_ip",
    }),
    ("allowed AND sensitive_service IS NOT NULL", {
        "incident_id": "'INX-' || eff_dst || '-' || " + _BUCKET.format(seconds=600).replace("{{", "{").replace("}}", "}"),
        "rule": "'dnat_sensitive_service_exposure'", "family": "'firewall_exposure'", "severity": "'high'", "entity": "eff_dst",
    }),
    ("blocked", {
        "incident_id": "'INS-' || src_ip || '-' || " + _BUCKET.format(seconds=200).replace("{{", "{").replace("}}", "}"),
        "rule": "'multi_service_sweep'", "family": "'service_probing'", "severity": "'medium'", "entity": "src_ip",
    }),
)
#: A mapping with several sources of one network that share a source port for less than a minute.
NEAR_COLUMNS = COLUMNS | {"src_ip": "'45.83.' || CAST(CAST(floor(no / 400) AS BIGINT) % 256 AS {string}) || '.' || CAST(user_id % 5 + 1 AS {string})", "tcp_flags": "'SYN'", "inbound_zone": "'wan1-zone'"}
_HEAD = ("incident_id", "rule", "family", "severity", "entity")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda columns: F.struct(*[F.expr(sql.replace("{string}", "STRING")).alias(name) for name, sql in columns.items()])
    each = F.explode(F.array_compact(F.array(*[F.when(F.expr(when), of(columns)) for when, columns in MEMBERSHIPS])))
    return featured_events(spark, sf_dir).withColumn("_i", each).select("_i.*", *[c for c in featured_events(spark, sf_dir).columns])


def incidents(rows: DataFrame) -> DataFrame:
    n = F.count("*")
    return rows.groupBy(*_HEAD).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), (0.5 + (n % 40).cast("double") / 100).alias("confidence"))


def _facts_sql() -> str:
    each = " UNION ALL ".join(f"SELECT {', '.join(f'{sql} AS {name}' for name, sql in columns.items())}, * FROM featured WHERE {when}" for when, columns in MEMBERSHIPS).replace("{string}", "VARCHAR")
    head = ", ".join(_HEAD)
    return f"WITH RECURSIVE featured AS MATERIALIZED (SELECT * FROM {FEATURED}), facts AS MATERIALIZED ({each}), incidents AS MATERIALIZED (SELECT {head}, min(ts_us) AS first_us, max(ts_us) AS last_us, 0.5::DOUBLE + CAST(count(*) % 40 AS DOUBLE) / 100 AS confidence FROM facts GROUP BY {head})"


FACTS = _facts_sql()
_RECON = "family IN ('network_scanning', 'service_probing')"
_QUIET = f"SELECT incident_id FROM facts WHERE {_RECON} GROUP BY incident_id HAVING bool_and(blocked)"
_LIST = "array_to_string(list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL)), ',')"


@register("recon_groups", f"""{FACTS}, own AS (SELECT *, regexp_replace(src_ip, '[.][0-9]+$', '.0/24') AS cidr FROM facts WHERE incident_id IN ({_QUIET}) AND src_v4 IS NOT NULL),
part AS (SELECT incident_id, family, cidr, min(ts_us) AS a, max(ts_us) AS z, CASE WHEN count(service) > 0 THEN 'services:' || {_LIST.format(x='service')} WHEN count(DISTINCT dst_port) <= 5 THEN 'ports:' || {_LIST.format(x='dst_port')} ELSE 'ports:varied' END AS scope FROM own GROUP BY incident_id, family, cidr),
o AS (SELECT *, max(z) OVER (PARTITION BY cidr, family, scope ORDER BY a, incident_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM part),
i AS (SELECT *, sum(CASE WHEN a > until + 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY cidr, family, scope ORDER BY a, incident_id) AS island FROM o)
SELECT cidr, family, scope, count(DISTINCT src_ip) AS n_sources, count(DISTINCT event_id) AS n_events, count(DISTINCT dst_ip) AS n_targets, {_LIST.format(x='dst_port')} AS ports, min(ts_us) AS first_us, max(ts_us) AS last_us,
array_to_string(list_sort(list(DISTINCT src_ip))[1:5], ',') AS sources FROM own JOIN i USING (incident_id, family, cidr) GROUP BY cidr, family, scope, island""")
def recon_groups(spark, sf_dir):
    """Groups of wholly blocked reconnaissance incidents."""
    return rollups.recon_groups(scratch.stored(facts(spark, sf_dir), "facts"))


@register("source_port_clusters", f"""WITH RECURSIVE f AS MATERIALIZED (SELECT regexp_replace(entity, '[.][0-9]+$', '.0/24') AS cidr, entity AS src_ip, CAST(split_part(corr, '|', 2) AS INT) AS src_port, n, first_us, last_us FROM ({rules.rule_sql(rules.BY_NAME['fixed_source_port_scan'], features_sql(canonical_sql(NEAR_COLUMNS)))})),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cidr, src_port ORDER BY first_us, src_ip) AS r FROM f),
s AS (SELECT *, 0 AS run, first_us AS a, last_us AS z FROM o WHERE r = 1 UNION ALL
SELECT o.*, CASE WHEN greatest(s.z, o.last_us) - s.a <= 60000000 THEN s.run ELSE s.run + 1 END, CASE WHEN greatest(s.z, o.last_us) - s.a <= 60000000 THEN s.a ELSE o.first_us END, CASE WHEN greatest(s.z, o.last_us) - s.a <= 60000000 THEN greatest(s.z, o.last_us) ELSE o.last_us END FROM s JOIN o ON o.cidr = s.cidr AND o.src_port = s.src_port AND o.r = s.r + 1)
SELECT cidr, src_port, count(*) AS n_sources, CAST(sum(n) AS BIGINT) AS n_events, min(first_us) AS first_us, max(last_us) AS last_us, array_to_string(list_sort(list(src_ip)), ',') AS sources FROM s GROUP BY cidr, src_port, run HAVING count(*) >= 2 AND sum(n) >= 7""")
def source_port_clusters(spark, sf_dir):
    """Bursts of sources of one network with one fixed source port."""
    found = rules.evaluate(featured_events(spark, sf_dir, NEAR_COLUMNS), rules.BY_NAME["fixed_source_port_scan"])
    found = found.select(F.col("entity").alias("src_ip"), F.lit(0).alias("src_v4"), F.split_part("corr", F.lit("|"), F.lit(2)).cast("int").alias("src_port"), "n", "first_us", "last_us")
    return rollups.source_port_clusters(found)


_NAT = "(coalesce(trim(translated_dst_ip), '') <> '' OR translated_dst_port IS NOT NULL)"


@register("exposed_assets_of_incidents", f"""{FACTS}, seen AS (SELECT DISTINCT event_id, eff_dst, sensitive_service AS service, eff_port, dst_ip, {_NAT} AS nat, CASE WHEN src_public THEN src_ip END AS source, coalesce(nullif(translated_dst_ip, ''), eff_dst) AS address FROM facts WHERE family IN ('firewall_exposure', 'firewall_policy') AND allowed AND external AND sensitive_service IS NOT NULL AND coalesce(eff_dst, '') <> '')
SELECT eff_dst, service, count(*) AS n, count(DISTINCT source) AS n_sources, {_LIST.format(x='eff_port')} AS ports, bool_or(nat) AS nat_observed, max_by(address, event_id) FILTER (WHERE nat) AS internal_address, array_to_string(list_sort(list(event_id))[1:50], ',') AS evidence,
nullif(array_to_string(coalesce(list_sort(list(DISTINCT dst_ip) FILTER (WHERE nat AND coalesce(dst_ip, '') <> '')), [])[1:5], ','), '') AS public_destinations FROM seen GROUP BY eff_dst, service""")
def exposed_assets_of_incidents(spark, sf_dir):
    """Inventory of what exposure incidents show."""
    return rollups.exposed_assets(scratch.stored(facts(spark, sf_dir), "facts"))


_ITEMS = f"""left_over AS (SELECT * FROM incidents WHERE incident_id NOT IN ({_QUIET})), items AS (
(SELECT 'act_now' AS section, incident_id, severity, confidence, first_us FROM left_over WHERE severity IN ('critical', 'high') ORDER BY severity <> 'critical', confidence DESC, first_us, incident_id LIMIT 5) UNION ALL
(SELECT 'investigate', incident_id, severity, confidence, first_us FROM left_over WHERE severity = 'medium' ORDER BY confidence DESC, first_us, incident_id LIMIT 5))"""


@register("action_items", f"{FACTS}, {_ITEMS} SELECT * FROM items")
def action_items(spark, sf_dir):
    """The most urgent incidents, five for each section."""
    rows = scratch.stored(facts(spark, sf_dir), "facts")
    return rollups.action_items(incidents(rows), rows)


@register("funnel", f"{FACTS}, {_ITEMS} SELECT count(DISTINCT event_id) AS total_events, count(*) FILTER (WHERE blocked) AS blocked_events, count(DISTINCT event_id) FILTER (WHERE allowed AND external AND sensitive_service IS NOT NULL) AS policy_exposures, (SELECT count(*) FROM items) AS action_items FROM featured")
def funnel(spark, sf_dir):
    rows = scratch.stored(facts(spark, sf_dir), "facts")
    return rollups.funnel(featured_events(spark, sf_dir), rollups.action_items(incidents(rows), rows))


def _named(port: str) -> str:
    return f"CASE {' '.join(f'WHEN {port} IN ({chr(44).join(map(str, ports))}) THEN {chr(39)}{name}{chr(39)}' for name, ports in SERVICES.items())} END"


#: The ends of an event, and whether two are related, spelled out: this mapping has no unknown protocol and no translated port.
_ENDS = f"src_ip AS s, dst_ip AS d, translated_dst_ip AS t, src_port AS sp, dst_port AS dp, {_named('src_port')} AS ss, {_named('dst_port')} AS ds"
_FORWARD, _REVERSE = "(a.s = c.s AND (a.d = c.d OR a.d = c.t OR a.t = c.d OR a.t = c.t))", "(a.s IN (c.d, c.t) AND c.s IN (a.d, a.t))"
_RELATED = f"""(coalesce({_FORWARD}, false) OR coalesce({_REVERSE}, false)) AND (coalesce(a.sp = c.sp AND a.dp = c.dp, false) OR coalesce(a.sp = c.dp AND a.dp = c.sp, false)
OR coalesce(a.ss = c.ss, false) OR coalesce(a.ss = c.ds, false) OR coalesce(a.ds = c.ss, false) OR coalesce(a.ds = c.ds, false)
OR (coalesce({_REVERSE}, false) AND (coalesce(a.dp = c.sp AND (a.dp < 1024 OR a.ds IS NOT NULL), false) OR coalesce(a.sp = c.dp AND (a.sp < 1024 OR a.ss IS NOT NULL), false))) OR (a.sp IS NULL AND a.dp IS NULL AND c.sp IS NULL AND c.dp IS NULL))"""
_CONTEXT = f"""extent AS (SELECT incident_id, min(ts_us) - 300000000 AS x, max(ts_us) + 300000000 AS z FROM facts GROUP BY incident_id), ends AS (SELECT DISTINCT incident_id, {_ENDS} FROM facts), asked AS (SELECT * FROM ends JOIN extent USING (incident_id)),
told AS (SELECT event_id, ts_us, {_ENDS} FROM featured WHERE allowed), related AS (SELECT DISTINCT a.incident_id, c.event_id, c.ts_us FROM asked a JOIN told c ON c.ts_us BETWEEN a.x AND a.z AND {_RELATED}),
context AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts_us, event_id) AS place FROM related ANTI JOIN facts USING (incident_id, event_id) QUALIFY place <= 50)"""


def _context(spark, sf_dir, rows):
    return relations.context(rows, featured_events(spark, sf_dir).where("allowed"))


@register("incident_context", f"{FACTS}, {_CONTEXT} SELECT incident_id, event_id, ts_us, place FROM context")
def incident_context(spark, sf_dir):
    """Allowed events that are related to an incident's, the first fifty."""
    return scratch.stored(_context(spark, sf_dir, scratch.stored(facts(spark, sf_dir), "facts")).withColumn("place", F.col("place").cast("long")), "context")


_HIGH = "(" + ", ".join(f"'{x}'" for x in routing.HIGH_VALUE) + ")"
_ROUTES = f"""{_CONTEXT}, replies AS (SELECT incident_id, {_ENDS} FROM facts WHERE family = 'network_anomaly' AND spi AND (has_ack OR has_rst OR has_fin) AND NOT has_syn),
lost AS (SELECT DISTINCT a.incident_id FROM replies a JOIN (SELECT incident_id, {_ENDS} FROM context JOIN featured USING (event_id) WHERE allowed) c ON a.incident_id = c.incident_id AND {_RELATED}),
seen AS (SELECT incident_id, min(rule) FILTER (WHERE rule IN {_HIGH}) AS high, bool_or(allowed) AS ok, bool_and(blocked) AS quiet FROM facts GROUP BY incident_id),
routes AS (SELECT i.incident_id, CASE WHEN high IS NOT NULL OR ok THEN 'individual_triage' WHEN i.incident_id IN (SELECT incident_id FROM lost) THEN 'store_only' WHEN NOT quiet THEN 'individual_triage' WHEN family = 'network_scanning' AND severity = 'low' THEN 'digest' ELSE 'deterministic_report' END AS route,
CASE WHEN high IS NOT NULL THEN 'high_value_rule:' || high WHEN ok THEN 'allowed_connection_observed' WHEN i.incident_id IN (SELECT incident_id FROM lost) THEN 'verified_spi_state_desynchronization' WHEN NOT quiet THEN 'not_fully_blocked_conservative' WHEN family = 'network_scanning' AND severity = 'low' THEN 'low_severity_fully_blocked_scanner' ELSE 'fully_blocked_reconnaissance' END AS reason FROM incidents i JOIN seen USING (incident_id))"""


def _routes(spark, sf_dir, rows):
    found = incidents(rows)
    context = _context(spark, sf_dir, rows).select("incident_id", "event_id").join(featured_events(spark, sf_dir), "event_id")
    return routing.routes(found, found.select("incident_id", "rule"), rows, context)


@register("incident_routes", f"{FACTS}, {_ROUTES} SELECT * FROM routes")
def incident_routes(spark, sf_dir):
    """Each incident's route and its reason."""
    return scratch.stored(_routes(spark, sf_dir, scratch.stored(facts(spark, sf_dir), "facts")), "routes")


@register("evidence_strength", f"""{FACTS}, e AS (SELECT incident_id, event_id, {_ENDS} FROM facts), back AS (SELECT DISTINCT a.incident_id FROM e a JOIN e c ON a.incident_id = c.incident_id AND a.event_id < c.event_id AND {_RELATED})
SELECT incident_id, CASE WHEN bool_or(has_syn AND (has_ack OR has_rst OR has_fin)) OR incident_id IN (SELECT incident_id FROM back) THEN 'bidirectional_transport' WHEN bool_or(tcp_flags LIKE '%PSH%' OR tcp_flags LIKE '%URG%') THEN 'payload_bearing_unidirectional' WHEN count(*) > 1 THEN 'multi_packet_unidirectional' WHEN min(tcp_flags) = 'SYN' THEN 'syn_only' ELSE 'single_packet_non_syn' END AS strength FROM facts GROUP BY incident_id""")
def evidence_strength(spark, sf_dir):
    rows = scratch.stored(facts(spark, sf_dir), "facts")
    return routing.evidence(incidents(rows), rows)


@register("attack_context", f"""{FACTS}, x AS (SELECT incident_id, family IN ('network_scanning', 'service_probing', 'lateral_movement_candidate') OR count(DISTINCT dst_port) >= 3 OR count(DISTINCT dst_ip) >= 3 AS broad, coalesce(min(eff_service) IN ('ssh', 'rdp', 'telnet', 'vpn'), false) AS remote FROM facts GROUP BY incident_id, family)
SELECT incident_id, CASE WHEN broad THEN 'T1046' WHEN remote THEN 'T1133' END AS technique, CASE WHEN broad THEN 'TA0007' WHEN remote THEN 'TA0001' END AS tactic, CASE WHEN broad THEN 'behavioral' WHEN remote THEN 'context' ELSE 'unsupported' END AS kind FROM x""")
def attack_context(spark, sf_dir):
    return routing.attack_context(facts(spark, sf_dir))


_TEXT = "array_to_string(list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL))[1:{n}], ', ')"


@register("incident_reports", f"""{FACTS}, x AS (SELECT incident_id, rule, family, entity, count(*) AS n, count(*) FILTER (WHERE blocked) AS b, count(DISTINCT dst_ip) AS t, count(DISTINCT dst_port) AS p, {_TEXT.format(x='dst_ip', n=10)} AS targets, {_TEXT.format(x='dst_port', n=15)} AS ports, {_TEXT.format(x='service', n=100)} AS services FROM facts GROUP BY incident_id, rule, family, entity)
SELECT incident_id, 'activity: ' || rule || ' (' || family || ')' || chr(10) || 'source: ' || entity || chr(10) || 'events: ' || n || ' total, ' || b || ' blocked' || chr(10) || 'distinct targets: ' || t || ' (' || targets || CASE WHEN t > 10 THEN ', ...' ELSE '' END || ')' || chr(10) || 'ports: ' || ports || CASE WHEN p > 15 THEN ', ...' ELSE '' END || chr(10) || 'services: ' || coalesce(nullif(services, ''), 'none classified') || chr(10) ||
CASE WHEN n = b THEN 'All ' || n || ' observed events' ELSE b || ' of ' || n || ' observed events' END || ' were blocked by the firewall.' AS report FROM x""")
def incident_reports(spark, sf_dir):
    rows = scratch.stored(facts(spark, sf_dir), "facts")
    return routing.reports(incidents(rows), rows)


@register("incident_digests", f"""{FACTS}, {_ROUTES}, own AS (SELECT * FROM incidents WHERE incident_id IN (SELECT incident_id FROM routes WHERE route = 'digest')), told_of AS (SELECT * FROM facts WHERE incident_id IN (SELECT incident_id FROM own)),
p AS (SELECT rule, dst_port, row_number() OVER (PARTITION BY rule ORDER BY count(*) DESC, dst_port) AS r FROM told_of GROUP BY rule, dst_port), q AS (SELECT rule, array_to_string(list(dst_port ORDER BY r), ',') AS ports FROM p WHERE r <= 10 GROUP BY rule),
h AS (SELECT rule, count(*) AS n_incidents, count(DISTINCT entity) AS n_sources, min(first_us) AS first_us, max(last_us) AS last_us, array_to_string(list_sort(list(DISTINCT entity))[1:20], ',') AS sources FROM own GROUP BY rule), e AS (SELECT rule, count(*) FILTER (WHERE blocked) AS n_blocked, count(DISTINCT dst_ip) AS n_targets FROM told_of GROUP BY rule)
SELECT rule, n_incidents, n_sources, first_us, last_us, n_blocked, n_targets, sources, ports FROM h JOIN e USING (rule) JOIN q USING (rule)""")
def incident_digests(spark, sf_dir):
    rows = scratch.stored(facts(spark, sf_dir), "facts")
    return scratch.stored(routing.digests(incidents(rows), rows, scratch.stored(_routes(spark, sf_dir, rows), "routes")), "digests")


@register("search_incidents_page", f"""{FACTS}, page AS (SELECT * FROM incidents WHERE severity IN ('high', 'low') AND family = 'service_probing' AND confidence BETWEEN 0.5 AND 0.85 AND first_us >= 100000000 AND starts_with(incident_id, 'INC-') AND incident_id IN (SELECT incident_id FROM facts WHERE spi)
AND (confidence < 0.8 OR (confidence = 0.8 AND incident_id > 'INC-2') OR confidence IS NULL) ORDER BY confidence DESC NULLS LAST, incident_id LIMIT 26)
SELECT incident_id, family, severity, confidence, first_us, last_us, (SELECT count(*) FROM facts f WHERE f.incident_id = page.incident_id) AS event_count FROM page""")
def search_incidents_page(spark, sf_dir):
    """A page of incidents by lists, equality, ranges, prefix and existence, with counts of events."""
    rows = scratch.stored(facts(spark, sf_dir), "facts")
    criteria = search.Criteria(
        among={"severity": ("high", "low")}, equal={"family": "service_probing"}, between={"confidence": (0.5, 0.85), "first_us": (100_000_000, None)}, prefix={"incident_id": "INC-"},
        linked=((rows.where("spi"), "incident_id", True),), sort="confidence", size=25, after=(0.8, "INC-2"),
    )
    return search.search(incidents(rows), criteria, "incident_id", {"event_count": (rows, "incident_id")}).select("incident_id", "family", "severity", "confidence", "first_us", "last_us", "event_count")


@register("search_events_page", f"""{FACTS} SELECT event_id, ts_us, src_ip, dst_ip, dst_port, action FROM featured WHERE protocol = 'TCP' AND dst_port = 22 AND action = 'block' AND ts_us BETWEEN 5000000 AND 900000000 AND event_id IN (SELECT event_id FROM facts WHERE family = 'network_scanning') ORDER BY ts_us, event_id LIMIT 101""")
def search_events_page(spark, sf_dir):
    """A page of events by equalities, time and membership in incidents."""
    rows = facts(spark, sf_dir).where("family = 'network_scanning'")
    criteria = search.Criteria(equal={"protocol": "TCP", "dst_port": 22, "action": "block"}, between={"ts_us": (5_000_000, 900_000_000)}, linked=((rows, "event_id", True),), sort="ts_us", descending=False, size=100)
    return search.search(featured_events(spark, sf_dir), criteria, "event_id").select("event_id", "ts_us", "src_ip", "dst_ip", "dst_port", "action")


_SCAN = rules.BY_NAME["low_and_slow_horizontal_scan"]


@register("search_signals_page", f"SELECT entity, event_id, severity, confidence, first_us, last_us FROM ({rules.rule_sql(_SCAN, FEATURED)}) WHERE severity IN ('medium', 'high') AND confidence BETWEEN 0.7 AND 0.9 AND last_us <= 950000000 ORDER BY CASE severity WHEN 'high' THEN 4 WHEN 'medium' THEN 3 END DESC, corr || event_id LIMIT 51")
def search_signals_page(spark, sf_dir):
    """A page of one rule's signals in order of severity."""
    found = rules.evaluate(featured_events(spark, sf_dir), _SCAN).withColumn("signal_id", F.concat("corr", "event_id"))
    criteria = search.Criteria(among={"severity": ("medium", "high")}, between={"confidence": (0.7, 0.9), "last_us": (None, 950_000_000)}, sort="severity")
    return search.search(found, criteria, "signal_id").select("entity", "event_id", "severity", "confidence", "first_us", "last_us")


@register("search_jobs_page", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT (coalesce(o_orderstatus = 'P', false) OR coalesce(o_totalprice > 300000, false)) AND o_totalprice >= 1000 ORDER BY o_totalprice, o_orderkey LIMIT 201")
def search_jobs_page(spark, sf_dir):
    """A page of jobs (orders stand for them) that neither of two conditions calls cancelled."""
    criteria = search.Criteria(equal={"o_orderpriority": "1-URGENT"}, between={"o_totalprice": (1000, None)}, either=(("o_orderstatus = 'P'", "o_totalprice > 300000"), False), sort="o_totalprice", descending=False, size=200)
    return search.search(spark.read.parquet(f"{sf_dir}/orders.parquet"), criteria, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


_LATE_COLUMNS = COLUMNS | {
    "src_port": "CAST(CASE WHEN user_id % 3 = 0 THEN 443 ELSE 40000 + k END AS INT)", "dst_port": "CAST(CASE WHEN user_id % 2 = 0 THEN 32768 + no % 20000 ELSE 80 END AS INT)", "dst_ip": "'10.1.' || CAST(user_id % 3 AS {string}) || '.7'",
    "tcp_flags": "CASE WHEN user_id % 5 = 0 THEN 'SYN' WHEN no % 2 = 0 THEN 'RST' ELSE 'RST,ACK' END", "action": "'block'", "action_reason": "CASE WHEN user_id % 7 < 6 THEN 'blocked by spi' END",
    "src_ip": "'45.83.64.' || CAST(user_id % 210 AS {string})",
}
_POLICY = suppression.Policy(rules=("telnet_probe",), sources=("45.83.64.8/30", "0.0.0.0/0"), destinations=("10.1.1.0/24",), pairs=(("45.83.64.32/27", "10.1.0.0/16"),))


@register("suppressed_signals", f"""WITH e AS MATERIALIZED (SELECT *, 'SIG-' || src_ip AS signal_id, CASE WHEN CAST(split_part(src_ip, '.', 4) AS INT) % 11 = 0 THEN 'telnet_probe' ELSE 'spi_anomaly_burst' END AS rule, CAST(split_part(src_ip, '.', 4) AS INT) AS h FROM {features_sql(canonical_sql(_LATE_COLUMNS))}),
s AS (SELECT signal_id, rule, src_ip, h, min(dst_ip) FILTER (WHERE dst_ip LIKE '10.1.1.%') AS d, min(dst_ip) AS t, bool_and(blocked AND coalesce(action_reason = 'blocked by spi', false) AND src_port = 443 AND dst_port >= 32768 AND tcp_flags IN ('RST', 'RST,ACK')) AND count(*) >= 2 AND count(DISTINCT dst_port) = count(*) AND count(DISTINCT dst_ip) = 1 AND rule = 'spi_anomaly_burst' AS late FROM e GROUP BY signal_id, rule, src_ip, h)
SELECT * FROM (SELECT signal_id, CASE WHEN late THEN 'late_rst_from_established_service' WHEN rule = 'telnet_probe' THEN 'rule telnet_probe is allowed' WHEN h BETWEEN 8 AND 11 THEN 'source ' || src_ip || ' is allowed' WHEN h BETWEEN 32 AND 63 AND (d IS NULL OR t < d) THEN 'pair ' || src_ip || ' -> ' || t || ' is allowed' WHEN d IS NOT NULL THEN 'destination ' || d || ' is allowed' END AS reason FROM s) WHERE reason IS NOT NULL""")
def suppressed_signals(spark, sf_dir):
    """Suppressed signals and their reasons; here a signal is all of a source's events."""
    rows = scratch.stored(featured_events(spark, sf_dir, _LATE_COLUMNS).withColumn("signal_id", F.concat(F.lit("SIG-"), "src_ip")).withColumn("tgt", F.col("dst_ip")), "late")
    last = F.split_part("src_ip", F.lit("."), F.lit(4)).cast("int")
    found = rows.select("signal_id", F.when(last % 11 == 0, "telnet_probe").otherwise("spi_anomaly_burst").alias("rule"), F.col("src_ip").alias("entity")).distinct()
    return suppression.reasons(found, rows, _POLICY)
