"""Queries over sessions, campaigns of several jobs, streams and the life of stored rows, on fixed mappings of the events, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.features import features_sql
from ..operators import bundles, campaigns, lifecycle, scratch, sessions
from ..streaming import campaigns as streams
from .lowering import COLUMNS, canonical_events, canonical_sql, featured_events
from .queries import FEATURED, register


@register("first_port_sweep", f"""WITH b AS MATERIALIZED (SELECT event_id, src_ip, dst_port, ts_us FROM {FEATURED} WHERE blocked_legacy),
w AS (SELECT src_ip, ts_us, count(DISTINCT dst_port) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND 300000000 FOLLOWING) AS ports FROM b), f AS (SELECT src_ip, min(ts_us) AS start_us FROM w WHERE ports >= 3 GROUP BY src_ip)
SELECT src_ip, start_us, event_id FROM b JOIN f USING (src_ip) WHERE ts_us BETWEEN start_us AND start_us + 300000000""")
def first_port_sweep(spark, sf_dir):
    """Blocked events of each source's first five minutes with three ports."""
    return sessions.first_port_sweep(featured_events(spark, sf_dir))


_RANGE = "OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND 60000000 FOLLOWING)"
_EARLIER = "OVER (PARTITION BY src_ip, dst_ip, ts_us ORDER BY event_no)"


@register("first_flood", f"""WITH e AS (SELECT src_ip, dst_ip, ts_us, event_no, CASE WHEN blocked_legacy THEN 1 ELSE 0 END AS b FROM {FEATURED}),
w AS (SELECT *, count(*) {_RANGE} - row_number() {_EARLIER} + 1 AS n, sum(b) {_RANGE} - sum(b) {_EARLIER} + b AS nb FROM e)
SELECT src_ip, dst_ip, ts_us AS start_us, n, CAST(nb AS BIGINT) AS n_blocked FROM w WHERE n >= 100 AND nb / n > 0.8 QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, event_no) = 1""")
def first_flood(spark, sf_dir):
    """First minute of each pair with a hundred events, most of them blocked."""
    return sessions.first_flood(featured_events(spark, sf_dir))


_WEB_COLUMNS = COLUMNS | {
    "batch": "CAST(floor(no / 100) AS BIGINT)",
    "kind": "CASE WHEN CAST(floor(no / 100) AS BIGINT) % 3 = 0 AND no % 50 = 7 THEN 'SSH' WHEN no % 9 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'HTTP_GET' ELSE 'HTTP_POST' END END",
    "message": "CASE k % 9 WHEN 0 THEN 'GET /index.html HTTP/1.1 200 OK' WHEN 1 THEN 'GET /home HTTP/1.1 404 and 200 ok' WHEN 2 THEN 'GET /dashboard HTTP/1.1 200 OK' WHEN 3 THEN 'GET /images/a.png HTTP/1.0 206' "
    "WHEN 4 THEN 'GET /home?q=1 or 1=1 HTTP/1.1 200 OK' WHEN 5 THEN 'GET /api/profile 200 ok <script>' WHEN 6 THEN CASE WHEN k % 5 = 0 THEN 'POST /login HTTP/1.1 User=Admin 200 OK' END WHEN 7 THEN 'GET /dashboard HTTP/1.1 500' ELSE 'GET /other HTTP/1.1 200 OK' END",
}
_WEB = features_sql(canonical_sql(_WEB_COLUMNS))


def _matches(patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches(message, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


@register("benign_web", f"""WITH e AS MATERIALIZED (SELECT event_id, batch, kind, message FROM {_WEB}) SELECT event_id, batch FROM e WHERE kind IN ('HTTP_GET', 'HTTP_POST')
AND (message ILIKE '%200 ok%' OR regexp_matches(message, 'HTTP/1.[01] 20[0-9]')) AND NOT regexp_matches(message, 'HTTP/1.[01] (401|403|500|404)') AND NOT {_matches((*sessions.ATTACKS, sessions.SCRIPT_LINK))} AND {_matches(sessions.BENIGN_ENDPOINTS)}
AND batch NOT IN (SELECT batch FROM e WHERE kind NOT IN ('HTTP_GET', 'HTTP_POST'))""")
def benign_web(spark, sf_dir):
    """Ordinary web requests of batches that hold only web requests."""
    return sessions.benign_web(canonical_events(spark, sf_dir, _WEB_COLUMNS), "batch", "kind").select("event_id", "batch")


@register("admin_logins", f"""WITH e AS MATERIALIZED (SELECT event_id, src_ip, ts_us, CASE WHEN message ILIKE '%post /login%' AND message ILIKE '%user=admin%' THEN 'login' WHEN message ILIKE '%get /dashboard%' THEN 'view' END AS kind
FROM {_WEB} WHERE src_private AND message ILIKE '%200 ok%' AND NOT {_matches(sessions.ATTACKS)}), p AS (SELECT l.event_id AS a, v.event_id AS b, l.src_ip FROM e l JOIN e v ON l.src_ip = v.src_ip AND l.kind = 'login' AND v.kind = 'view' AND v.ts_us BETWEEN l.ts_us AND l.ts_us + 600000000)
SELECT DISTINCT a AS event_id, src_ip, 'login' AS kind FROM p UNION ALL SELECT DISTINCT b, src_ip, 'view' FROM p""")
def admin_logins(spark, sf_dir):
    """Administrators' logins and the views of the dashboard within ten minutes of them."""
    return sessions.admin_logins(featured_events(spark, sf_dir, _WEB_COLUMNS), F.col("src_private"))


@register("search_text", f"SELECT event_id, place, truncated FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place, count(*) OVER () > 10 AS truncated FROM {canonical_sql(_WEB_COLUMNS)} WHERE message ILIKE '%images/a%' OR src_ip ILIKE '%images/a%') WHERE place <= 10")
def search_text(spark, sf_dir):
    """The first ten events whose message or source holds a text."""
    return sessions.search_text(canonical_events(spark, sf_dir, _WEB_COLUMNS), "Images/A", ["message", "src_ip"], "event_id").select("event_id", "place", "truncated")


WINDOW_US, TTL_US = 60_000_000, 700_000_000


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of jobs, that come in another order than their events: a source and port of 25 seconds each."""
    job = (F.floor(F.col("event_no") / 250) * 7 % 40).cast("long")
    key = F.concat_ws("|", "src_ip", F.col("dst_port").cast("string"))
    rows = featured_events(spark, sf_dir).groupBy(key.alias("key"), job.alias("job")).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n"))
    more = {"arrival_id": F.concat_ws("-", "key", F.col("job").cast("string")), "version": F.when(F.col("job") >= 30, "v2").otherwise("v1"), "now_us": F.col("job") * 100_000_000, "alive": F.col("job") % 13 != 5}
    return rows.withColumns(more)


_ARRIVALS = f"arrivals AS MATERIALIZED (SELECT src_ip || '|' || CAST(dst_port AS VARCHAR) AS key, CAST(floor(event_no / 250) AS BIGINT) * 7 % 40 AS job, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n FROM {FEATURED} GROUP BY 1, 2)"
_CAMPAIGNS = f"""WITH RECURSIVE {_ARRIVALS}, o AS MATERIALIZED (SELECT *, CASE WHEN job >= 30 THEN 'v2' ELSE 'v1' END AS version, job * 100000000 AS now_us, row_number() OVER (PARTITION BY key ORDER BY job) AS r FROM arrivals),
s AS (SELECT key, job, r, 'first' AS decision, CAST(1 AS BIGINT) AS generation, first_us AS a, last_us AS z, version AS v, now_us + {TTL_US} AS e FROM o WHERE r = 1
UNION ALL SELECT key, job, r, d, CASE WHEN d IN ('stale', 'merge') THEN generation ELSE generation + 1 END, CASE d WHEN 'stale' THEN a WHEN 'merge' THEN least(a, first_us) ELSE first_us END, CASE d WHEN 'stale' THEN z WHEN 'merge' THEN greatest(z, last_us) ELSE last_us END,
CASE WHEN d IN ('stale', 'merge') THEN v ELSE version END, CASE WHEN d = 'stale' THEN e ELSE now_us + {TTL_US} END
FROM (SELECT o.key, o.job, o.r, o.first_us, o.last_us, o.version, o.now_us, s.generation, s.a, s.z, s.v, s.e, CASE WHEN o.job % 13 = 5 THEN 'repair' WHEN o.version <> s.v OR s.e <= o.now_us OR o.first_us > s.z + {WINDOW_US} THEN 'new_generation' WHEN o.last_us < s.a - {WINDOW_US} THEN 'stale' ELSE 'merge' END AS d
FROM s JOIN o ON o.key = s.key AND o.r = s.r + 1))"""
_DECISIONS = f"{_CAMPAIGNS} SELECT key, job, key || '-' || CAST(job AS VARCHAR) AS arrival_id, decision, generation, a AS campaign_first_us, z AS campaign_last_us FROM s"


@register("campaign_decisions", _DECISIONS)
def campaign_decisions(spark, sf_dir):
    """How each job's incident meets the state of its campaign."""
    return campaigns.replay(arrivals(spark, sf_dir), WINDOW_US, TTL_US)


@register("stream_campaign_decisions", _DECISIONS)
def stream_campaign_decisions(spark, sf_dir):
    """The same by a stateful stream."""
    rows = arrivals(spark, sf_dir)
    stream = spark.readStream.schema(rows.schema).parquet(scratch.written(rows, "arrivals"))
    return streams.run_available(streams.decisions(stream, WINDOW_US, TTL_US), "campaigns")


def bundle_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those incidents with what a bundle keeps: four events as evidence, a type by port, and whether all members' signals are present."""
    rows = featured_events(spark, sf_dir).withColumns({"job": (F.floor(F.col("event_no") / 250) * 7 % 40).cast("long"), "key": F.concat_ws("|", "src_ip", F.col("dst_port").cast("string"))})
    few = rows.select("key", "job", "event_id", "action").withColumn("_r", F.row_number().over(W.partitionBy("key", "job").orderBy("event_id"))).where("_r <= 4").groupBy("key", "job").agg(F.array_sort(F.collect_list("event_id")).alias("evidence"))
    own = arrivals(spark, sf_dir).withColumnRenamed("n", "n_events").join(few, ["key", "job"])
    place = F.col("job") * 3 % 7
    return own.withColumns({
        "now_us": F.col("now_us") + 1_000_000, "place": place, "type": F.concat(F.lit("t"), place.cast("string")), "family": F.concat(F.lit("f"), (place % 2).cast("string")), "entity": F.col("key"), "severity": F.element_at(F.array(*[F.lit(x) for x in bundles.SEVERITY]), (F.col("job") % 5 + 1).cast("int")),
        "confidence": (F.col("job") % 4).cast("double") / 4, "n_signals": F.col("job") % 3, "complete": F.col("job") % 3 != 1,
    })


_FORGET_US = 400_000_000
_RANK = "(list_position(['informational', 'low', 'medium', 'high', 'critical'], {x}) - 1)"
_EVIDENCE = "list_sort(list_concat(list_distinct([{a}[1], {b}[1]]), list_filter(list_sort(list_distinct(list_concat({a}, {b}))), lambda x: x NOT IN ({a}[1], {b}[1]))[1:10 - len(list_distinct([{a}[1], {b}[1]]))]))"
_BUNDLES = f"""WITH RECURSIVE fe AS MATERIALIZED (SELECT src_ip || '|' || CAST(dst_port AS VARCHAR) AS key, CAST(floor(event_no / 250) AS BIGINT) * 7 % 40 AS job, * FROM {FEATURED}),
b AS MATERIALIZED (SELECT key, job, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n, list(event_id ORDER BY event_id)[1:4] AS ev, CASE WHEN job >= 30 THEN 'v2' ELSE 'v1' END AS version, job * 100000000 + 1000000 AS now_us, job * 3 % 7 AS place,
  (['informational', 'low', 'medium', 'high', 'critical'])[job % 5 + 1] AS sev, (job % 4) / 4.0 AS conf, job % 3 AS sig, job % 3 <> 1 AS complete, row_number() OVER (PARTITION BY key ORDER BY job) AS r FROM fe GROUP BY key, job),
s AS (SELECT key, job, r, 'first' AS d, CAST(1 AS BIGINT) AS g, first_us AS a, last_us AS z, version AS v, now_us + {TTL_US} AS e, place, sev, CAST(conf AS DOUBLE) AS conf, n, CAST(sig AS BIGINT) AS sig, ev, false AS promoted, '' AS changes FROM b WHERE r = 1
UNION ALL SELECT key, job, r, d, CASE d WHEN 'first' THEN 1 WHEN 'stale' THEN g WHEN 'merge' THEN g ELSE g + 1 END, CASE d WHEN 'stale' THEN a WHEN 'merge' THEN least(a, fu) ELSE fu END, CASE d WHEN 'stale' THEN z WHEN 'merge' THEN greatest(z, lu) ELSE lu END, CASE WHEN d IN ('stale', 'merge') THEN v ELSE version END,
  CASE WHEN d = 'stale' THEN e ELSE now_us + {TTL_US} END, CASE d WHEN 'stale' THEN place WHEN 'merge' THEN CASE WHEN complete AND p2 < place THEN p2 ELSE place END ELSE p2 END,
  CASE d WHEN 'stale' THEN sev WHEN 'merge' THEN CASE WHEN up THEN sev2 ELSE sev END ELSE sev2 END, CASE d WHEN 'stale' THEN conf WHEN 'merge' THEN CASE WHEN complete THEN greatest(conf, conf2) ELSE conf END ELSE conf2 END,
  CASE d WHEN 'stale' THEN n WHEN 'merge' THEN n + n2 ELSE n2 END, CASE d WHEN 'stale' THEN sig WHEN 'merge' THEN sig + sig2 ELSE sig2 END, CASE d WHEN 'stale' THEN ev WHEN 'merge' THEN {_EVIDENCE.format(a='ev', b='ev2')} ELSE ev2 END, d = 'merge' AND complete AND p2 < place,
  CASE WHEN d = 'merge' THEN concat_ws(',', CASE WHEN n2 > 0 THEN 'events_added' END, CASE WHEN sig2 > 0 THEN 'signals_added' END, CASE WHEN up THEN 'severity_increased' END, CASE WHEN complete AND conf2 > conf THEN 'confidence_changed' END, CASE WHEN complete AND p2 < place THEN 'primary_identity_promoted' END, CASE WHEN fu < a OR lu > z THEN 'time_window_extended' END) ELSE '' END
FROM (SELECT b.key, b.job, b.r, b.first_us AS fu, b.last_us AS lu, b.version, b.now_us, b.place AS p2, b.sev AS sev2, b.conf AS conf2, b.n AS n2, b.sig AS sig2, b.ev AS ev2, b.complete, b.complete AND {_RANK.format(x='b.sev')} > {_RANK.format(x='s.sev')} AS up, s.g, s.a, s.z, s.v, s.e, s.place, s.sev, s.conf, s.n, s.sig, s.ev,
  CASE WHEN b.now_us >= s.e + {_FORGET_US} THEN 'first' WHEN b.job % 13 = 5 THEN 'repair' WHEN b.version <> s.v OR s.e <= b.now_us OR b.first_us > s.z + {WINDOW_US} THEN 'new_generation' WHEN b.last_us < s.a - {WINDOW_US} THEN 'stale' ELSE 'merge' END AS d FROM s JOIN b ON b.key = s.key AND b.r = s.r + 1))
SELECT key, job, key || '-' || CAST(job AS VARCHAR) AS arrival_id, d AS decision, g AS generation, a AS first_us, z AS last_us, 't' || CAST(place AS VARCHAR) AS type, 'f' || CAST(place % 2 AS VARCHAR) AS family, key AS entity, place, sev AS severity, conf AS confidence, n AS n_events, sig AS n_signals, array_to_string(ev, ',') AS evidence, promoted, changes FROM s"""


@register("merged_campaigns", _BUNDLES)
def merged_campaigns(spark, sf_dir):
    """What each job's incident makes of its campaign's bundle."""
    return bundles.replay(bundle_arrivals(spark, sf_dir), WINDOW_US, TTL_US, _FORGET_US)


@register("stream_merged_campaigns", _BUNDLES)
def stream_merged_campaigns(spark, sf_dir):
    """The same by a stateful stream that forgets expired keys."""
    rows = bundle_arrivals(spark, sf_dir)
    stream = spark.readStream.schema(rows.schema).parquet(scratch.written(rows, "arrivals"))
    return streams.run_available(streams.merged(stream, WINDOW_US, TTL_US, _FORGET_US), "bundles")


@register("campaign_provenance", f"{_CAMPAIGNS} SELECT key, generation, count(*) AS n_jobs, CAST(max_by(n, job) AS BIGINT) AS current_events, CAST(sum(n) - max_by(n, job) AS BIGINT) AS prior_events FROM s JOIN arrivals USING (key, job) WHERE decision <> 'stale' GROUP BY key, generation")
def campaign_provenance(spark, sf_dir):
    """How many jobs and events each campaign has, of its last job and of those before."""
    rows = scratch.stored(arrivals(spark, sf_dir), "arrivals")
    return campaigns.provenance(campaigns.replay(rows, WINDOW_US, TTL_US), rows.select("key", "job", "n"))


@register("stream_event_windows", f"""SELECT src_ip, ts_us // 60000000 * 60000000 AS start_us, count(*) AS n, count(*) FILTER (WHERE blocked_legacy) AS n_blocked FROM {FEATURED}
GROUP BY 1, 2 HAVING start_us + 60000000 <= (SELECT max(ts_us) FROM {canonical_sql()}) - 120000000""")
def stream_event_windows(spark, sf_dir):
    """Minutes of each source by a stream with a watermark; minutes that it has not passed yet are not given out."""
    rows = featured_events(spark, sf_dir).select("src_ip", "blocked_legacy", F.timestamp_micros("ts_us").alias("at"))
    stream = spark.readStream.schema(rows.schema).parquet(scratch.written(rows, "minutes"))
    return streams.run_available(streams.counted(stream, "at", ["src_ip"], F.col("blocked_legacy")), "windows")


#: Incidents, jobs and holds that a fixed mapping makes of the events.
_STORE_COLUMNS = {
    "event_id": COLUMNS["event_id"], "event_no": "no", "ts_us": COLUMNS["ts_us"],
    "incident_id": "'I-' || CAST(CAST(floor(no / 40) AS BIGINT) AS {string})", "job_id": "'J-' || CAST(CAST(floor(no / 300) AS BIGINT) AS {string})",
    "status": "CASE CAST(floor(no / 40) AS BIGINT) % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'closed' WHEN 2 THEN 'new' WHEN 3 THEN 'triaged' WHEN 4 THEN 'closed' END",
    "job_status": "CASE CAST(floor(no / 300) AS BIGINT) % 5 WHEN 1 THEN 'failed' WHEN 2 THEN CAST(NULL AS {string}) ELSE 'completed' END",
    "asked": "CASE k % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'reopened' WHEN 2 THEN 'triaged' WHEN 3 THEN 'investigating' ELSE 'needs_review' END",
    "zone": "CASE WHEN no % 7 = 0 THEN CASE CAST(floor(no / 40) AS BIGINT) % 4 WHEN 0 THEN '+02:00' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN '-05:30' ELSE '+01:00' END WHEN 2 THEN '+27:00' END END",
    "released_us": "CASE WHEN no % 89 = 0 THEN 1 END", "until_us": "CASE WHEN no % 3 = 0 THEN 10 WHEN no % 3 = 1 THEN CAST(99 AS BIGINT) * 1000000000000000 END",
}
_STORE = canonical_sql(_STORE_COLUMNS)


def _store(spark, sf_dir) -> DataFrame:
    return canonical_events(spark, sf_dir, _STORE_COLUMNS)


def _incidents(rows: DataFrame) -> DataFrame:
    return rows.groupBy("incident_id", "job_id", "status", "job_status").agg(F.max("ts_us").alias("at_us"))


@register("status_transitions", f"""WITH e AS (SELECT incident_id, arg_max(asked, event_no) AS asked, any_value(status) AS status, CASE WHEN min(event_no) % 80 < 40 THEN 3 ELSE 1 END AS version FROM {_STORE} GROUP BY incident_id),
f(old, new) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, following in lifecycle.FOLLOWING.items() for b in following)})
SELECT incident_id, status AS old_status, asked AS new_status, CASE WHEN status = asked THEN 'unchanged' WHEN new IS NOT NULL THEN 'changed' ELSE 'refused' END AS outcome, CASE WHEN new IS NOT NULL THEN asked ELSE status END AS status,
CAST(version + CASE WHEN new IS NOT NULL THEN 1 ELSE 0 END AS INT) AS version FROM e LEFT JOIN f ON old = status AND new = asked""")
def status_transitions(spark, sf_dir):
    """The last request of each incident for another status and what comes of it."""
    rows = _store(spark, sf_dir).groupBy("incident_id").agg(F.first("status", ignorenulls=True).alias("status"), F.when(F.min("event_no") % 80 < 40, 3).otherwise(1).alias("version"), F.max_by("asked", "event_no").alias("new_status"))
    return lifecycle.transitions(rows.select("incident_id", "status", "version"), rows.select("incident_id", "new_status"))


@register("source_offsets", f"SELECT incident_id, CASE WHEN count(DISTINCT zone) = 1 AND regexp_matches(min(zone), '^[+-]([01][0-9]|2[0-3]):[0-5][0-9]$') THEN min(zone) END AS \"offset\" FROM {_STORE} GROUP BY incident_id")
def source_offsets(spark, sf_dir):
    """The one time offset that an incident's events name."""
    return lifecycle.source_offset(_store(spark, sf_dir), "incident_id", "zone")


@register("identity_conflicts", f"""SELECT event_id, array_to_string([x FOR x IN [CASE WHEN a.src_ip <> b.src_ip THEN 'src_ip' END, CASE WHEN a.dst_port <> b.dst_port THEN 'dst_port' END, CASE WHEN a.inbound_zone <> b.inbound_zone THEN 'inbound_zone' END] IF x IS NOT NULL], ',') AS fields
FROM {canonical_sql()} a JOIN {canonical_sql(COLUMNS | {'src_ip': "'45.83.64.9'", 'inbound_zone': "CASE WHEN k % 3 = 0 THEN 'lan-zone' END"})} b USING (event_id) WHERE a.src_ip <> b.src_ip OR a.inbound_zone <> b.inbound_zone""")
def identity_conflicts(spark, sf_dir):
    """Events that come again with other values."""
    again = canonical_events(spark, sf_dir, COLUMNS | {"src_ip": "'45.83.64.9'", "inbound_zone": "CASE WHEN k % 3 = 0 THEN 'lan-zone' END"})
    return lifecycle.conflicts(canonical_events(spark, sf_dir), again, "event_id", ["src_ip", "dst_port", "inbound_zone"])


#: Rows of the first three fifths of the table's time are aged.
_AGED = "(SELECT max(ts_us) * 3 // 5 FROM e)"
#: Of each entity in SQL: rows (id, at), whether its own status is final, and what open rows protect.
_OPEN, _OPEN_JOB = "coalesce(status, '') NOT IN ('resolved', 'closed')", "coalesce(job_status, '') <> 'completed'"
_ENTITIES = {
    "canonical_event": ("SELECT event_id AS id, ts_us AS at_us FROM e", "true", f"SELECT event_id FROM e WHERE {_OPEN} OR {_OPEN_JOB}"),
    "detection_signal": ("SELECT event_id AS id, ts_us AS at_us FROM e WHERE event_no % 4 = 0", "true", f"SELECT event_id FROM e WHERE {_OPEN} OR {_OPEN_JOB}"),
    "ingestion_job": ("SELECT job_id AS id, max(ts_us) AS at_us FROM e GROUP BY job_id", "id NOT IN (SELECT job_id FROM e WHERE " + _OPEN_JOB + ")", f"SELECT job_id FROM e WHERE {_OPEN}"),
    "incident": ("SELECT incident_id AS id, max(ts_us) AS at_us FROM e GROUP BY incident_id", "id NOT IN (SELECT incident_id FROM e WHERE " + _OPEN + ")", "SELECT NULL"),
    "audit_event": ("SELECT 'A-' || event_id AS id, ts_us AS at_us FROM e", "true", "SELECT NULL"),
}
_HOLDS = "holds AS MATERIALIZED (SELECT unnest([event_id, incident_id, job_id, 'A-' || event_id]) AS id, released_us, until_us FROM e WHERE event_no % 97 = 0 OR event_no % 89 = 0)"
_RETENTION = f"WITH e AS MATERIALIZED (SELECT * FROM {_STORE}), {_HOLDS}, r AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS entity, id, {final} AS final, id IN ({guard}) IS TRUE AS guarded, id IN (SELECT id FROM holds WHERE released_us IS NULL AND (until_us IS NULL OR until_us > {lifecycle.KEPT_DAYS[name] * lifecycle.DAY_US} + {_AGED})) AS kept FROM ({rows}) WHERE at_us < {_AGED}"
    for name, (rows, final, guard) in _ENTITIES.items()
) + ")"


def _retention(spark, sf_dir) -> DataFrame:
    rows = scratch.stored(_store(spark, sf_dir), "store")
    aged = rows.agg(F.expr("max(ts_us) * 3 div 5")).first()[0] or 0
    named = F.explode(F.array("event_id", "incident_id", "job_id", F.concat(F.lit("A-"), "event_id")))
    marked = rows.where("event_no % 97 = 0 OR event_no % 89 = 0").select(named.alias("id"), "released_us", "until_us")
    holds = marked.withColumn("entity", F.explode(F.array(*[F.lit(x) for x in lifecycle.KEPT_DAYS])))
    found, jobs = _incidents(rows), rows.groupBy("job_id", "job_status").agg(F.max("ts_us").alias("at_us"))
    still = ~F.coalesce(F.col("status").isin(*lifecycle.FINAL_INCIDENTS), F.lit(False))
    running = ~F.coalesce(F.col("job_status").isin(*lifecycle.FINAL_JOBS), F.lit(False))
    at_work = [rows.where(still).select("event_id"), rows.where(running).select("event_id")]
    incidents = found.groupBy("incident_id", "status").agg(F.max("at_us").alias("at_us"))
    audits = rows.select(F.concat(F.lit("A-"), "event_id").alias("event_id"), "ts_us")
    each = (
        ("canonical_event", rows, "event_id", "ts_us", at_work, None), ("detection_signal", rows.where("event_no % 4 = 0"), "event_id", "ts_us", at_work, None),
        ("ingestion_job", jobs, "job_id", "at_us", [found.where(still).select("job_id")], ~running), ("incident", incidents, "incident_id", "at_us", [], ~still), ("audit_event", audits, "event_id", "ts_us", [], None),
    )
    out = None
    for entity, table, key, time, guards, status in each:
        part = lifecycle.retention(table, entity, key, time, aged + lifecycle.KEPT_DAYS[entity] * lifecycle.DAY_US, holds, guards, status)
        out = part if out is None else out.unionByName(part)
    return out


@register("retention_classes", f"{_RETENTION} SELECT entity, id, final AND NOT guarded AND NOT kept AS candidate, NOT final OR guarded AS protected, final AND kept AS held FROM r")
def retention_classes(spark, sf_dir):
    """Aged rows of five entities: which may go, which open rows protect, which are held."""
    return _retention(spark, sf_dir)


@register("cleanup_verdicts", f"""{_RETENTION}, asked AS (SELECT DISTINCT CASE WHEN event_no % 11 = 0 THEN 'X-' ELSE '' END || event_id AS id, event_no FROM e)
SELECT id, CASE WHEN id NOT IN (SELECT event_id FROM e) THEN 'missing' WHEN id NOT IN (SELECT id FROM r WHERE entity = 'canonical_event' AND NOT guarded AND NOT kept) THEN 'not_eligible' WHEN event_no % 5 = 0 THEN 'not_archived' WHEN event_no % 7 = 0 THEN 'referenced' ELSE 'delete' END AS verdict FROM asked""")
def cleanup_verdicts(spark, sf_dir):
    """What becomes of events that are to be deleted."""
    rows = _store(spark, sf_dir)
    asked = rows.select(F.concat(F.when(F.col("event_no") % 11 == 0, "X-").otherwise(""), "event_id").alias("id"))
    may_go = _retention(spark, sf_dir).where("entity = 'canonical_event' AND candidate")
    of = lambda when: rows.where(when).select(F.col("event_id").alias("id"))
    return lifecycle.cleanup(asked, of("true"), may_go, of("event_no % 5 <> 0"), of("event_no % 7 = 0"))
