"""Roll-ups of incidents: groups of blocked reconnaissance, clusters of fixed source ports, exposed assets, action items and the funnel.

Input: ``facts``, one row for each incident and each of its events: the incident's columns (incident_id, family, severity) and the event's with features.

Defined cases: an incident with any event that isn't blocked is in no group of blocked reconnaissance; sources that are no address are in no network (of IPv4
the /24, of IPv6 the /64; bursts of fixed source ports are those of IPv4 networks); an event of several incidents counts once in each result row. No rows: no groups, and a funnel of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.features import subnet_sql

#: Families of the roll-ups, and their limits.
RECON = ("network_scanning", "service_probing")
EXPOSURE = ("firewall_exposure", "firewall_policy")
SECONDS, FEW_PORTS, SHOWN, SHOWN_EVENTS = 300, 5, 5, 50
CLUSTER_SECONDS, CLUSTER_SOURCES, CLUSTER_EACH, CLUSTER_ALL = 60, 2, 3, 7


def facts(incidents: DataFrame, bridge: DataFrame, events: DataFrame) -> DataFrame:
    """incidents with their events; bridge: (incident_id, event_id)."""
    return bridge.select("incident_id", "event_id").distinct().join(incidents, "incident_id").join(events, "event_id")


def network(ip: str, number: str) -> Column:
    """The /24 network of an IPv4 address."""
    return F.when(F.col(number).isNotNull(), F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))


def _joined(array: Column) -> Column:
    return F.array_join(F.array_sort(array).cast("array<string>"), ",")


def recon_groups(rows: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """Wholly blocked reconnaissance by source network, family and scope (its services, or few ports), in runs without a pause of over ``seconds``.

    Incidents are reduced to one row for each network before they are put in order."""
    recon = rows.where(F.col("family").isin(*RECON)).withColumn("cidr", F.when(F.col("src_class").isNotNull(), F.expr(subnet_sql("src_ip", "src_v4")))).select("incident_id", "family", "cidr", "event_id", "ts_us", "src_ip", "dst_ip", "dst_port", "service", "blocked")
    part = recon.groupBy("incident_id", "family", "cidr").agg(
        F.bool_and("blocked").alias("blocked"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.collect_set("service").alias("services"), F.collect_set("dst_port").alias("ports")
    )  # as many services and ports as there are
    scope = F.when(F.size("services") > 0, F.concat(F.lit("services:"), _joined(F.col("services")))).when(F.size("ports") <= FEW_PORTS, F.concat(F.lit("ports:"), _joined(F.col("ports")))).otherwise("ports:varied")
    part = part.withColumns({"_all": F.min("blocked").over(W.partitionBy("incident_id")), "scope": scope}).where("_all AND cidr IS NOT NULL")
    order = W.partitionBy("cidr", "family", "scope").orderBy("first_us", "incident_id")
    until = F.max("last_us").over(order.rowsBetween(W.unboundedPreceding, -1))
    part = part.withColumn("_new", (F.col("first_us") > until + seconds * 1_000_000).cast("int")).withColumn("island", F.coalesce(F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    own = recon.where("cidr IS NOT NULL").select("incident_id", "cidr", "event_id", "ts_us", "src_ip", "dst_ip", "dst_port")
    found = own.join(part.select("incident_id", "cidr", "family", "scope", "island"), ["incident_id", "cidr"])
    group = ["cidr", "family", "scope", "island"]
    few = found.select(*group, "src_ip").distinct().withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy("src_ip"))).where(F.col("_r") <= SHOWN)  # an IPv6 network has any number of sources
    few = few.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list("src_ip")), ",").alias("sources"))
    return found.groupBy(*group).agg(
        F.count_distinct("src_ip").alias("n_sources"), F.count_distinct("event_id").alias("n_events"), F.count_distinct("dst_ip").alias("n_targets"),
        _joined(F.collect_set("dst_port")).alias("ports"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
    ).join(few, group).drop("island")


def source_port_clusters(findings: DataFrame, seconds: int = CLUSTER_SECONDS) -> DataFrame:
    """Of findings (src_ip, src_v4, src_port, n, first_us, last_us), at most one for each source and port: those of one network and port in bursts that end within ``seconds`` of their
    beginning, where enough sources and events come together. A group is a network, so it has at most 256 findings."""
    one = F.struct("first_us", "src_ip", "last_us", F.col("n").cast("long").alias("n"))
    own = findings.where(F.col("n") >= CLUSTER_EACH).withColumn("cidr", network("src_ip", "src_v4")).where("cidr IS NOT NULL").groupBy("cidr", "src_port").agg(F.array_sort(F.collect_list(one)).alias("all"))
    zero = F.expr("named_struct('run', -1, 'start', 0L, 'end', 0L, 'out', CAST(array() AS array<struct<run:int,x:struct<first_us:bigint,src_ip:string,last_us:bigint,n:bigint>>>))")

    def step(a: Column, x: Column) -> Column:
        same = (a["run"] >= 0) & (F.greatest(a["end"], x["last_us"]) - a["start"] <= seconds * 1_000_000)
        run = F.when(same, a["run"]).otherwise(a["run"] + 1)
        start, end = F.when(same, a["start"]).otherwise(x["first_us"]), F.when(same, F.greatest(a["end"], x["last_us"])).otherwise(x["last_us"])
        return F.struct(run.alias("run"), start.alias("start"), end.alias("end"), F.array_append(a["out"], F.struct(run.alias("run"), x.alias("x"))).alias("out"))

    each = own.select("cidr", "src_port", F.explode(F.aggregate("all", zero, step, lambda a: a["out"])).alias("o")).select("cidr", "src_port", "o.run", "o.x.*")
    found = each.groupBy("cidr", "src_port", "run").agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_events"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), _joined(F.collect_list("src_ip")).alias("sources"))
    return found.where((F.col("n_sources") >= CLUSTER_SOURCES) & (F.col("n_events") >= CLUSTER_ALL)).drop("run")


def exposed_assets(rows: DataFrame) -> DataFrame:
    """Exposed (destination, service), from the allowed inbound events of exposure incidents alone."""
    seen = rows.where(F.col("family").isin(*EXPOSURE)).where("allowed AND external AND sensitive_service IS NOT NULL AND coalesce(eff_dst, '') <> ''").dropDuplicates(["event_id"])
    nat = (F.coalesce(F.trim("translated_dst_ip"), F.lit("")) != "") | F.col("translated_dst_port").isNotNull()
    seen = seen.select("eff_dst", F.col("sensitive_service").alias("service"), "event_id", "eff_port", "dst_ip", nat.alias("nat"), F.when(F.col("src_public"), F.col("src_ip")).alias("source"), F.coalesce(F.nullif("translated_dst_ip", F.lit("")), "eff_dst").alias("address"))
    key = ["eff_dst", "service"]
    whole = seen.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), _joined(F.collect_set("eff_port")).alias("ports"), F.bool_or("nat").alias("nat_observed"), F.max_by("address", F.when(F.col("nat"), F.col("event_id"))).alias("internal_address"))
    first = lambda df, c, n: df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(c))).where(F.col("_r") <= n).groupBy(*key)
    shown = first(seen, "event_id", SHOWN_EVENTS).agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("evidence"))
    public = first(seen.where("nat AND coalesce(dst_ip, '') <> ''").select(*key, "dst_ip").distinct(), "dst_ip", SHOWN).agg(F.array_join(F.array_sort(F.collect_list("dst_ip")), ",").alias("public_destinations"))
    return whole.join(shown, key).join(public, key, "left")


def action_items(incidents: DataFrame, rows: DataFrame) -> DataFrame:
    """(section, incident_id, severity, confidence, first_us): the most urgent incidents that aren't wholly blocked reconnaissance, a few for each section."""
    quiet = rows.where(F.col("family").isin(*RECON)).groupBy("incident_id").agg(F.bool_and("blocked").alias("_q")).where("_q").select("incident_id")
    left = incidents.join(quiet, "incident_id", "left_anti").select("incident_id", "severity", "confidence", "first_us")
    top = lambda levels, name: left.where(F.col("severity").isin(*levels)).orderBy(F.col("severity") != levels[0], F.desc("confidence"), "first_us", "incident_id").limit(SHOWN).withColumn("section", F.lit(name))
    return top(("critical", "high"), "act_now").unionByName(top(("medium",), "investigate"))


def funnel(events: DataFrame, items: DataFrame) -> DataFrame:
    """One row: events, blocked ones, exposures by policy, action items."""
    exposure = F.col("allowed") & F.col("external") & F.col("sensitive_service").isNotNull()
    one = events.agg(F.count_distinct("event_id").alias("total_events"), F.count_if("blocked").alias("blocked_events"), F.count_distinct(F.when(exposure, F.col("event_id"))).alias("policy_exposures"))
    return one.join(items.agg(F.count("*").alias("action_items")))  # two rows of totals
