"""Signals: union of the rules' results, suppression, merging of one rule's overlapping signals, and clustering into incidents.

A signal names its events by a range (from (first_us, first_id) to (last_us, event_id) of its rule and key; of a sequence only the blocked ones
and the last), so signals carry no lists, and two of one key share events exactly if their ranges do. Signals of a rule and key that share events
become one run, within stretches of time first and then over their bounds, so a hot key is split. Runs of one rule never share events (an event has one key
for each rule), so the bridge (signal_id, event_id) has at most one row for each event and rule, and all later tables grow with the events. What runs
of different rules share is counted by event. Signals join anchors in rounds, each over those whose earlier candidates are all decided; a round
settles at least the next rule in the order of precedence, so there are no more rounds than rules. Nothing is folded in a group.

A run is not broken by another key's signals in between: those never share its events.

Defined cases: signals of a null entity are those of one entity, "". Equal signals (repeated events) count each. Without signals all results are empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import rules, scratch, suppression

MERGE_SECONDS, OVERLAP = 300, 0.7
#: Evidence that a signal and an incident keep, families whose incidents belong to the asset, and the share of events at which incidents are one.
SIGNAL_EVIDENCE, INCIDENT_EVIDENCE, ASSET_FAMILIES, NESTED = 3, 10, ("firewall_exposure", "firewall_policy"), 0.5
SEVERITY = ("informational", "low", "medium", "high", "critical")
#: Precedence of signal types, the strongest evidence first.
PRECEDENCE = (
    ("scan_followed_by_allowed_connection", "blocked_then_allowed_same_service", "spi_followed_by_allowed_connection"),
    ("critical_management_service_exposed", "dnat_sensitive_service_exposure", "wan_to_lan_sensitive_service_allowed", "multi_source_allowed_sensitive_service", "wan_to_dmz_administrative_service_allowed", "inbound_sensitive_service_allowed"),
    ("rdp_probe", "ssh_probe", "smb_probe", "vnc_probe", "winrm_probe", "mssql_probe", "oracle_probe", "mysql_probe", "postgresql_probe", "redis_probe", "elasticsearch_probe", "mongodb_probe", "docker_daemon_probe", "kubernetes_api_probe", "kubelet_probe", "telnet_probe", "ftp_probe", "web_admin_panel_probe"),
    ("low_and_slow_horizontal_scan", "low_and_slow_vertical_scan", "internal_lateral_scan", "subnet_sweep", "distributed_scan", "multi_service_sweep"),
    ("network_scan_horizontal", "network_scan_vertical", "fixed_source_port_scan"),
    ("repeated_blocked_scanner",),
)
RANK = {name: (i, j) for i, names in enumerate(PRECEDENCE, 1) for j, name in enumerate(names)}
HOUR = 3_600_000_000
_FAMILY = {r.name: r.family for r in rules.RULES}


def family_of(rule: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in _FAMILY.items() for x in pair])[rule]


def all_signals(events: DataFrame, chosen: Iterable[rules.Rule] = rules.RULES, policy: suppression.Policy = suppression.Policy()) -> DataFrame:
    """Every rule's raw signals in one frame (see rules.evaluate_all), each with the reason why it is suppressed, or null. Features should be stored before: each rule reads them."""
    found = rules.evaluate_all(events.withColumn("late_reset", suppression.is_late_reset()), chosen, ["late_reset"], suppression.window_marks(policy), lean=True)
    return found.withColumn("entity", F.coalesce("entity", F.lit(""))).withColumn("reason", suppression.window_reason(policy))


def active(signals: DataFrame) -> DataFrame:
    return signals.where("reason IS NULL")


def numbered(signals: DataFrame) -> DataFrame:
    """Adds head: where the run of a signal begins, by stretches of an hour. Of a rule and key, each signal that shares events with the one before it
    and begins at most MERGE_SECONDS after that one's end is of its run."""
    key = ["rule", "entity", "key"]
    stretch = W.partitionBy(*key, "stretch").orderBy("first_us", "last_us", "event_id")
    own = signals.withColumn("stretch", F.expr(f"(last_us - pmod(last_us, {HOUR})) div {HOUR}")).withColumn("_place", F.struct(F.col("first_us").alias("us"), F.col("first_id").alias("id")))
    own = own.withColumn("_head", F.when(_apart(F.col("_place"), F.lag(F.struct(F.col("last_us").alias("us"), F.col("event_id").alias("id"))).over(stretch)), F.col("_place")))
    return own.withColumn("head", F.last("_head", ignorenulls=True).over(stretch.rowsBetween(W.unboundedPreceding, 0))).drop("_head", "_place")


def _apart(begin: Column, before: Column) -> Column:
    """Whether a signal or run that begins there shares nothing with the one before it (null: there is none)."""
    return before.isNull() | (begin > before) | (begin["us"] - before["us"] > MERGE_SECONDS * 1_000_000)


def merge(runs: DataFrame) -> DataFrame:
    """One row for each run of ``numbered``, those that meet at the bounds of a stretch joined: the first signal's severity and confidence, the union's extent, and a signal_id."""
    key = ["rule", "entity", "key", "corr"]
    first = F.struct("first_us", "last_us", "event_id", "severity", "confidence")
    part = runs.groupBy(*key, "stretch", "head").agg(F.max(F.struct(F.col("last_us").alias("us"), F.col("event_id").alias("id"))).alias("tail"), F.count("*").alias("n"), F.min(first).alias("first"))
    order = W.partitionBy("rule", "entity", "key").orderBy("head", "tail")  # a few rows for each stretch
    part = part.withColumn("_head", F.when(_apart(F.col("head"), F.lag("tail").over(order)), F.col("head"))).withColumn("whole", F.last("_head", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    one = part.groupBy(*key, "whole").agg(F.max("tail").alias("tail"), F.sum("n").alias("n_merged"), F.min("first").alias("first"))
    one = one.select(*key, F.col("whole.us").alias("first_us"), F.col("whole.id").alias("first_id"), F.col("tail.us").alias("last_us"), F.col("tail.id").alias("event_id"), "n_merged", "first.severity", "first.confidence")
    name = F.sha2(F.concat_ws("|", "rule", F.lit("1.0.0"), "entity", F.when(F.col("n_merged") > 1, F.concat(F.lit("merged "), F.col("corr"))).otherwise(F.col("corr")), "first_us", "first_id", "last_us", "event_id"), 256)
    return one.withColumn("signal_id", F.concat(F.lit("SIG-"), F.upper(F.substring(name, 1, 12))))


def merge_sql(raw: str) -> str:
    """The same for DuckDB; raw: a table of raw signals with key and first_id."""
    order = "PARTITION BY rule, entity, key ORDER BY first_us, last_us, event_id"
    return f"""WITH l AS (SELECT *, lag(last_us) OVER o AS u, lag(event_id) OVER o AS e FROM ({raw}) WINDOW o AS ({order})),
i AS (SELECT *, sum(CASE WHEN (first_us < u OR (first_us = u AND first_id <= e)) AND first_us - u <= {MERGE_SECONDS}000000 THEN 0 ELSE 1 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT rule, entity, key, corr, min(first_us) AS first_us, arg_min(first_id, (first_us, last_us, event_id)) AS first_id, max(last_us) AS last_us, arg_max(event_id, (last_us, event_id)) AS event_id, count(*) AS n_merged,
  arg_min(severity, (first_us, last_us, event_id)) AS severity, arg_min(confidence, (first_us, last_us, event_id)) AS confidence
FROM i GROUP BY rule, entity, key, corr, run"""


def signal_events(events: DataFrame, signals: DataFrame, merged: DataFrame, chosen: Iterable[rules.Rule] = rules.RULES) -> DataFrame:
    """The bridge (signal_id, entity, rule, event_id, ts_us, tgt) of merged signals: the events of each one's range, and of sequences the allowed ones of its raw signals.

    signals: the raw ones. Runs of a key end more than a window apart, so an hour has few of them."""
    chosen = list(chosen)
    hour = F.expr(f"(ts_us - pmod(ts_us, {HOUR})) div {HOUR}")
    rows = rules.members_of(events, chosen, columns=("rule", "key", "ts_us", "event_id", "tgt", "inside")).where("inside").withColumn("hour", hour)
    hours = F.explode(F.sequence(F.expr(f"(first_us - pmod(first_us, {HOUR})) div {HOUR}"), F.expr(f"(last_us - pmod(last_us, {HOUR})) div {HOUR}")))
    spans = merged.select("signal_id", "entity", "rule", "key", "first_us", "first_id", "last_us", F.col("event_id").alias("last_id"), hours.alias("hour"))
    within = "(ts_us > first_us OR (ts_us = first_us AND event_id >= first_id)) AND (ts_us < last_us OR (ts_us = last_us AND event_id <= last_id))"
    held = lambda rows: rows.join(spans, ["rule", "key", "hour"]).where(within).select("signal_id", "entity", "rule", "event_id", "ts_us", "tgt")
    bridge, sequences = held(rows), [r for r in chosen if r.kind == "sequence"]
    if sequences:  # of a sequence's other events only those that fired count
        ends = signals.where(F.col("rule").isin([r.name for r in sequences])).select("rule", "key", "event_id").distinct()
        others = rules.members_of(events, sequences, columns=("rule", "key", "ts_us", "event_id", "tgt", "inside")).where("NOT inside").withColumn("hour", hour)
        bridge = bridge.unionByName(held(others.join(ends, ["rule", "key", "event_id"], "left_semi")))
    return bridge.distinct()


def _place(kind: Column) -> Column:
    """A signal type's place in the order of precedence."""
    names = [n for tier in PRECEDENCE for n in tier]
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), kind), F.lit(0)), F.lit(len(names) + 1))


def _order(merged: DataFrame) -> Column:
    """The place of a signal among all: precedence, severity, confidence, time, name."""
    level = F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), F.col("severity"))
    return F.struct(_place(F.col("rule")).alias("a"), (-level).alias("b"), (-F.col("confidence")).alias("c"), F.col("first_us").alias("d"), F.col("rule").alias("e"), F.col("signal_id").alias("f"))


def shared_events(bridge: DataFrame, by: list[str]) -> DataFrame:
    """(a, b, common): how many events two signals of different rules have in common; by: what else must be equal. An event has at most one signal for each rule."""
    met = bridge.groupBy("event_id", *by).agg(F.array_sort(F.collect_set("signal_id")).alias("s")).where(F.size("s") > 1)
    met = met.select(F.posexplode("s").alias("at", "a"), "s").select("a", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("b"))
    return met.groupBy("a", "b").agg(F.count("*").alias("common"))


def equal_exposures(merged: DataFrame, bridge: DataFrame) -> DataFrame:
    """(a, b, common) of exposure signals of different entities that have exactly the same events, and an entity or target in common.

    Equal sets have equal fingerprints, which don't depend on an order; those that do are compared event by event."""
    family = family_of(F.col("rule"))
    own = merged.where(family.isin(*ASSET_FAMILIES)).select("signal_id", "entity")
    rows = bridge.join(own.select("signal_id"), "signal_id", "left_semi")
    hashed = F.xxhash64("event_id")
    prints = rows.groupBy("signal_id").agg(F.count("*").alias("n"), F.bit_xor(hashed).alias("x"), F.sum(hashed.cast("decimal(20,0)")).alias("y")).join(own, "signal_id")
    a, b = (prints.select(*[F.col(c).alias(f"{x}_{c}") for c in ("signal_id", "entity")], "n", "x", "y") for x in "ab")
    asked = a.join(b, ["n", "x", "y"]).where("a_signal_id < b_signal_id AND a_entity <> b_entity").select(F.col("a_signal_id").alias("a"), F.col("b_signal_id").alias("b"), "n")
    of = lambda x, frame, name: frame.select(F.col("signal_id").alias(x), name)
    same = asked.join(of("a", rows, "event_id"), "a").join(of("b", rows, "event_id"), ["b", "event_id"]).groupBy("a", "b", "n").agg(F.count("*").alias("common")).where("common = n").drop("n")
    scope = rows.select("signal_id", F.col("tgt").alias("name")).unionByName(own.select("signal_id", F.col("entity").alias("name"))).where("name <> ''").distinct()
    met = same.join(of("a", scope, "name"), "a").join(of("b", scope, "name"), ["b", "name"]).select("a", "b").distinct()
    return same.join(met, ["a", "b"], "left_semi").select("a", "b", "common")


def candidates(merged: DataFrame, bridge: DataFrame) -> DataFrame:
    """(signal_id, anchor, rank): each signal's earlier signals near in time of which it shares at least OVERLAP of the smaller one's events, or, of exposures of other entities, all; the least rank is the best."""
    own = merged.select("signal_id", "first_us", "last_us", _order(merged).alias("order")).join(bridge.groupBy("signal_id").agg(F.count("*").alias("n")), "signal_id")
    common = shared_events(bridge, ["entity"]).unionByName(equal_exposures(merged, bridge))
    one = lambda x: own.select(F.col("signal_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("first_us", "last_us", "n", "order")])
    near = F.greatest(F.col("a_first_us") - F.col("b_last_us"), F.col("b_first_us") - F.col("a_last_us")) <= MERGE_SECONDS * 1_000_000
    pairs = common.join(one("a"), "a").join(one("b"), "b").withColumn("share", F.col("common") / F.least("a_n", "b_n")).where((F.col("share") >= OVERLAP) & near)
    earlier = F.col("a_order") < F.col("b_order")
    rank = F.struct((-F.col("share")).alias("s"), F.least("a_order", "b_order").alias("o"))
    return pairs.select(F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("signal_id"), F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("anchor"), rank.alias("rank"))


def cluster(merged: DataFrame, bridge: DataFrame) -> DataFrame:
    """(signal_id, anchor_id): each merged signal's incident, named by its anchor. In order of precedence each signal joins the best of its candidates that is an anchor, or is one itself."""
    open_ = scratch.stored(candidates(merged, bridge), "candidates")
    every = merged.select("signal_id")
    done = scratch.stored(every.join(open_, "signal_id", "left_anti").select("signal_id", F.col("signal_id").alias("anchor_id")), "anchors")
    found = [done]
    while not open_.isEmpty():
        # a round's own decisions are enough: candidates that joined another anchor go, and what has none left is an anchor
        known = open_.join(done.select(F.col("signal_id").alias("anchor"), (F.col("anchor_id") == F.col("signal_id")).alias("is_anchor")), "anchor", "left")
        state = known.withColumn("is_anchor", F.coalesce("is_anchor", "settled") if "settled" in open_.columns else F.col("is_anchor")).select("signal_id", "anchor", "rank", F.col("is_anchor").alias("settled"))
        state = scratch.stored(state, "state")
        best = state.groupBy("signal_id").agg(F.count_if(F.col("settled").isNull()).alias("waiting"), F.min_by("anchor", F.when(F.col("settled"), F.col("rank"))).alias("best")).where("waiting = 0")
        done = scratch.stored(best.select("signal_id", F.coalesce("best", "signal_id").alias("anchor_id")), "anchors")
        found.append(done)
        open_ = scratch.stored(state.join(done, "signal_id", "left_anti"), "candidates")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def absorb(pdf: pd.DataFrame) -> pd.DataFrame:
    """(incident_id, keeper_id) of linked incidents of one type, entity and stretch of time: the larger ones first, each joins the largest that nests with it, or is one.

    A row is an incident (incident_id, n, first_us, last_us, holds: null), or a class of events: how many (n) are held by exactly the incidents in ``holds``. What a keeper has grows by what it absorbs."""
    own, classes = pdf[pdf["holds"].isna()], pdf[~pdf["holds"].isna()]
    sizes = {i: (set(h), n) for i, (h, n) in enumerate(zip(classes["holds"], classes["n"], strict=True))}
    has = {r.incident_id: {i for i, (h, _) in sizes.items() if r.incident_id in h} for r in own.itertuples()}
    count = lambda x: sum(sizes[i][1] for i in x)
    kept: list[list] = []  # id, classes, first, last, own first
    out = []
    for r in sorted(own.itertuples(), key=lambda r: (-r.n, r.first_us, r.incident_id)):
        mine, best = has[r.incident_id], None
        for k in kept:
            both = count(k[1] & mine)
            nested = both and (k[1] <= mine or mine <= k[1] or both >= NESTED * count(k[1] | mine))
            if nested and k[2] <= r.last_us and r.first_us <= k[3] and (best is None or (-count(k[1]), k[2], k[0]) < (-count(best[1]), best[2], best[0])):
                best = k
        if best is None:
            kept.append([r.incident_id, mine, r.first_us, r.last_us])
        else:
            best[1], best[2], best[3] = best[1] | mine, min(best[2], r.first_us), max(best[3], r.last_us)
        out.append((r.incident_id, best[0] if best else r.incident_id))
    return pd.DataFrame(out, columns=["incident_id", "keeper_id"])


def overlapping(found: DataFrame, held: DataFrame) -> DataFrame:
    """(incident_id, keeper_id) of incidents (incident_id, type, entity, first_us, last_us, n) that a larger one of their type and entity absorbs. held: (incident_id, event_id), each once.

    Only incidents that share events are looked at, and of their events only how many each set of incidents holds: a group has rows by incident, not by event."""
    own = held.join(found.select("incident_id", "type", "entity"), "incident_id")
    classes = own.groupBy("type", "entity", "event_id").agg(F.array_sort(F.collect_set("incident_id")).alias("holds")).groupBy("type", "entity", "holds").agg(F.count("*").alias("n"))
    linked = classes.where(F.size("holds") > 1).select(F.explode("holds").alias("incident_id")).distinct()
    order = W.partitionBy("type", "entity").orderBy("first_us", "last_us")
    own = found.join(linked, "incident_id", "left_semi").withColumn("_new", (F.col("first_us") > F.max("last_us").over(order.rowsBetween(W.unboundedPreceding, -1))).cast("int"))
    own = own.withColumn("island", F.coalesce(F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))).drop("_new")
    rows = own.select("type", "entity", "island", "incident_id", "n", "first_us", "last_us", F.lit(None).cast("array<string>").alias("holds"))
    at = classes.withColumn("incident_id", F.explode("holds")).join(own.select("incident_id", "island"), "incident_id").select("type", "entity", "island", "holds", "n").distinct()
    rows = rows.unionByName(at.select("type", "entity", "island", F.lit(None).cast("string").alias("incident_id"), "n", F.lit(None).cast("long").alias("first_us"), F.lit(None).cast("long").alias("last_us"), "holds"))
    return rows.groupBy("type", "entity", "island").applyInPandas(absorb, "incident_id string, keeper_id string").where("incident_id <> keeper_id")


def signal_details(merged: DataFrame, bridge: DataFrame) -> DataFrame:
    """Merged signals with the numbers of their events and targets, and their first events as evidence (a bounded list, kept by aggregation of the least places)."""
    place = W.partitionBy("signal_id").orderBy("ts_us", "event_id")
    few = bridge.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= SIGNAL_EVIDENCE)
    evidence = few.groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "event_id"))), lambda x: x["event_id"]).alias("evidence"))
    counts = bridge.groupBy("signal_id").agg(F.count("*").alias("n_events"), F.count_distinct(F.nullif("tgt", F.lit(""))).alias("n_targets"), F.min(F.nullif("tgt", F.lit(""))).alias("first_target"))
    return merged.join(counts, "signal_id").join(evidence, "signal_id")


def violations(details: DataFrame) -> DataFrame:
    """(signal_id, fault) of signals that break the contract: every signal has an entity, a known severity, a confidence from 0 to 1, an order of times, events, and evidence among them."""
    faults = {
        "entity": F.col("entity") == "", "severity": ~F.col("severity").isin(*SEVERITY), "confidence": ~F.col("confidence").between(0, 1), "times": F.col("last_us") < F.col("first_us"),
        "events": F.col("n_events") < 1, "targets": F.col("n_targets") < 1, "evidence": ~F.size("evidence").between(1, SIGNAL_EVIDENCE),
    }
    return details.select("signal_id", "rule", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(True)), F.lit(name)) for name, x in faults.items()]))).alias("fault"))


def incidents(merged: DataFrame, clusters: DataFrame, bridge: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each incident: anchor's identity, owner, extent, counts of signals, events and targets, and severity by what was allowed or blocked."""
    own = merged.select("signal_id", "first_us", "last_us", "confidence", F.col("severity").alias("own")).join(clusters, "signal_id")
    head = merged.select(F.col("signal_id").alias("anchor_id"), "rule", "entity")
    level = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("own")).cast("int") - 1
    best = own.withColumn("r", F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("confidence"), "signal_id"))).where("r <= 3").groupBy("anchor_id").agg(F.round(F.avg("confidence"), 6).alias("confidence"))
    span = own.groupBy("anchor_id").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.count("*").alias("n_signals"), F.max(level).alias("level"))
    of_anchor = F.max(F.col("signal_id") == F.col("anchor_id"))
    seen = bridge.select("signal_id", "event_id").join(clusters, "signal_id").groupBy("anchor_id", "event_id").agg(of_anchor.alias("anchors"))
    targets = bridge.select("signal_id", F.nullif("tgt", F.lit("")).alias("tgt")).join(clusters, "signal_id").groupBy("anchor_id").agg(F.count_distinct("tgt").alias("n_targets"))
    facts = seen.join(events.select("event_id", "allowed", "blocked", "eff_dst", "eff_port", "sensitive_service", "critical_port", "src_ip", F.coalesce("translated_dst_ip", "dst_ip").alias("asset")), "event_id")
    by_dst = facts.groupBy("anchor_id", "eff_dst").agg(
        F.count("*").alias("n"), F.count_if("allowed").alias("ok"), F.count_if("blocked").alias("no"), F.count_if(F.col("allowed") & F.col("critical_port")).alias("critical"),
        F.count_distinct(F.when(F.col("allowed") & F.col("sensitive_service").isNotNull() & ~F.col("critical_port"), F.col("eff_port"))).alias("ports"),
        F.min(F.when(F.col("anchors"), F.nullif("asset", F.lit("")))).alias("asset"), F.min(F.when(F.col("anchors"), F.nullif("src_ip", F.lit("")))).alias("source"),
    )
    facts = by_dst.groupBy("anchor_id").agg(F.sum("n").alias("n_events"), F.sum("ok").alias("n_allowed"), F.sum("no").alias("n_blocked"), F.count("eff_dst").alias("n_dst"), F.sum("critical").alias("critical"), F.max("ports").alias("ports"), F.min("asset").alias("asset"), F.min("source").alias("source"))
    family = family_of(F.col("rule"))
    worth = F.when(F.col("critical") > 0, 4).when(F.col("ports") > 0, 3).otherwise(2)
    volume = ((F.col("n_events") > 500) | (F.col("n_dst") > 50)).cast("int")
    raised = F.least(F.lit(4), worth + ((F.col("n_dst") <= 2) & (F.col("ports") >= 2)).cast("int") + volume)
    recon = family.isin("network_scanning", "service_probing", "lateral_movement_candidate")
    other = F.least(F.lit(4), F.col("level") + volume)
    decided = F.when(family.isin("network_anomaly", "network_dos"), other).when((F.col("n_allowed") == 0) & recon, F.when(F.col("n_dst") >= 25, 2).otherwise(1)).when(F.col("n_allowed") > 0, raised).otherwise(1)
    out = head.join(span, "anchor_id").join(best, "anchor_id").join(facts, "anchor_id").join(targets, "anchor_id").withColumns({"family": family, "severity": F.get(F.array(*[F.lit(s) for s in SEVERITY]), decided)})
    owner = F.when(F.col("family").isin(*ASSET_FAMILIES), F.coalesce("asset", "entity")).otherwise(F.col("entity"))
    return out.select(
        F.concat(F.lit("INC-"), F.substring("anchor_id", 5, 12)).alias("incident_id"), "rule", "family", "entity", owner.alias("primary_entity"), F.coalesce("source", "entity").alias("title_source"), "first_us", "last_us", "n_signals", "n_events",
        "n_allowed", "n_blocked", "n_dst", "n_targets", "confidence", "severity",
    )


class Tables(Mapping):
    """Tables of the chain by name, each made and stored when it is first asked for: what a query doesn't need is not computed."""

    NAMES = ("raw", "merged", "bridge", "clusters", "first_clusters", "first_incidents", "named", "held", "incidents", "absorbed")

    def __init__(self, events: DataFrame, chosen: list[rules.Rule], policy: suppression.Policy):
        self.events, self.chosen, self.policy, self.made = events, chosen, policy, {}

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self):
        return len(self.NAMES)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        if name not in self.made:
            self.made[name] = getattr(self, f"_{name}")()
        return self.made[name]

    def _raw(self):
        return scratch.stored(all_signals(self.events, self.chosen, self.policy), "raw")

    def _merged(self):
        return scratch.stored(merge(numbered(active(self["raw"]))), "merged")

    def _bridge(self):
        return scratch.stored(signal_events(self.events, active(self["raw"]), self["merged"], self.chosen), "bridge")

    def _first_clusters(self):
        return scratch.stored(cluster(self["merged"], self["bridge"]), "clusters")

    def _first_incidents(self):
        return scratch.stored(incidents(self["merged"], self["first_clusters"], self["bridge"], self.events), "incidents")

    def _named(self):
        return self["first_clusters"].withColumn("incident_id", F.concat(F.lit("INC-"), F.substring("anchor_id", 5, 12)))

    def _held(self):
        return self["bridge"].select("signal_id", "event_id").join(self["named"], "signal_id").select("incident_id", "event_id").distinct()

    def _absorbed(self):
        first = self["first_incidents"].select("incident_id", F.col("rule").alias("type"), F.col("primary_entity").alias("entity"), "first_us", "last_us", F.col("n_events").alias("n"))
        return scratch.stored(overlapping(first, self["held"]), "absorbed")

    def _clusters(self):
        if self["absorbed"].isEmpty():
            return self["first_clusters"]
        joined = self["named"].join(self["absorbed"], "incident_id", "left")
        return scratch.stored(joined.select("signal_id", F.coalesce(F.concat(F.lit("SIG-"), F.substring("keeper_id", 5, 12)), "anchor_id").alias("anchor_id")), "clusters")

    def _incidents(self):
        if self["absorbed"].isEmpty():
            return self["first_incidents"]
        return scratch.stored(incidents(self["merged"], self["clusters"], self["bridge"], self.events), "incidents")


def correlated(events: DataFrame, chosen: Iterable[rules.Rule] = rules.RULES, policy: suppression.Policy = suppression.Policy()) -> Mapping[str, DataFrame]:
    """The whole way from eligible featured events (stored) to incidents: tables raw, merged, bridge, clusters, incidents (overlapping ones merged), absorbed;
    first_clusters, first_incidents, named and held before those are merged. A table is made when it is asked for."""
    return Tables(events, list(chosen), policy)
