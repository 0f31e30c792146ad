"""Which events belong to one flow, seen from either side and through address translation, and what context incidents get by it.

Two events are related if their protocols don't differ (an unknown one fits all), they name the same two ends in either direction
(an original or a translated destination will do), and both name the same two ports in either direction, or a common service; or, in
opposite directions, the same well-known port at the same end; or neither has any port. Each of these reasons is an equality of
keys, so events meet by an equi-join on relation keys, and no two events of an incident are compared for their own sake.

Defined cases: null and empty addresses are no ends; events without both ends are related to nothing. A flow from an address to itself is
answered only by a common pair of ports or service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.features import SERVICES

SECONDS, MOST_CONTEXT = 300, 50
HOUR = 3_600_000_000


def _service(port: Column) -> Column:
    """The service of a port; null of none. A constant map, as the ports come from lambdas, where long conditions are slow."""
    return F.expr(f"map_from_entries(array({', '.join(f'struct({p} AS k, {chr(39)}{name}{chr(39)} AS v)' for name, ports in SERVICES.items() for p in ports)}))")[port]


def _some(*values: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*values)))


def _pairs(a: Column, b: Column, ordered: bool) -> Column:
    """All 'x y' with x of a and y of b; without order the lesser one first."""
    one = lambda x, y: F.concat_ws(" ", x, y) if ordered else F.concat_ws(" ", F.least(x, y), F.greatest(x, y))
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: one(x, y))))


def relation_keys() -> Column:
    """The keys of an event with src_ip, src_port, dst_ip, dst_port, translated_dst_ip and translated_dst_port. Two events that share one are related,
    but for their protocols (see reverse_keys for one more reason)."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    src, dst = _some(text("src_ip")), _some(text("dst_ip"), text("translated_dst_ip"))
    sport, dport = _some(F.col("src_port")), _some(F.col("dst_port"), F.col("translated_dst_port"))
    named = lambda ports: F.array_compact(F.transform(ports, lambda p: _service(p)))
    ends = F.array_distinct(_pairs(src, dst, ordered=False))
    reasons = F.array_distinct(F.concat(
        F.transform(_pairs(sport.cast("array<string>"), dport.cast("array<string>"), ordered=False), lambda x: F.concat(F.lit("ports "), x)),
        F.transform(named(F.array_union(sport, dport)), lambda x: F.concat(F.lit("service "), x)),
        F.when(F.size(sport) + F.size(dport) == 0, F.array(F.lit("no ports"))).otherwise(F.array().cast("array<string>")),
    ))
    return F.array_distinct(_pairs(ends, reasons, ordered=True))


def reverse_keys(other: bool) -> Column:
    """The keys by which an event meets one in the opposite direction that has the same well-known port at the same end: server, client, port. ``other``:
    of the event at the other side, whose server is its source."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    src, dst = _some(text("src_ip")), _some(text("dst_ip"), text("translated_dst_ip"))
    known = lambda ports: F.filter(ports, lambda p: (p < 1024) | _service(p).isNotNull()).cast("array<string>")
    ports = known(_some(F.col("src_port"))) if other else known(_some(F.col("dst_port"), F.col("translated_dst_port")))
    return F.array_distinct(_pairs(_pairs(src, dst, True) if other else _pairs(dst, src, True), ports, True))


_ENDS = ("src_ip", "src_port", "dst_ip", "dst_port", "translated_dst_ip", "translated_dst_port", "protocol")


def _keyed(rows: DataFrame, reference: bool, keep: list[str]) -> DataFrame:
    """One row for each relation key. A port of the one's destination meets the other's source and the other way round, so each side has both kinds."""
    tag = lambda keys, mark: F.transform(keys, lambda k: F.concat(F.lit(mark), k))
    first, second = ("> ", "< ") if reference else ("< ", "> ")
    keys = F.concat(relation_keys(), tag(reverse_keys(False), first), tag(reverse_keys(True), second))
    return rows.select(*keep, F.nullif(F.upper("protocol"), F.lit("")).alias("_p"), F.explode(F.array_distinct(keys)).alias("_key"))


def _by_protocol(keyed: DataFrame, reference: bool, unknown: bool = True) -> DataFrame:
    """Keys with protocols, so that what fits is equal: a known protocol asks for its own and for unknown ones, an unknown one for all. unknown: whether
    the other side has unknown protocols; where it has none, nobody needs to ask for them, or to answer them."""
    known, any_, none = F.concat_ws(" ", "_key", "_p"), F.concat("_key", F.lit(" *")), F.concat("_key", F.lit(" ?"))
    if reference:
        keys = F.when(F.col("_p").isNull(), F.array(any_)).otherwise(F.array(known, none) if unknown else F.array(known))
    else:
        own = F.when(F.col("_p").isNull(), none).otherwise(known)
        keys = F.array(own, any_) if unknown else F.array(own)
    return keyed.withColumn("_key", F.explode(keys)).drop("_p")


def _unknown(rows: DataFrame) -> bool:
    return not rows.where(F.coalesce("protocol", F.lit("")) == "").isEmpty()


def context(incident_events: DataFrame, candidates: DataFrame, seconds: int = SECONDS, most: int = MOST_CONTEXT) -> DataFrame:
    """(incident_id, event_id, ts_us, place): the candidates that are related to an event of the incident, within ``seconds`` of its extent, and no events of it: the first ``most``.

    An incident's events meet in one task and are reduced to their distinct keys there, before anything is shuffled by key. Candidates are numbered by time within (key, hour), and an incident
    takes from its own beginning on as many numbers as it may need: ``most``, and one for each of its own events there. So a busy flow adds as many rows to an incident as that, however many
    events it has. Incidents and candidates are shuffled by (key, hour) once, and meet there."""
    hour = lambda c: F.expr(f"({c} - pmod({c}, {HOUR})) div {HOUR}")
    mine = incident_events.select("incident_id", "ts_us", *_ENDS).repartition("incident_id")
    extent = mine.groupBy("incident_id").agg(F.expr(f"min(ts_us) - {seconds}000000L").alias("_a"), F.expr(f"max(ts_us) + {seconds}000000L").alias("_b"))
    asking, answering = _unknown(incident_events), _unknown(candidates)
    ends = mine.groupBy("incident_id", *_ENDS).agg(F.lit(0).alias("_x")).drop("_x")
    asked = _by_protocol(_keyed(ends, True, ["incident_id"]), True, answering).join(extent, "incident_id")
    asked = asked.select("incident_id", "_key", F.explode(F.sequence(hour("_a"), hour("_b"))).alias("_hour"), "_a", "_b", F.lit(0).cast("long").alias("_own"))
    own = mine.where("ts_us IS NOT NULL").withColumn("_hour", hour("ts_us")).groupBy("incident_id", "_hour", *_ENDS).agg(F.count("*").alias("_own"))
    own = _by_protocol(_keyed(own, False, ["incident_id", "_hour", "_own"]), False, asking)
    none = F.lit(None).cast("long")
    own = own.select("incident_id", "_key", "_hour", none.alias("_a"), none.alias("_b"), "_own")
    probes = asked.unionByName(own).groupBy("incident_id", "_key", "_hour").agg(F.max("_a").alias("ts_us"), F.max("_b").alias("_b"), F.sum("_own").alias("_own")).where("ts_us IS NOT NULL")
    told = _by_protocol(_keyed(candidates.where("ts_us IS NOT NULL"), False, ["event_id", "ts_us"]), False, asking).withColumn("_hour", hour("ts_us"))
    line = told.withColumn("_is", F.lit(1)).unionByName(probes.withColumn("_is", F.lit(0)), allowMissingColumns=True)
    key = W.partitionBy("_key", "_hour")
    order = key.orderBy("ts_us", "_is", "event_id")
    again = (F.lag("event_id").over(order) == F.col("event_id")) & (F.lag("ts_us").over(order) == F.col("ts_us"))
    line = line.withColumn("_new", F.when(F.coalesce(again, F.lit(False)), 0).otherwise(F.col("_is")))
    line = line.withColumns({"_no": F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_new").over(key)})
    until = F.least(F.col("_no") + most + F.col("_own"), F.col("_all"))
    numbers = F.when(F.col("_is") == 1, F.array("_no")).otherwise(F.sequence(F.col("_no") + 1, until))
    met = line.where("_new = 1 OR (_is = 0 AND _no < _all)").select("_key", "_hour", "_is", "incident_id", "_b", F.when(F.col("_is") == 1, F.struct("event_id", "ts_us")).alias("_event"), F.explode(numbers).alias("_no"))
    at = W.partitionBy("_key", "_hour", "_no").orderBy(F.desc("_is")).rowsBetween(W.unboundedPreceding, 0)  # the candidate of that number, then those that want it
    met = met.withColumn("_event", F.first("_event", ignorenulls=True).over(at)).where("_is = 0 AND _event.ts_us <= _b")
    found = met.select("incident_id", "_event.event_id", "_event.ts_us").distinct()
    found = found.join(incident_events.select("incident_id", "event_id"), ["incident_id", "event_id"], "left_anti")
    return found.withColumn("place", F.row_number().over(W.partitionBy("incident_id").orderBy("ts_us", "event_id"))).where(F.col("place") <= most)


def answered(incident_events: DataFrame) -> DataFrame:
    """(incident_id) of incidents that have two related events (event_id, each once): counts by (key, protocol), no pairs."""
    rows = incident_events.dropDuplicates(["incident_id", "event_id"])
    same = rows.select("incident_id", F.nullif(F.upper("protocol"), F.lit("")).alias("_p"), F.lit(0).alias("_side"), F.explode(relation_keys()).alias("_key"))
    apart = rows.where("src_ip <> coalesce(dst_ip, '') AND src_ip <> coalesce(translated_dst_ip, '')")
    sides = [apart.select("incident_id", F.nullif(F.upper("protocol"), F.lit("")).alias("_p"), F.lit(1 + i).alias("_side"), F.explode(F.transform(reverse_keys(bool(i)), lambda k: F.concat(F.lit("> "), k))).alias("_key")) for i in (0, 1)]
    each = same.unionByName(sides[0]).unionByName(sides[1]).groupBy("incident_id", "_key", "_p").agg(*[F.count_if(F.col("_side") == i).alias(f"_{i}") for i in (0, 1, 2)])
    one = each.groupBy("incident_id", "_key").agg(
        F.max("_0").alias("most"), F.sum("_0").alias("all"), F.sum(F.when(F.col("_p").isNull(), F.col("_0")).otherwise(0)).alias("any"),
        F.bool_or((F.col("_1") > 0) & (F.col("_2") > 0)).alias("both"), F.sum("_1").alias("to"), F.sum("_2").alias("back"),
        F.sum(F.when(F.col("_p").isNull(), F.col("_1")).otherwise(0)).alias("any_to"), F.sum(F.when(F.col("_p").isNull(), F.col("_2")).otherwise(0)).alias("any_back"),
    )
    return one.where("most >= 2 OR (any >= 1 AND all >= 2) OR both OR (to > 0 AND back > 0 AND any_to + any_back > 0)").select("incident_id").distinct()
