"""Which signals are suppressed and why: late resets of established services, and lists of allowed rules, sources, destinations and pairs.

Defined cases: blocks that are no IPv4 block, or all addresses, are left out; a signal whose entity is no address has no source; a signal
without events has no targets. Of several reasons the first in this order counts: reset, rule, source, then destination or pair of the least target.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ports whose replies come late, where ephemeral ports begin, and the reason's name.
LATE_PORTS, EPHEMERAL, LATE_EVENTS, LATE = (22, 53, 80, 443, 993, 995), 32_768, 2, "late_rst_from_established_service"


@dataclass(frozen=True)
class Policy:
    """Short lists of settings; blocks in CIDR form."""

    rules: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    destinations: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()


def within(number: Column, block: str) -> Column:
    """Whether an IPv4 address (as a number) is in the block; never, where the block is ``refused``."""
    if refused((block,)):
        return F.lit(False)
    net = ipaddress.IPv4Network(block, strict=False)
    return F.coalesce(number.between(int(net.network_address), int(net.broadcast_address)), F.lit(False))


def refused(blocks: tuple[str, ...]) -> list[str]:
    """Those of the blocks that no test can use: no IPv4 blocks, or all addresses."""
    out = []
    for block in blocks:
        try:
            usable = ipaddress.IPv4Network(block, strict=False).prefixlen > 0
        except ValueError:
            usable = False
        out += [] if usable else [block]
    return out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for x in tests:
        out = out | x
    return out


def number(ip: Column) -> Column:
    """An IPv4 address as a number; null of other text."""
    parts = F.split(ip, "[.]")
    value = F.get(parts, F.lit(0)).try_cast("long") * (1 << 24) + F.get(parts, F.lit(1)).try_cast("long") * (1 << 16) + F.get(parts, F.lit(2)).try_cast("long") * 256 + F.get(parts, F.lit(3)).try_cast("long")
    part = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.when(ip.rlike(f"^{part}([.]{part}){{3}}$"), value)


def is_late_reset() -> Column:
    """Whether an event is the reset of a service's closed connection."""
    named = lambda c: F.coalesce(F.lower(F.trim(c)) == "blocked by spi", F.lit(False))
    return (named("action_reason") | named("action")) & (F.col("blocked") | named("action")) & F.coalesce(F.col("src_port").isin(*LATE_PORTS) & (F.col("dst_port") >= EPHEMERAL) & F.col("tcp_flags").isin("RST", "RST,ACK"), F.lit(False))


def window_marks(policy: Policy) -> dict[str, Column]:
    """What a signal has to count of its events (rules.evaluate_all), so that ``window_reason`` tells without looking at them again."""
    to, of = F.col("tgt_v4"), F.col("entity_v4")  # numbers that the features have: no address is read again for each rule
    return {"late": F.col("late_reset"), "to": _any([within(to, b) for b in policy.destinations]), "pair": _any([within(of, a) & within(to, b) for a, b in policy.pairs])}


def window_reason(policy: Policy) -> Column:
    """Why a raw signal with the counts of ``window_marks`` is suppressed, or null; the first reason counts."""
    late = (F.col("rule") == "spi_anomaly_burst") & (F.col("n_late") == F.col("n")) & (F.col("n") >= LATE_EVENTS) & (F.col("p") == F.col("n")) & (F.col("q") == 1) & (F.col("t") == 1)
    source = _any([within(number(F.col("entity")), b) for b in policy.sources])
    return F.when(late, LATE).when(F.col("rule").isin(*policy.rules), "rule").when(source, "source").when(F.col("n_to") > 0, "destination").when(F.col("n_pair") > 0, "pair")


def late_resets(signals: DataFrame, rows: DataFrame) -> DataFrame:
    """(signal_id) of inspection bursts that are only resets of one service's closed connections. rows: (signal_id, event columns)."""
    own = rows.join(signals.where("rule = 'spi_anomaly_burst'").select("signal_id"), "signal_id", "left_semi").dropDuplicates(["signal_id", "event_id"])
    one = own.groupBy("signal_id").agg(F.bool_and(is_late_reset()).alias("fits"), F.count("*").alias("n"), F.count_distinct("dst_port").alias("ports"), F.min("src_port").alias("a"), F.max("src_port").alias("z"), F.count_distinct(F.nullif("dst_ip", F.lit(""))).alias("to"))
    return one.where(f"fits AND n >= {LATE_EVENTS} AND ports = n AND a = z AND `to` = 1").select("signal_id")


def reasons(signals: DataFrame, rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(signal_id, reason) of the suppressed signals (signal_id, rule, entity). rows: (signal_id, tgt: the targets, and the event columns)."""
    own = signals.withColumn("_n", number(F.col("entity")))
    late = late_resets(signals, rows).withColumn("_late", F.lit(True))
    out = own.join(late, "signal_id", "left")
    hit = F.lit(None).cast("string")
    if policy.destinations or policy.pairs:
        to = number(F.col("tgt"))
        targets = rows.select("signal_id", "tgt").distinct().join(own.select("signal_id", "entity", "_n"), "signal_id")
        why = F.when(_any([within(to, b) for b in policy.destinations]), F.concat(F.lit("destination "), "tgt", F.lit(" is allowed"))).when(_any([within(F.col("_n"), a) & within(to, b) for a, b in policy.pairs]), F.concat(F.lit("pair "), "entity", F.lit(" -> "), "tgt", F.lit(" is allowed")))
        out = out.join(targets.withColumn("_why", why).where("_why IS NOT NULL").groupBy("signal_id").agg(F.min_by("_why", "tgt").alias("_hit")), "signal_id", "left")
        hit = F.col("_hit")
    reason = F.when(F.col("_late"), LATE).when(F.col("rule").isin(*policy.rules), F.concat(F.lit("rule "), "rule", F.lit(" is allowed"))).when(_any([within(F.col("_n"), b) for b in policy.sources]), F.concat(F.lit("source "), "entity", F.lit(" is allowed"))).otherwise(hit)
    return out.select("signal_id", reason.alias("reason")).where("reason IS NOT NULL")
