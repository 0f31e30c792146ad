"""Life of stored rows: changes of status, conflicts of identity, retention by entity, cleanup, retries.

Defined cases: null statuses have no following status and protect what hangs on them; null times are not aged; a null in either version of a
field is no conflict; repeated links and holds count once. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which status may follow which, final statuses, and days that rows of each entity are kept.
FOLLOWING = {
    "new": ("triaged", "closed", "needs_review"),
    "triaged": ("investigating", "assigned", "needs_review", "resolved", "false_positive"),
    "needs_review": ("assigned", "investigating", "triaged"),
    "assigned": ("investigating",),
    "investigating": ("confirmed", "resolved", "false_positive"),
    "confirmed": ("resolved",),
    "resolved": ("closed", "reopened"),
    "false_positive": ("closed", "reopened"),
    "closed": ("reopened",),
    "reopened": ("investigating", "assigned", "needs_review"),
}
FINAL_INCIDENTS, FINAL_JOBS = ("resolved", "closed"), ("completed",)
KEPT_DAYS = {"canonical_event": 30, "detection_signal": 90, "ingestion_job": 90, "incident": 365, "audit_event": 365}
DAY_US = 86_400_000_000


def transitions(incidents: DataFrame, requests: DataFrame) -> DataFrame:
    """(incident_id, old_status, new_status, outcome, status, version) for each request (incident_id, new_status): changed, unchanged or refused; a change
    raises the version, a null version counts as 1."""
    allowed = F.lit(False)
    for old, following in FOLLOWING.items():
        allowed = allowed | ((F.col("status") == old) & F.col("new_status").isin(*following))
    outcome = F.when(F.col("status").eqNullSafe(F.col("new_status")), "unchanged").when(allowed, "changed").otherwise("refused")
    rows = requests.select("incident_id", "new_status").join(incidents.select("incident_id", "status", "version"), "incident_id").withColumn("outcome", outcome)
    changed = F.col("outcome") == "changed"
    return rows.select(
        "incident_id", F.col("status").alias("old_status"), "new_status", "outcome", F.when(changed, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        F.when(changed, F.coalesce("version", F.lit(1)) + 1).otherwise(F.col("version")).alias("version"),
    )


def conflicts(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): ids that come again with another value in a field that both have, and the names of such fields."""
    left = existing.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields])
    differ = [F.when(F.col(f"_old_{f}") != F.col(f), F.lit(f)) for f in fields]
    return left.join(incoming.select(key, *fields), key).select(key, F.array_join(F.array_compact(F.array(*differ)), ",").alias("fields")).where("fields <> ''")


def source_offset(events: DataFrame, key: str, offset: str) -> DataFrame:
    """(key, offset): the one offset of all events of the key that name one; null if they name several or an impossible one."""
    told = events.groupBy(key).agg(F.min(offset).alias("a"), F.max(offset).alias("z"))
    valid = F.col("a").rlike(r"^[+-]([01][0-9]|2[0-3]):[0-5][0-9]$")
    return told.select(key, F.when((F.col("a") == F.col("z")) & valid, F.col("a")).alias("offset"))


def retention(rows: DataFrame, entity: str, key: str, time: str, as_of_us: int, holds: DataFrame, guards: list[DataFrame], status: Column | None = None) -> DataFrame:
    """(entity, id, candidate, protected, held) of the aged rows. ``guards`` are tables with one column of ids that open rows protect; ``status`` tells
    whether a row's own status is final; ``holds`` has entity, id, released_us and until_us."""
    aged = rows.where(F.col(time) < as_of_us - KEPT_DAYS[entity] * DAY_US)
    out = aged.select(F.col(key).alias("id"), (F.lit(True) if status is None else F.coalesce(status, F.lit(False))).alias("final"))
    kept = holds.where((F.col("entity") == entity) & F.col("released_us").isNull() & (F.col("until_us").isNull() | (F.col("until_us") > as_of_us)))
    out = out.join(kept.select("id", F.lit(True).alias("on_hold")).distinct(), "id", "left")
    guarded = F.lit(False)
    for n, guard in enumerate(guards):
        out = out.join(guard.toDF("id").where("id IS NOT NULL").distinct().withColumn(f"guard_{n}", F.lit(True)), "id", "left")
        guarded = guarded | F.col(f"guard_{n}").isNotNull()
    held = F.col("on_hold").isNotNull()
    return out.select(F.lit(entity).alias("entity"), "id", (F.col("final") & ~guarded & ~held).alias("candidate"), (~F.col("final") | guarded).alias("protected"), (F.col("final") & held).alias("held"))


def cleanup(asked: DataFrame, existing: DataFrame, candidates: DataFrame, archived: DataFrame, referring: DataFrame) -> DataFrame:
    """(id, verdict) of ids that are asked for: missing, not_eligible, not_archived, referenced or delete. Each table has a column id."""
    out = asked.select("id").distinct()
    for name, table in (("is_there", existing), ("eligible", candidates), ("safe", archived), ("named", referring)):
        out = out.join(table.select("id", F.lit(True).alias(name)).distinct(), "id", "left")
    absent = lambda name: F.col(name).isNull()
    verdict = F.when(absent("is_there"), "missing").when(absent("eligible"), "not_eligible").when(absent("safe"), "not_archived").when(~absent("named"), "referenced").otherwise("delete")
    return out.select("id", verdict.alias("verdict"))


def retry_delay(attempts: Column, base_s: int = 30, most_s: int = 3600) -> Column:
    """Seconds before the next attempt: doubled after each, up to a bound."""
    return F.least(F.lit(float(base_s)) * F.pow(F.lit(2.0), attempts - 1), F.lit(float(most_s))).cast("long")
