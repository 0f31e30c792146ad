"""The bounded account of a campaign over several jobs: what merging one job's incident into it changes.

A bundle keeps its type, family, owner and place in the order of precedence, severity, confidence, numbers of events and signals, extent, and at most
EVIDENCE events as evidence: the first of either side has a slot, the others are taken in order. A better-placed incoming type takes over only if the arrival
tells that all members' signals are present (complete); severity and confidence rise only then too. So the state of a key is one row of bounded size,
whatever its campaign has seen, and merging is the same in batch and in a stream.

An arrival is one of campaigns.ARRIVAL with type, family, entity, place (lower is stronger), severity, confidence, n_events, n_signals, evidence and complete.
A key that was expired for ``forget_us`` is forgotten, as if it had never been; a stream then drops its state.

Defined cases: those of campaigns; null evidence is none, null numbers are 0, a null complete is false, a null place is the weakest, a null severity the lowest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import campaigns

EVIDENCE, WEAKEST = 10, 1 << 30
SEVERITY = ("informational", "low", "medium", "high", "critical")
COLUMNS = ("type", "family", "entity", "place", "severity", "confidence", "n_events", "n_signals", "evidence", "complete")
MERGED = (
    "key string, job long, arrival_id string, decision string, generation long, first_us long, last_us long, type string, family string, entity string, place long, severity string, confidence double, "
    "n_events long, n_signals long, evidence string, promoted boolean, changes string"
)


class Bundle(NamedTuple):
    type: str | None
    family: str | None
    entity: str | None
    place: int
    severity: str
    confidence: float
    n_events: int
    n_signals: int
    evidence: tuple[str, ...]


def merged_evidence(ours: tuple[str, ...], theirs: tuple[str, ...]) -> tuple[str, ...]:
    """At most EVIDENCE of both in order, the first of each side among them."""
    every = sorted({*ours, *theirs})
    kept = {min(x) for x in (ours, theirs) if x}
    for x in every:
        if len(kept) >= EVIDENCE:
            break
        kept.add(x)
    return tuple(sorted(kept))


def merged(ours: Bundle, theirs: Bundle, complete: bool) -> tuple[Bundle, bool, list[str]]:
    """The bundle after a merge, whether the incoming identity took over, and what changed."""
    promoted = complete and theirs.place < ours.place and (theirs.type, theirs.family, theirs.entity) != (ours.type, ours.family, ours.entity)
    lead = theirs if complete and theirs.place < ours.place else ours
    severity = SEVERITY[max(SEVERITY.index(ours.severity), SEVERITY.index(theirs.severity) if complete else 0)]
    confidence = max(ours.confidence, theirs.confidence) if complete else ours.confidence
    out = Bundle(lead.type, lead.family, lead.entity, lead.place, severity, confidence, ours.n_events + theirs.n_events, ours.n_signals + theirs.n_signals, merged_evidence(ours.evidence, theirs.evidence))
    changes = {"events_added": theirs.n_events > 0, "signals_added": theirs.n_signals > 0, "severity_increased": severity != ours.severity, "confidence_changed": confidence != ours.confidence, "primary_identity_promoted": promoted}
    return out, promoted, [k for k, v in changes.items() if v]


def _bundle(row) -> Bundle:
    known = lambda x: None if x is None or x != x else x
    evidence = () if row.evidence is None else tuple(sorted({str(x) for x in row.evidence}))[:EVIDENCE]
    return Bundle(campaigns.text_or_none(row.type), campaigns.text_or_none(row.family), campaigns.text_or_none(row.entity), int(row.place), row.severity, float(row.confidence), int(row.n_events), int(row.n_signals), evidence)


def step(state: tuple[campaigns.State, Bundle] | None, row, window_us: int, ttl_us: int, forget_us: int | None) -> tuple[tuple[campaigns.State, Bundle], tuple]:
    """The next state of a key, and the row of ``MERGED`` but for the key."""
    if state is not None and forget_us is not None and int(row.now_us) >= state[0].expires_us + forget_us:
        state = None
    before, held = state or (None, None)
    after, said = campaigns.step(before, row, window_us, ttl_us)
    theirs, promoted, changes = _bundle(row), False, []
    if said[2] == "merge":
        held, promoted, changes = merged(held, theirs, bool(row.complete))
        changes += ["time_window_extended"] * ((after.first_us, after.last_us) != (before.first_us, before.last_us))
    elif said[2] != "stale":
        held = theirs
    return (after, held), (*said, *held[:8], ",".join(held.evidence), promoted, ",".join(changes))


def usable(arrivals: DataFrame) -> DataFrame:
    """Arrivals that have a key and an extent, with defaults for what is null."""
    filled = {"place": F.coalesce("place", F.lit(WEAKEST)).cast("long"), "confidence": F.coalesce("confidence", F.lit(0.0)), "n_events": F.coalesce("n_events", F.lit(0)).cast("long"), "n_signals": F.coalesce("n_signals", F.lit(0)).cast("long"),
              "complete": F.coalesce("complete", F.lit(False)), "severity": F.when(F.col("severity").isin(*SEVERITY), F.col("severity")).otherwise(SEVERITY[0])}
    known = arrivals.where("key IS NOT NULL AND job IS NOT NULL AND first_us IS NOT NULL AND last_us IS NOT NULL AND now_us IS NOT NULL")
    return known.withColumns({**filled, "alive": F.coalesce("alive", F.lit(True)), "arrival_id": F.coalesce("arrival_id", F.lit(""))}).select(*campaigns.ARRIVAL, *COLUMNS)


ORDER = ("job", "arrival_id", "first_us", "last_us")


def replay(arrivals: DataFrame, window_us: int = campaigns.WINDOW_US, ttl_us: int = campaigns.TTL_US, forget_us: int | None = None) -> DataFrame:
    """What each arrival makes of its campaign (MERGED): one sort, streamed with one row of state in memory."""

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.key != key:
                    key, state = row.key, None
                state, said = step(state, row, window_us, ttl_us, forget_us)
                out.append((key, *said))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MERGED.split(", ")])

    return usable(arrivals).repartition("key").sortWithinPartitions("key", *ORDER).mapInPandas(taken, MERGED)
