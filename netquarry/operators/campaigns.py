"""Campaigns over several jobs: each job's incidents meet the state that earlier jobs left under the same correlation key.

An arrival has key, job (its place in the order of arrivals, with arrival_id for ties), version, first_us, last_us, now_us and alive (whether the
state's incident still exists). Its decision is one of
  repair          there is a state, but its incident is gone: a new campaign begins
  new_generation  another version, an expired state, or a burst later than the campaign's extent and the window: a new campaign begins
  stale           a malformed extent, or one that ends before the campaign's and the window: the campaign stays as it is
  merge           anything else: the campaign's extent grows
and ``first`` where there is no state. Deciding needs the state before, so arrivals of a key are taken in their order: by one sort, streamed in
batches, with one row of state in memory. A key is a sequence by definition; its rows are incidents, not events.

Defined cases: arrivals without key or extent are left out; a null version equals a null version; a null alive counts as true; equal (job,
arrival_id) are taken in order of their extents. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_US, TTL_US = 3_600_000_000, 7_200_000_000
ARRIVAL = ("key", "job", "arrival_id", "version", "first_us", "last_us", "now_us", "alive")
DECIDED = "key string, job long, arrival_id string, decision string, generation long, campaign_first_us long, campaign_last_us long"


class State(NamedTuple):
    version: str | None
    generation: int
    first_us: int
    last_us: int
    expires_us: int


class Arrival(NamedTuple):
    version: str | None
    first_us: int
    last_us: int
    now_us: int
    alive: bool


def decide(state: State | None, a: Arrival, window_us: int) -> str:
    if state is None:
        return "first"
    if not a.alive:
        return "repair"
    if state.version != a.version or state.expires_us <= a.now_us:
        return "new_generation"
    if a.first_us > a.last_us:
        return "stale"
    if a.first_us > state.last_us + window_us:
        return "new_generation"
    return "stale" if a.last_us < state.first_us - window_us else "merge"


def advance(state: State | None, a: Arrival, decision: str, ttl_us: int) -> State:
    """The state after an arrival."""
    if decision == "stale":
        return state
    if decision == "merge":
        return State(state.version, state.generation, min(state.first_us, a.first_us), max(state.last_us, a.last_us), a.now_us + ttl_us)
    return State(a.version, state.generation + 1 if state else 1, a.first_us, a.last_us, a.now_us + ttl_us)


def text_or_none(value) -> str | None:
    return None if value is None or value != value else str(value)


def step(state: State | None, row, window_us: int, ttl_us: int) -> tuple[State, tuple]:
    """The next state, and the row of ``DECIDED`` but for the key."""
    a = Arrival(text_or_none(row.version), int(row.first_us), int(row.last_us), int(row.now_us), bool(row.alive))
    decision = decide(state, a, window_us)
    state = advance(state, a, decision, ttl_us)
    return state, (int(row.job), row.arrival_id, decision, state.generation, state.first_us, state.last_us)


def usable(arrivals: DataFrame) -> DataFrame:
    known = arrivals.where("key IS NOT NULL AND job IS NOT NULL AND first_us IS NOT NULL AND last_us IS NOT NULL AND now_us IS NOT NULL")
    return known.select(*[F.coalesce("alive", F.lit(True)).alias("alive") if c == "alive" else F.coalesce("arrival_id", F.lit("")).alias(c) if c == "arrival_id" else c for c in ARRIVAL])


def replay(arrivals: DataFrame, window_us: int = WINDOW_US, ttl_us: int = TTL_US) -> DataFrame:
    """The decision for each arrival, and the campaign's extent and generation after it."""

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.key != key:
                    key, state = row.key, None
                state, said = step(state, row, window_us, ttl_us)
                out.append((key, *said))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DECIDED.split(", ")])

    ordered = usable(arrivals).repartition("key").sortWithinPartitions("key", "job", "arrival_id", "first_us", "last_us")
    return ordered.mapInPandas(taken, DECIDED)


def provenance(decided: DataFrame, n_events: DataFrame) -> DataFrame:
    """(key, generation, n_jobs, current_events, prior_events): where the events of campaigns come from. ``n_events`` is (key, job, n); stale arrivals add
    nothing. The current job is the campaign's last."""
    took = decided.where("decision <> 'stale'").select("key", "generation", "job").distinct().join(n_events.groupBy("key", "job").agg(F.sum("n").alias("n")), ["key", "job"])
    whole = took.groupBy("key", "generation").agg(F.count("*").alias("n_jobs"), F.sum("n").alias("all"), F.max_by("n", "job").alias("current_events"))
    return whole.select("key", "generation", "n_jobs", "current_events", (F.col("all") - F.col("current_events")).alias("prior_events"))
