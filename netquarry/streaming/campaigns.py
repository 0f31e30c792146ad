"""Campaigns and event windows as Structured Streaming queries.

State of a campaign is the state store's, one row a key, and survives a restart from the query's checkpoint. Rows of one key that come in one
trigger are taken in order of (job, arrival_id); how many that can be is bounded by what a trigger reads (``maxFilesPerTrigger`` of the source).
Merged campaigns forget keys: arrivals' own clock, less ``late``, is the watermark, and when it has passed a state's expiry by ``forget_us`` the state goes. Triggers must
come in order of that clock, which begins after the epoch; arrivals that are later than ``late`` are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import bundles, campaigns
from ..operators.scratch import folder

_STATE = "version string, generation long, first_us long, last_us long, expires_us long"
_BUNDLE = "type string, family string, entity string, place long, severity string, confidence double, n_events long, n_signals long, evidence string"


def decisions(arrivals: DataFrame, window_us: int = campaigns.WINDOW_US, ttl_us: int = campaigns.TTL_US) -> DataFrame:
    """A stream of arrivals to a stream of their decisions, as ``campaigns.replay`` gives them for a table."""

    def taken(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = campaigns.State(*held.get) if held.exists else None
        if state is not None:
            state = state._replace(version=campaigns.text_or_none(state.version))
        rows = pd.concat(batches).sort_values(["job", "arrival_id", "first_us", "last_us"])
        out = []
        for row in rows.itertuples(index=False):
            state, said = campaigns.step(state, row, window_us, ttl_us)
            out.append((key[0], *said))
        held.update(tuple(state))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in campaigns.DECIDED.split(", ")])

    return campaigns.usable(arrivals).groupBy("key").applyInPandasWithState(taken, campaigns.DECIDED, _STATE, "append", GroupStateTimeout.NoTimeout)


def merged(arrivals: DataFrame, window_us: int = campaigns.WINDOW_US, ttl_us: int = campaigns.TTL_US, forget_us: int = campaigns.TTL_US, late: str = "60 seconds") -> DataFrame:
    """A stream of arrivals to a stream of what each makes of its campaign, as ``bundles.replay`` gives it for a table."""

    def taken(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in bundles.MERGED.split(", ")]
        if held.hasTimedOut:
            held.remove()
            return
        state = None
        if held.exists:
            x = [campaigns.text_or_none(v) if i in (0, 5, 6, 7) else v for i, v in enumerate(held.get)]
            state = campaigns.State(*x[:5]), bundles.Bundle(*x[5:13], tuple(x[13].split(",")) if x[13] else ())
        out = []
        for row in pd.concat(batches).sort_values(list(bundles.ORDER)).itertuples(index=False):
            state, said = bundles.step(state, row, window_us, ttl_us, forget_us)
            out.append((key[0], *said))
        held.update((*state[0], *state[1][:8], ",".join(state[1].evidence)))
        # a time-out must lie beyond the watermark; a state that is forgotten already goes with the next one
        held.setTimeoutTimestamp(max((state[0].expires_us + forget_us + 999) // 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    known = bundles.usable(arrivals).withColumn("at", F.timestamp_micros("now_us")).withWatermark("at", late)
    return known.groupBy("key").applyInPandasWithState(taken, bundles.MERGED, f"{_STATE}, {_BUNDLE}", "append", GroupStateTimeout.EventTimeTimeout)


def counted(events: DataFrame, time: str, keys: list[str], blocked: Column, width: str = "60 seconds", late: str = "120 seconds") -> DataFrame:
    """Events and blocked events of each key and window of time; a window is given out once, when the watermark has passed its end."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return rows.agg(F.count("*").alias("n"), F.count_if(blocked).alias("n_blocked")).select(*keys, F.unix_micros("w.start").alias("start_us"), "n", "n_blocked")


def run_available(stream: DataFrame, name: str, timeout_s: int = 3600) -> DataFrame:
    """Runs a stream over all that its source holds now, appends its rows to a table in the shared folder, and reads that table."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream {name} took over {timeout_s} s")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
