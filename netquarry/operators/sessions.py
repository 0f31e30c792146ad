"""Detectors over single messages and short stretches of one source: port sweeps, floods, ordinary web traffic, ordinary logins, text search.

Windows look forward from an event. Rows go to their own stretch of time and to the one before it, (key, stretch) is the shuffle key, so a
busy source is split by time, exactly; totals of windows are running sums over one sort, however many events a window holds.

Defined cases: rows without a time or without the key's addresses are in no window; a port that is null or 0 is no port; equal times are
taken in the order of ``order``, which tells rows apart. Empty tables give empty results. Null messages match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What ordinary web requests ask for, and marks of attacks in messages.
BENIGN_ENDPOINTS = (r"GET /index\.html", r"GET /home", r"GET /dashboard", r"GET /favicon\.ico", r"GET /images/", r"GET /styles\.css", r"GET /api/profile")
WEB_TYPES = ("HTTP_GET", "HTTP_POST")
ATTACKS = (r"(?i)\bOR\b\s+['\"]?\d['\"]?\s*=\s*['\"]?\d", r"(?i)DROP\s+TABLE", r"(?i)UNION\s+SELECT", r"(?i)<script>", r"(?i)onerror=")
SCRIPT_LINK = r"(?i)javascript:"

MOST_SEARCH_CHARACTERS, MOST_SEARCH_RESULTS = 100, 10


def _stretches(df: DataFrame, time: str, span: int) -> DataFrame:
    """Each row in its own stretch (own = true) and in the one before, whose windows reach into it."""
    at = F.floor(F.col(time) / span).cast("long")
    both = F.array(F.struct(at.alias("stretch"), F.lit(True).alias("own")), F.struct((at - 1).alias("stretch"), F.lit(False).alias("own")))
    return df.withColumn("_s", F.explode(both)).select("*", "_s.stretch", "_s.own").drop("_s")


def first_port_sweep(events: DataFrame, span: int = 300_000_000, least: int = 3) -> DataFrame:
    """(src_ip, start_us, event_id): of each source, the blocked events of its first window of ``span`` with at least ``least`` ports.

    A port is in the windows that begin up to ``span`` before one of its events: such intervals open and close, and their running number is the
    number of ports of the window that begins there."""
    blocks = events.where("blocked_legacy AND src_ip IS NOT NULL AND ts_us IS NOT NULL")
    rows = _stretches(blocks.select("src_ip", "ts_us", F.when(F.col("dst_port") != 0, F.col("dst_port")).alias("port")), "ts_us", span)
    rows = rows.repartition("src_ip", "stretch")  # serves both windows
    same = W.partitionBy("src_ip", "stretch", "port").orderBy("ts_us")
    rows = rows.select("*", F.lag("ts_us").over(same).alias("before"), F.lead("ts_us").over(same).alias("after"))
    opens = F.col("port").isNotNull() & (F.col("before").isNull() | (F.col("ts_us") - F.col("before") > span))
    closes = F.col("port").isNotNull() & (F.col("after").isNull() | (F.col("after") - F.col("ts_us") > span))
    mark = lambda at, place, change: F.struct(at.alias("at"), F.lit(place).alias("place"), F.lit(change).alias("change"))
    t = F.col("ts_us")
    marks = F.array_compact(F.array(F.when(opens, mark(t - span, 0, 1)), F.when(F.col("own"), mark(t, 1, 0)), F.when(closes, mark(t, 2, -1))))
    marks = rows.select("src_ip", "stretch", F.explode(marks).alias("m")).select("src_ip", "stretch", "m.*")
    running = F.sum("change").over(W.partitionBy("src_ip", "stretch").orderBy("at", "place").rowsBetween(W.unboundedPreceding, 0))
    starts = marks.withColumn("ports", running).where((F.col("place") == 1) & (F.col("ports") >= least)).groupBy("src_ip").agg(F.min("at").alias("start_us"))
    within = (F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") <= F.col("start_us") + span)
    return blocks.select("src_ip", "ts_us", "event_id").join(starts, "src_ip").where(within).select("src_ip", "start_us", "event_id")


def first_flood(events: DataFrame, span: int = 60_000_000, least: int = 100, share: float = 0.8, order: str = "event_no") -> DataFrame:
    """(src_ip, dst_ip, start_us, n, n_blocked): of each pair, the first window of ``span`` with at least ``least`` events, over ``share`` of them blocked."""
    known = events.where("coalesce(src_ip, '') <> '' AND coalesce(dst_ip, '') <> '' AND ts_us IS NOT NULL")
    rows = _stretches(known.select("src_ip", "dst_ip", "ts_us", F.col(order).alias("order"), F.coalesce(F.col("blocked_legacy"), F.lit(False)).cast("long").alias("b")), "ts_us", span)
    event = F.struct(F.col("ts_us").alias("at"), F.lit(0).alias("place"), F.lit(1).alias("one"), F.col("b").alias("blocked"))
    end = F.struct((F.col("ts_us") + span).alias("at"), F.lit(1).alias("place"), F.lit(0).alias("one"), F.lit(0).cast("long").alias("blocked"))
    marks = rows.withColumn("m", F.explode(F.array_compact(F.array(event, F.when(F.col("own"), end))))).select("src_ip", "dst_ip", "stretch", "ts_us", "order", "own", "b", "m.*")
    so_far = W.partitionBy("src_ip", "dst_ip", "stretch").orderBy("at", "place", "order").rowsBetween(W.unboundedPreceding, 0)
    marks = marks.select("*", F.sum("one").over(so_far).alias("n"), F.sum("blocked").over(so_far).alias("nb")).where("own")
    start = F.col("place") == 0  # an event's own place in the order, and that of its window's end, meet by the keys that are together already
    both = marks.groupBy("src_ip", "dst_ip", "stretch", "ts_us", "order").agg(
        (F.max(F.when(~start, F.col("n"))) - F.min(F.when(start, F.col("n"))) + 1).alias("n"),
        (F.max(F.when(~start, F.col("nb"))) - F.min(F.when(start, F.col("nb") - F.col("blocked")))).alias("n_blocked"),
    )
    found = both.where((F.col("n") >= least) & (F.col("n_blocked") / F.col("n") > share))
    first = F.min_by(F.struct("ts_us", "n", "n_blocked"), F.struct("ts_us", "order")).alias("f")
    return found.groupBy("src_ip", "dst_ip").agg(first).select("src_ip", "dst_ip", F.col("f.ts_us").alias("start_us"), "f.n", "f.n_blocked")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return F.coalesce(found, F.lit(False))


def benign_web(events: DataFrame, batch: str, kind: str = "event_type", text: str = "message") -> DataFrame:
    """Rows of ordinary web traffic: successful requests of known endpoints without marks of attacks, of batches that hold nothing but web requests."""
    others = events.where(F.col(kind).isNotNull() & ~F.col(kind).isin(*WEB_TYPES)).select(F.col(batch).alias("_batch")).distinct()
    t = F.col(text)
    good = F.lower(t).contains("200 ok") | t.rlike("HTTP/1.[01] 20[0-9]")
    rows = events.where(F.col(kind).isin(*WEB_TYPES) & good & ~t.rlike("HTTP/1.[01] (401|403|500|404)") & ~_any(t, (*ATTACKS, SCRIPT_LINK)) & _any(t, BENIGN_ENDPOINTS))
    return rows.join(others, F.col(batch).eqNullSafe(F.col("_batch")), "left_anti")


def admin_logins(events: DataFrame, private: Column, text: str = "message", span: int = 600_000_000) -> DataFrame:
    """(event_id, src_ip, kind): administrators' logins from private addresses and the views of the dashboard up to ten minutes after them.

    Of a login only the next view counts, of a view only the last login: two running values instead of pairs."""
    t = F.lower(F.col(text))
    ok = t.contains("200 ok") & ~_any(F.col(text), ATTACKS) & private
    kind = F.when(t.contains("post /login") & t.contains("user=admin"), "login").when(t.contains("get /dashboard"), "view")
    rows = events.where(ok & F.col("ts_us").isNotNull()).select("event_id", "src_ip", "ts_us", kind.alias("kind")).where("kind IS NOT NULL")
    rows = _stretches(rows, "ts_us", span)
    key = W.partitionBy("src_ip", "stretch")
    rows = rows.withColumn("next_view", F.min(F.when(F.col("kind") == "view", F.col("ts_us"))).over(key.orderBy(F.desc("ts_us")).rangeBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("last_login", F.max(F.when(F.col("kind") == "login", F.col("ts_us"))).over(key.orderBy("ts_us").rangeBetween(W.unboundedPreceding, 0)))
    login = (F.col("kind") == "login") & F.col("own") & (F.col("next_view") - F.col("ts_us") <= span)
    view = (F.col("kind") == "view") & (F.col("ts_us") - F.col("last_login") <= span)
    return rows.where(login | view).select("event_id", "src_ip", "kind").distinct()


def search_text(rows: DataFrame, query: str, columns: list[str], order: str, most: int = MOST_SEARCH_RESULTS) -> DataFrame:
    """The first rows in which any of the columns holds the query (letter case aside), and whether there are more."""
    if not 0 < len(query) <= MOST_SEARCH_CHARACTERS:
        raise ValueError(f"a query has 1 to {MOST_SEARCH_CHARACTERS} characters")
    wanted = F.lit(query.lower())
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c).cast("string")).contains(wanted), F.lit(False))
    page = rows.where(found).orderBy(order).limit(most + 1)
    place = F.row_number().over(W.orderBy(order))  # over at most most + 1 rows
    return page.select("*", place.cast("long").alias("place"), (F.count("*").over(W.partitionBy(F.lit(0))) > most).alias("truncated")).where(F.col("place") <= most)
