"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ten consecutive words (a shorter item is one window). Each window is a set of shingles of
five words. One pass over the documents finds where any of the items' shingles occur and counts in how many documents each
does; a window's shingles are ordered by that rarity. Containment asks for all shingles, so the necessary prefix is one: the
rarest. Its occurrences, moved by its offset and bounded by the document's length, are the candidates, and a candidate
holds exactly if all the window's shingles stand at their positions.

The items' shingles are broadcast only if they are few enough by count (BROADCAST_ROWS); beyond that the same join shuffles.
No document's words leave its own row: only positions and ids of shingles are shuffled.

Defined cases: null and empty texts have no words and no hits; so have items without words. Rows with the same doc_id and text
have equal results, rows with the same doc_id and other text are judged each alone, a null doc_id is kept as null. Items with
equal text all count. Without items nothing is contaminated. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import stored, table

WINDOW_WORDS, SHINGLE_WORDS = 10, 5
#: Up to so many item shingles (under 64 MB) are sent to every executor.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """ASCII letters lower-cased; runs of digits, letters and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _joined(words: str, at: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(F.col(words), at + i) for i in range(n)])


def item_windows(items: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(item_id, win, width, k, off, s): each window's shingles, s of k words at word off of the window. Equal windows of an item are one."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    w = w.withColumn("width", F.least(F.lit(window), F.size("words")))
    w = w.select("item_id", "width", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1), lambda i: F.slice("words", i, F.col("width")))).alias("w")).distinct()
    w = w.withColumn("k", F.least(F.lit(shingle), F.col("width")))
    w = w.select("item_id", F.array_join("w", " ").alias("win"), "width", "k", "w", F.explode(F.sequence(F.lit(0), F.col("width") - F.col("k"))).alias("off"))
    return w.select("item_id", "win", "width", "k", "off", F.array_join(F.slice("w", F.col("off") + 1, F.col("k")), " ").alias("s"))


def occurrences(docs: DataFrame, shingles: DataFrame, sizes: list[int], few: bool) -> DataFrame:
    """(doc, n_words, at, sid): where the shingles (k, s, sid) occur; each document's first word has a row too, with or without one."""
    w = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    each = w.select("doc", "n_words", "words", F.posexplode_outer("words").alias("at", "word"))
    out = None
    for i, k in enumerate(sizes):
        side = shingles.where(F.col("k") == k).select("s", "sid")
        found = each.select("doc", "n_words", "at", F.when(F.col("at") <= F.col("n_words") - k, _joined("words", F.col("at"), k)).alias("s")).join(F.broadcast(side) if few else side, "s", "left")
        first = F.coalesce("at", F.lit(0)) == 0
        found = found.where(F.col("sid").isNotNull() | first if i == 0 else F.col("sid").isNotNull()).select("doc", "n_words", F.coalesce("at", F.lit(0)).alias("at"), "sid", (first & F.lit(i == 0)).alias("first"))
        out = found if out is None else out.unionByName(found)
    return out


def hit_windows(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, item_id, start, width) of all occurrences of windows (each with sid), by their rarest shingle."""
    rarity = found.where("sid is not null").select("doc", "sid").distinct().groupBy("sid").agg(F.count("*").alias("df"))
    rare = windows.join(rarity, "sid", "left").groupBy("item_id", "win", "width", "k").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sid", "off")).alias("p"), F.collect_list(F.struct("off", "sid")).alias("all"))
    rare = rare.where("p.df > 0").select("item_id", "width", "k", F.col("p.sid").alias("sid"), F.col("p.off").alias("off"), "all")
    cand = found.where("sid is not null").select("doc", "n_words", "at", "sid").join(rare, "sid").withColumn("start", F.col("at") - F.col("off"))
    cand = cand.where("start >= 0 and start + width <= n_words").select("doc", "item_id", "start", "width", F.explode("all").alias("x"), F.size("all").alias("need"))
    cand = cand.select("doc", "item_id", "start", "width", "need", (F.col("start") + F.col("x.off")).alias("at"), F.col("x.sid").alias("sid"))
    places = found.where("sid is not null").select("doc", "at", "sid").distinct()
    held = cand.distinct().join(places, ["doc", "at", "sid"]).groupBy("doc", "item_id", "start", "width", "need").agg(F.count("*").alias("n"))
    return held.where("n >= need").select("doc", "item_id", "start", "width")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, n_words, n_hit, items), (doc_id, text_key, item_id, start, width: the hit windows, in words)."""
    windows = stored(item_windows(items, window, shingle).withColumn("sid", F.xxhash64("k", "s")), "windows")
    shingles = windows.select("k", "s", "sid").distinct()
    sizes = sorted(r[0] for r in shingles.select("k").distinct().collect()) or [shingle]  # at most `shingle` numbers
    found = stored(occurrences(docs, shingles, sizes, shingles.count() <= BROADCAST_ROWS), "occurrences")
    # windows of an item that repeat a shingle need it at each of its offsets, so equal (at, sid) of one start stay apart by `at`
    hits = stored(hit_windows(found, windows), "hits")
    ends = hits.groupBy("doc", "start").agg(F.max(F.col("start") + F.col("width")).alias("end"))
    before = F.max("end").over(W.partitionBy("doc").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.withColumn("new", F.col("end") - F.greatest("start", F.coalesce(before, F.col("start"))))
    words = ends.groupBy("doc").agg(F.sum(F.greatest("new", F.lit(0))).cast("long").alias("n_hit"))
    names = hits.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    base = found.where("first").select("doc", "n_words")
    rows = base.join(words, "doc", "left").join(names, "doc", "left")
    rows = rows.select(F.col("doc.doc_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return rows, hits.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text_key").alias("text_key"), "item_id", "start", "width")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def contamination_sql(documents: str = "documents") -> str:
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM {documents}),
i AS (SELECT item_id, {words} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW_WORDS}) AS width, array_to_string(w[p:p + least(len(w), {WINDOW_WORDS}) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW_WORDS}) + 2)) AS p FROM i WHERE len(w) > 0)
),
spot AS (
  SELECT doc_id, width, p, array_to_string(w[p:p + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, CAST(len(w) - width + 2 AS BIGINT))) AS p FROM d, (SELECT DISTINCT width FROM win) WHERE len(w) >= width)
),
hit AS (SELECT spot.doc_id, spot.p, spot.width, win.item_id FROM spot JOIN win ON spot.width = win.width AND spot.s = win.s),
places AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + width)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


OP5_SQL = contamination_sql()
