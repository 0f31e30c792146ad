"""How the sources of a language differ in their words: a sort-based streaming audit.

Map tasks cut texts into terms, sort (lang, term, source, document) and scan the runs, so that one row per term and source leaves
a block of documents (document: the run's first). These meet by (lang, term), are sorted by (lang, term, source, document), and a second
run-length scan yields document frequencies and counts of whole terms. Terms in at least ``least`` documents of their language stay.

A third scan goes over the kept terms, dealt by hash. For each (lang, term) run it emits partial sums of distances of pairs of sources, and
the terms that a source uses more than its language; only sums by pair, and each task's best terms, are merged. A pair's distance over
terms that neither source has needs no rows: each run adds what it changes against that. What a task must know of its sources
comes as the first row of its sort order, so nothing is broadcast; sources beyond BLOCK are dealt into blocks, and a row goes to all pairs of its block.

All arithmetic is on integers; shares are by long division, three digits at a time.

Defined cases: null text, lang and source are ''. Each row is a document of its own, repeated ids too. Texts of any length are cut whole
(a block has a bounded number of bytes, or one text). A language without kept terms has pairs with value 0. No rows: no result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import stored, table
from .words import chunks

LEAST_DOCUMENTS, TERM_RANKS, ADDED, UNIT = 30, 50, 5, 1_000_000_000
#: Sources of a language that one task compares with another such block's, and the parts that a language's terms are dealt into.
BLOCK, PARTS = 512, 64
BLOCK_BYTES, CELLS = 24 << 20, 1 << 17
#: ASCII letters to lower case, non-ASCII bytes as they are, all else a blank.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

_PARTIAL = "lang string, term string, source string, document long, df long, n long"
_KEPT = "lang string, term string, source string, n long, total long, first boolean"
_FOUND = "lang string, source string, part string, item string, value long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _edges(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row does."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        if n > 1:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def block_runs(texts: list[bytes], group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a block of texts of one language, and for each run of a term and group: term, group, first text, number of texts, occurrences.

    group: each text's number, ascending."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    words = [x.translate(_TERM_BYTES).split() for x in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    places, n = np.unique(ids * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
    term, text = np.divmod(places, max(1, len(texts)))
    of = group[text]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (of[1:] != of[:-1]))))
    df = np.diff(at, append=len(term))
    return list(known), term[at], of[at], text[at], np.stack((df, np.add.reduceat(n, at) if len(at) else df))


def _cut(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    schema = _schema(_PARTIAL)
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by([("lang", "ascending"), ("source", "ascending"), ("document", "ascending")]).combine_chunks()
        lang, source, ids = (rows[c].combine_chunks() for c in ("lang", "source", "document"))
        texts = [x.as_py() for x in rows["text"]]
        cuts = [*np.flatnonzero(_edges(lang)), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            group = np.cumsum(_edges(source[a:b]))
            for at in chunks(texts[a:b], block_bytes):
                terms, term, _, text, counts = block_runs(texts[a:b][at], group[at])
                text = pa.array(text + a + at.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang[a], len(term)), pa.array([x.decode("utf-8", "replace") for x in terms], pa.string()).take(pa.array(term)), source.take(text), ids.take(text), pa.array(counts[0]), pa.array(counts[1])], schema=schema
                )


def _scanned(least: int):
    """Sorted partial runs -> rows of whole terms in at least ``least`` documents. Only the last term of a batch waits, one row a source."""
    own, kept = _schema(_PARTIAL), _schema(_KEPT)

    def runs(rows: pa.Table) -> pa.Table:
        new = np.flatnonzero(_edges(*(rows[c].combine_chunks() for c in ("lang", "term", "source"))))
        sums = [pa.array(np.add.reduceat(rows[c].to_numpy(), new)) for c in ("df", "n")]
        at = pa.array(new)
        return pa.Table.from_arrays([rows["lang"].take(at), rows["term"].take(at), rows["source"].take(at), rows["document"].take(at), *sums], schema=own)

    def whole(rows: pa.Table) -> pa.RecordBatch:
        new = _edges(rows["lang"].combine_chunks(), rows["term"].combine_chunks())
        of, at = np.cumsum(new) - 1, np.flatnonzero(new)
        df, n = (np.add.reduceat(rows[c].to_numpy(), at)[of] for c in ("df", "n"))
        out = pa.Table.from_arrays([rows["lang"], rows["term"], rows["source"], rows["n"], pa.array(n), pa.array(new)], schema=kept)
        return out.filter(pa.array(df >= least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = runs((pa.concat_tables([left, rows.cast(own)]) if left is not None else rows.cast(own)).combine_chunks())
            last = int(np.flatnonzero(_edges(rows["lang"].combine_chunks(), rows["term"].combine_chunks()))[-1])
            left = rows.slice(last)
            if last:
                yield from whole(rows.slice(0, last).combine_chunks()).to_batches()
        if left is not None:
            yield from whole(left.combine_chunks()).to_batches()

    return run


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, term, source, n, total, first): occurrences of each kept term by source and in its language; first: one row of each (lang, term)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), F.col("doc_id").cast("long").alias("document"), text("text").cast("binary").alias("text"))
    return rows.mapInArrow(lambda x: _cut(x, block_bytes), _PARTIAL).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document").mapInArrow(_scanned(least), _KEPT)


def share(count: np.ndarray, of: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / (of + ADDED * terms)), element by element; 1 without terms."""
    count, of = np.broadcast_arrays(np.asarray(count, np.int64), np.asarray(of, np.int64))
    if not terms:
        return np.ones(count.shape, np.int64)
    if int(of.max(initial=0)) + ADDED * terms >= 9 * 10**15:  # beyond that three digits more would pass 64 bits
        count, of = count.astype(object), of.astype(object)
    left, whole = count + ADDED, of + ADDED * terms
    out, left = left // whole, left % whole
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return np.asarray(out + 1, np.int64)


class _Pair:
    """Sums of one language's part of terms for two blocks of sources (or one block with itself)."""

    def __init__(self, row: dict, ranks: int, cells: int):
        self.row, self.same, self.ranks, self.cells = row, row["x"] == row["y"], ranks, cells
        self.names = [[s["source"] for s in row[c]] for c in ("xs", "ys")]
        self.sizes = [np.array([s["n"] for s in row[c]], np.int64) for c in ("xs", "ys")]
        self.base = [share(0, sizes, row["terms"]) for sizes in self.sizes]
        self.sums = np.zeros([len(x) for x in self.names], np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in self.names[0]]

    def add(self, rows: pa.Table) -> None:
        """Runs of whole terms. Some at a time, as a matrix of terms and sources, so that the arrays stay small."""
        new = _edges(rows["term"].combine_chunks())
        run, starts, n = np.cumsum(new) - 1, np.flatnonzero(new), rows["n"].to_numpy()
        of = [pc.fill_null(pc.index_in(rows["source"].combine_chunks(), value_set=pa.array(x, pa.string())), -1).to_numpy(zero_copy_only=False) for x in self.names]
        step = max(1, self.cells // max(1, len(self.names[0]) + len(self.names[1])))
        for a in range(0, len(starts), step):
            at = slice(starts[a], starts[a + step] if a + step < len(starts) else len(run))
            p = []
            for side in (0, 1):
                whole, here = np.repeat(self.base[side][None, :], len(starts[a : a + step]), axis=0), of[side][at] >= 0
                row, column = run[at][here] - a, of[side][at][here]
                whole[row, column] = share(n[at][here], self.sizes[side][column], self.row["terms"])
                p.append(whole)
                if self.same and side == 0:
                    self.choose(rows, at, here, whole[row, column], column)
            for i in range(len(self.names[0])):
                self.sums[i] += np.abs(p[0][:, i, None] - p[1]).sum(axis=0) - len(p[0]) * np.abs(self.base[0][i] - self.base[1])

    def choose(self, rows: pa.Table, at: slice, here: np.ndarray, p: np.ndarray, source: np.ndarray) -> None:
        """Keeps each source's terms of the largest p - q, at most ``ranks`` and their ties."""
        more = p - share(rows["total"].to_numpy()[at][here], self.row["size"], self.row["terms"])
        place = np.flatnonzero(here) + at.start
        order = np.lexsort((-more, source))
        order = order[more[order] > 0]
        cuts = np.searchsorted(source[order], np.arange(len(self.names[0]) + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            own = order[a:b]
            own = own[more[own] >= more[own[self.ranks - 1]]] if len(own) > self.ranks else own
            if len(own):
                terms = rows["term"].take(pa.array(place[own])).to_pylist()
                self.best[i] = sorted(self.best[i] + list(zip((-more[own]).tolist(), terms, strict=True)))[: self.ranks]

    def rows(self) -> Iterator[tuple]:
        """Partial results; the terms that no run brought are added once, by part 0."""
        lang, first = self.row["lang"], self.row["part"] == 0
        sums = self.sums + (self.row["terms"] * np.abs(self.base[0][:, None] - self.base[1][None, :]) if first else 0)
        for i, s in enumerate(self.names[0]):
            for j in range(len(self.names[1])) if first else np.flatnonzero(sums[i]):
                if not (self.same and i == j):
                    yield lang, s, "pair", self.names[1][j], int(sums[i, j])
                    if not self.same:
                        yield lang, self.names[1][j], "pair", s, int(sums[i, j])
            for value, term in self.best[i]:
                yield lang, s, "term", term, -value


def _compared(batches: Iterator[pa.RecordBatch], ranks: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, x, y, part, term, source), each part's header first -> partial results. Only the last term of a batch waits."""
    schema = _schema(_FOUND)
    pair, left = None, None

    def out(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        found = list(found)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        header = batch.column(batch.schema.get_field_index("header"))
        heads = np.flatnonzero(pc.is_valid(header).to_numpy(zero_copy_only=False))
        rows = pa.Table.from_batches([batch]).select(["term", "source", "n", "total"])
        for a, b in zip([-1, *heads], [*heads, batch.num_rows], strict=True):
            if a >= 0:
                if left is not None:
                    pair.add(left)
                    left = None
                if pair:
                    yield from out(pair.rows())
                pair = _Pair(header[int(a)].as_py(), ranks, cells)
            own = rows.slice(a + 1, b - a - 1)
            if own.num_rows:
                own = (pa.concat_tables([left, own]) if left is not None else own).combine_chunks()
                last = int(np.flatnonzero(_edges(own["term"].combine_chunks()))[-1])
                left = own.slice(last)
                if last:
                    pair.add(own.slice(0, last))
    if left is not None:
        pair.add(left)
    if pair:
        yield from out(pair.rows())


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source to the others of its language, and the terms that it uses more than the language."""
    kept = stored(kept_terms(docs, least, block_bytes), "terms")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(text("lang").alias("lang"), text("source").alias("source")).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, ["n"])
    of_lang = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("size"))
    groups = stored(groups.join(of_lang, "lang", "left").fillna(0, ["terms", "size"]), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-most // block) or 1
    of = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    every = groups.select("lang", "terms", "size").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = groups.groupBy("lang", of.alias("block")).agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"))
    own = every.join(own, ["lang", "block"], "left").withColumn("sources", F.coalesce("sources", F.array().cast(own.schema["sources"].dataType)))  # a block may be empty
    pairs = own.withColumnsRenamed({"block": "x", "sources": "xs"}).join(own.select("lang", F.col("block").alias("y"), F.col("sources").alias("ys")), "lang").where("x <= y")
    key = ["lang", "x", "y", "part"]
    heads = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("header", F.struct(*key, "terms", "size", "xs", "ys"))
    heads = heads.select(*key, *[F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("source", "string"), ("n", "long"), ("total", "long"))], "header")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = kept.withColumns({"part": F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int"), "_block": of}).withColumn("_other", other)
    rows = rows.select("lang", F.least("_block", "_other").alias("x"), F.greatest("_block", "_other").alias("y"), "part", "term", "source", "n", "total", F.lit(None).cast(heads.schema["header"].dataType).alias("header"))
    found = heads.unionByName(rows).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("term"), "source").mapInArrow(lambda x: _compared(x, ranks, cells), _FOUND)
    found = stored(found, "partial")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(best))
    distances = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    return ranked(distances).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= ranks))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), t AS (
  SELECT id, lang, source, unnest(words) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), v AS (
  SELECT lang, count(*) AS v, sum(total) AS size FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, total, v, size, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)
), q AS (
  SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (own + 5 * v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (total + 5)) // (size + 5 * v) AS q FROM p
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS s FROM q x JOIN q y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM q WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50"""
