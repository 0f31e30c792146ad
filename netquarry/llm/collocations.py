"""Collocations: phrases that occur more often than their parts suggest, from word-id suffix arrays of shards.

A shard is a bounded number of bytes of one language's texts in one task. Its words get ids, its pieces are parted by a mark, and prefix
doubling in numpy sorts its suffixes by their first words, as far as the longest phrase goes. Runs of neighbours whose common prefix has n words
(the LCP intervals of that depth) are the shard's distinct n-grams with their counts, and one row for each goes to the global sum by key.

Lengths are counted one after the other. A phrase that occurs ``least`` times has only parts that do, so after each length the frequent phrases are put into a
filter of FILTER_BITS bits (bounded, whatever the data), and the next length leaves out n-grams with a part that the filter lacks. The filter only ever passes too
much, so counts are exact at every size; where it fills up, more rows are shuffled.

Defined cases: null text is empty, null lang is ``und``. Each row is a text of its own, repeated ids too. Texts of any length are read whole: a longer one than a shard is
a shard. Words are bytes; ties of score and count go by the phrase's bytes. No rows: no result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import stored, table
from .words import mix

LONGEST, LEAST, TOP, KEPT_PERCENT, UNIT = 3, 10, 2000, 50, 1_000_000
SHARD_BYTES, BATCH_ROWS, FILTER_BITS, SALTS = 4 << 20, 1 << 16, 1 << 26, 64
#: ASCII letters to lower case, marks and line ends to a line end, a tab to a blank.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_COUNTED = "lang string, phrase string, f long"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of a shard as ids from 1, 0 between pieces and texts; and the words by id."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    known[b"\n"], known[b""] = 0, 1
    ids = []
    for text in texts:
        words = text.translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
        words.append(b"\n")
        ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    ids = ids[ids != 1]  # what stands between two blanks
    return np.where(ids > 0, ids - 1, 0), [b"\n", *list(known)[2:]]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and each one's dense rank from 1 (0 where the key is 0)."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    s = keys[order]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(np.concatenate((s[:1] > 0, s[1:] != s[:-1])), dtype=np.int32)
    return order, rank


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` words at least, by prefix doubling, and the common prefix of each with the one before it (at most depth).

    A common prefix ends at the mark 0; suffixes that begin with it are left unsorted."""
    order, rank = _ranked(ids)
    h = 1
    while h < depth:
        following = np.zeros_like(rank)
        following[:-h] = rank[h:]
        following[rank == 0] = 0
        order, rank = _ranked(rank.astype(np.int64) * (int(rank.max(initial=0)) + 1) + following)
        h *= 2
    lcp = np.zeros(len(ids), np.int16)
    going = np.ones(max(0, len(ids) - 1), bool)
    padded = np.concatenate((ids, np.zeros(depth, ids.dtype)))
    for k in range(depth):
        a, b = padded[order[:-1] + k], padded[order[1:] + k]
        going &= (a == b) & (a > 0)
        lcp[1:] += going
    return order, lcp


def intervals(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A place, and the number of places, of each distinct n-gram: the runs of suffixes with n words in common."""
    whole = np.ones(len(ids), bool)  # places from which n words go on without a mark
    padded = np.concatenate((ids, np.zeros(n, ids.dtype)))
    for k in range(n):
        whole &= padded[k : k + len(ids)] > 0
    starts = np.flatnonzero(lcp < n)
    sizes = np.diff(starts, append=len(order))
    places = order[starts]
    return places[whole[places]], sizes[whole[places]]


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def gram_slots(hashes: np.ndarray, n: int, bits: int = FILTER_BITS) -> np.ndarray:
    """The bit of each n-gram of a sequence of words' hashes in a filter of so many bits."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(total)] + np.uint64(n))
    return total & np.uint64(bits - 1)


def has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0


def shard_counts(lang: str, texts: list[bytes], n: int, bits: np.ndarray | None) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """A shard's words, its distinct n-grams (as rows of words' numbers) whose parts of n - 1 words all pass the filter, their counts, and how many words it has."""
    ids, words = word_ids(texts)
    total = int((ids > 0).sum())
    if bits is not None and len(ids):
        slots = gram_slots(word_hashes(lang, words)[ids], n - 1, 8 * len(bits))
        passes = np.concatenate((has(bits, slots), np.zeros(n - 2, bool)))  # of the part that begins there
        if n == 2:
            ids = np.where(passes, ids, 0)
        else:  # a word stays where a passing n-gram covers it; the others become marks
            begins = passes[:-1] & passes[1:]
            covered = np.zeros(len(ids) + n, bool)
            for k in range(n):
                covered[k : k + len(begins)] |= begins
            ids = np.where(covered[: len(ids)], ids, 0)
        marks = ids == 0
        ids = ids[~(marks & np.concatenate(([True], marks[:-1])))]  # one mark of several
    order, lcp = suffix_array(ids, n)
    places, f = intervals(ids, order, lcp, n)
    rows = ids[places[:, None] + np.arange(n)[None, :]]
    if bits is not None and n > 2 and len(rows):  # two covering n-grams may enclose one that does not pass
        own = word_hashes(lang, words)[rows]
        keep = np.ones(len(rows), bool)
        for k in range(2):
            total_hash = np.zeros(len(rows), np.uint64)
            for j in range(n - 1):
                total_hash = mix(total_hash * np.uint64(0x9E3779B97F4A7C15) + own[:, k + j] + np.uint64(n - 1))
            keep &= has(bits, total_hash & np.uint64(8 * len(bits) - 1))
        rows, f = rows[keep], f[keep]
    return words, rows, f, total


def _counts(n: int, bits, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def shard(lang: str) -> Iterator[pa.RecordBatch]:
            words, rows, f, total = shard_counts(lang, waiting.pop(lang), n, None if bits is None else np.frombuffer(bits.value, np.uint8))
            sizes.pop(lang)
            words = pa.array([x.decode("utf-8", "replace") for x in words], pa.string())
            for at in range(0, len(rows), BATCH_ROWS):
                part = [words.take(pa.array(x)) for x in rows[at : at + BATCH_ROWS].T]
                yield made(lang, part[0] if n == 1 else pc.binary_join_element_wise(*part, " "), pa.array(f[at : at + BATCH_ROWS]))
            if n == 1:
                yield made(lang, pa.array([""]), pa.array([total], pa.int64()))

        def made(lang: str, phrases: pa.Array, f: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrases)).cast(pa.string()), phrases, f], schema=_ARROW)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                waiting.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= shard_bytes:
                    yield from shard(lang)
                elif sum(sizes.values()) >= 2 * shard_bytes:  # many languages
                    yield from shard(max(sizes, key=sizes.get))
        for lang in list(waiting):
            yield from shard(lang)

    return run


def counted(texts: DataFrame, n: int, bits=None, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, f) of n-grams that occur at least ``least`` times; with n = 1 also each lang's number of words, as phrase ''."""
    parts = texts.mapInArrow(_counts(n, bits, shard_bytes), _COUNTED)
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def _slots(n: int, size: int):
    """Phrases -> the filter's words of 64 bits, and each phrase's bit in its word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang[lang] += phrase.encode().split(b" ")
            for lang, words in by_lang.items():
                slots = gram_slots(word_hashes(lang, words), n, size)[::n]
                bit = np.uint64(1) << (slots & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], names=["at", "bit"])

    return run


def filter_of(phrases: DataFrame, n: int, size: int = FILTER_BITS):
    """A broadcast filter of the phrases: ``size`` bits (a power of two), of which the words of 64 with a bit pass through the driver."""
    found = phrases.mapInArrow(_slots(n, size), "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(bits.tobytes())


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, n, phrase, f): phrases of 1 to ``longest`` words that occur at least ``least`` times; n = 0: a lang's number of words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    out, bits = None, None
    for n in range(1, longest + 1):
        own = stored(counted(texts, n, bits, least, shard_bytes), f"phrases{n}")
        if n < longest:
            bits = filter_of(own.where("phrase <> ''").select("lang", "phrase"), n, filter_bits)
        own = own.select("lang", F.when(F.col("phrase") == "", 0).otherwise(n).alias("n"), "phrase", "f")
        out = own if out is None else out.unionByName(own)
    return out


def collocations(counts: DataFrame, top: int = TOP, kept_percent: int = KEPT_PERCENT) -> DataFrame:
    """The first ``top`` phrases of each lang by the score of their lowest cut, of those that no longer phrase holds in so many percent of their places."""
    f = stored(counts.where("n > 0"), "phrases")
    words = f.withColumn("words", F.split("phrase", " "))
    of = lambda a, k: F.array_join(F.slice("words", a, k), " ")
    cut = words.where("n > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select("lang", "phrase", F.col("f").alias("a"), "k", of(F.lit(1), F.col("k")).alias("left"), of(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    cut = cut.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cut = cut.withColumns({"_num": (whole("a") * whole("a") * F.lit(UNIT)).cast("decimal(38,0)"), "_den": (whole("l") * whole("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("_num div _den"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    place = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda at: F.array_join(F.slice("words", at, m), " ")))))
    inside = words.where("n > 2").select("lang", "f", place.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < kept_percent * F.col("a"), F.lit(True))).drop("_longer")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language first, so that no task sorts more than SALTS times ``top`` rows
    part = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*best))).where(F.col("_rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(phrase_counts(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), x AS (
  SELECT lang, row_number() OVER () AS piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), y AS (
  SELECT lang, piece_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM x
), z AS (
  SELECT lang, w, lead(w) OVER q AS w2, lead(w, 2) OVER q AS w3 FROM y WINDOW q AS (PARTITION BY piece_id ORDER BY i)
), o AS (
  SELECT lang, 1 AS n, w AS phrase FROM z UNION ALL SELECT lang, 2, w || ' ' || w2 FROM z WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM z WHERE w3 IS NOT NULL
), f AS MATERIALIZED (
  SELECT lang, n, phrase, CAST(count(*) AS HUGEINT) AS f FROM o GROUP BY lang, n, phrase
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE n = 1 GROUP BY lang
), c AS (
  SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, n)) AS k FROM f WHERE n > 1 AND f >= 10
), t AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM c
), s AS (
  SELECT t.lang, t.phrase, t.a, k, l.f AS l, r.f AS r, (1000000 * t.a * t.a) // (l.f * r.f) AS score FROM t JOIN f l ON l.lang = t.lang AND l.phrase = first JOIN f r ON r.lang = t.lang AND r.phrase = rest
), m AS (
  SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE n = 3 AND k = 1 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE n = 3 AND k = 1) GROUP BY lang, phrase
), kept AS (
  SELECT m.* FROM m LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * m.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
