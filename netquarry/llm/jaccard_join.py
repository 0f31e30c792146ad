"""Exact Jaccard join of word shingle sets, size-aware: subsets for small sets, inverted lists for large ones.

1. Every document's set of distinct shingle keys is made with numpy. Keys travel in blocks (one row for a block of documents
   and a range of keys) to count in how many documents each occurs. Keys of one document alone cannot link: they are
   counted, not kept. This gives each document its shared keys in one global order of rarity, and its prefix: the rarest keys,
   of which two linked sets must share one.
2. Equal sets become one representative (by size and a 128-bit sum of mixed keys).
3. Light sets, of up to ``boundary`` shingles: all subsets of the size that a link needs (for each pair of sizes) become keys;
   sets with a common key are linked, as a star around the least id of the smaller size. The boundary is the size where enumerating these
   subsets would cost more than reading the inverted lists, both counted on the data.
4. Heavy sets: inverted lists of the prefixes. First each list is a star around its least id, then around a pseudo-random
   member for those still in another component, and last all pairs of different components in a list (each only in the first
   list they share). Length and positional bounds apply, and every pair is verified by its overlap. A pair inside a known
   component needs no check, so groups of copies cost a number of pairs in proportion to their size, and no link
   between different components is lost.

Defined cases: null and empty texts have the empty set and are linked with nothing. Rows of one doc_id are one document, that
with the largest set. A null doc_id has no component (null) but its own size. Texts of any length are taken whole. Keys have
48 bits where overlaps are counted (two sets of 1,000 shingles agree by chance on one with 4e-9) and 64 in the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import pack, pack_sorted, runs, unpack, unpack_sorted
from .components import components
from .shared import stored, table
from .words import chunks, encoded, mix, shingle_keys, word_keys

SHINGLE_WORDS = 5
BLOCK_BYTES = 3 << 20
PART_BYTES = 10 << 20
KEY_BITS = 48
#: A class of equal sets is hot from this part of all documents on.
HOT_CLASSES = 2_000
#: Sizes above this are never enumerated: a set of 16 has up to C(16, 12) = 1,820 subsets for one partner size.
LIGHT_MOST = 16

_BLOCK = "part long, block long, kind int, ids binary, body binary"
_SETS = "doc_id long, n long, f1 long, f2 long, unique long, shared binary, prefix array<long>"


def needed(n: int, m: int) -> int:
    """The overlap at which 100 * overlap >= 75 * union."""
    return -(-3 * (n + m) // 7)


def partner_sizes(n: int) -> range:
    return range(-(-3 * n // 4), 4 * n // 3 + 1)


def _blocks(parts: int, words: int):
    """documents -> one row for each block of them and range of keys, and one with the documents themselves."""
    step = -(-(1 << KEY_BITS) // parts)
    bounds = np.arange(parts, dtype=np.uint64) * np.uint64(step)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32  # and a number within the task: the same again if the task is run again
        for batch in batches:
            texts, known = encoded(batch["text"]), batch["doc_id"].notna().to_numpy()
            ids = batch["doc_id"].fillna(0).to_numpy(np.int64)
            for at in chunks(texts, BLOCK_BYTES):
                keys, starts = word_keys(texts[at])
                sets = [np.unique(shingle_keys(keys[a:b], words)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                f1 = np.array([mix(x).sum(dtype=np.uint64) for x in sets], np.uint64)
                f2 = np.array([mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], np.uint64)
                own, ok = ids[at], known[at]
                rows = [(block % parts, block, 1, own.tobytes() + ok.tobytes(), n.tobytes() + f1.tobytes() + f2.tobytes())]
                if ok.any() and n[ok].any():
                    short = np.concatenate([x for x, y in zip(sets, ok, strict=True) if y]) >> np.uint64(64 - KEY_BITS)
                    docs = np.repeat(np.flatnonzero(ok), n[ok])
                    order = np.argsort(short, kind="stable")
                    short, docs = short[order], docs[order]
                    cuts = np.append(np.searchsorted(short, bounds), len(short))
                    rows += [(p, block, 0, pack(docs[a:b].astype(np.uint64), 3), pack_sorted(short[a:b], 6)) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                yield pd.DataFrame(rows, columns=["part", "block", "kind", "ids", "body"])
                block += 1

    return run


def _shared_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range of keys: those of more than one document go back to their blocks, with a class of rarity."""
    told, out = pdf[pdf["kind"] == 0], [pdf[pdf["kind"] == 1]]
    if len(told):
        keys = [unpack_sorted(x, 6) for x in told["body"]]
        docs = np.concatenate([unpack(x, 3) for x in told["ids"]])
        row = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        at = runs(keys[order])
        count = np.repeat(np.diff(at), np.diff(at))
        order, count = order[count > 1], count[count > 1]
        rarity = np.minimum(np.log2(count) * 8, 255).astype(np.uint8)
        back = np.argsort(row[order], kind="stable")
        order, rarity = order[back], rarity[back]
        at = runs(row[order])
        blocks, part = told["block"].to_numpy(), int(told["part"].iloc[0])
        out.append(pd.DataFrame(
            [(part, blocks[row[order[a]]], 0, pack(docs[order[a:b]], 3) + rarity[a:b].tobytes(), pack_sorted(keys[order[a:b]], 6)) for a, b in zip(at[:-1], at[1:], strict=True)],
            columns=["part", "block", "kind", "ids", "body"],
        ))
    return pd.concat(out)


def _sets(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of documents: each one's shared keys, and the prefix of its rarest keys without those that are its alone."""
    head = pdf[pdf["kind"] == 1].iloc[0]
    size = len(head["ids"]) // 9
    ids, ok = np.frombuffer(head["ids"], np.int64, size), np.frombuffer(head["ids"], np.bool_, size, 8 * size)
    n, f1, f2 = np.frombuffer(head["body"], np.int64).reshape(3, size)
    told = pdf[pdf["kind"] == 0]
    keys = np.concatenate([np.empty(0, np.uint64), *[unpack_sorted(x, 6) for x in told["body"]]])
    docs = np.concatenate([np.empty(0, np.uint64), *[unpack(x[: 3 * (len(x) // 4)], 3) for x in told["ids"]]]).astype(np.int64)
    rarity = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(x, np.uint8, offset=3 * (len(x) // 4)) for x in told["ids"]]])
    order = np.lexsort((keys, rarity, docs))
    keys, cuts = keys[order].astype(np.int64), np.searchsorted(docs[order], np.arange(size + 1))
    rows = []
    for i in range(size):
        a, b = int(cuts[i]), int(cuts[i + 1])
        unique = int(n[i]) - (b - a)
        prefix = keys[a : a + max(0, int(n[i]) - -(-3 * int(n[i]) // 4) + 1 - unique)]
        shared = np.sort(keys[a:b]).tobytes() if len(prefix) else b""
        rows.append((ids[i] if ok[i] else None, n[i], f1[i], f2[i], unique, shared, prefix))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _SETS.split(", ")]).astype({"doc_id": "Int64"})


def shingle_table(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of _SETS for each row of docs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_blocks(parts, words), _BLOCK)
    return blocks.groupBy("part").applyInPandas(_shared_keys, _BLOCK).groupBy("block").applyInPandas(_sets, _SETS)


def boundary(sizes: list[tuple[int, int, int]]) -> int:
    """The size up to which enumerating costs less. sizes: (n, sets of n shingles, entries of their inverted lists)."""
    best, x = 0, 0
    cost = sum(entries for _, _, entries in sizes)
    least = cost
    for n, sets, entries in sorted(sizes):
        cost += sets * sum(comb(n, c) for m in partner_sizes(n) if (c := needed(n, m)) <= n) - entries
        x = n
        if cost < least:
            least, best = cost, x
    return best


def _subsets(most: int):
    """Light sets -> (size of the smaller, size of the larger, key of the subset, id, own size)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, n, shared in zip(batch["id"], batch["n"], batch["shared"], strict=True):
                keys = mix(np.frombuffer(shared, np.uint64))
                for m in partner_sizes(n):
                    c = needed(n, m)
                    if m <= most and c <= len(keys):
                        rows += [(min(n, m), max(n, m), int(sum(map(int, x)) % (1 << 64)) - (1 << 63), doc, n) for x in combinations(keys, c)]
            yield pd.DataFrame(rows, columns=["small", "large", "key", "id", "n"]).astype("int64")

    return run


@F.pandas_udf(T.LongType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _may_link(light: int) -> Column:
    """Length and positional bounds for two entries a, b of one inverted list; the smaller set's key must lie in its shorter prefix."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    smaller = (a("n") < b("n")) | ((a("n") == b("n")) & (a("id") < b("id")))
    most = F.least(a("pos") - a("unique"), b("pos") - b("unique")) + 1 + F.least(a("n") - a("pos"), b("n") - b("pos")) - 1
    return (
        (a("id") != b("id"))
        & (4 * F.least(a("n"), b("n")) >= 3 * F.greatest(a("n"), b("n")))
        & (F.greatest(a("n"), b("n")) > light)
        & F.when(smaller, a("short")).otherwise(b("short"))
        & (7 * most >= 3 * (a("n") + b("n")))
    )


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked)"""
    one = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"s_{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").withColumn("o", _overlap("s_a", "s_b"))
    return stored(both.select("a", "b", (100 * F.col("o") >= 75 * (F.col("n_a") + F.col("n_b") - F.col("o"))).alias("linked")), "pairs")


def _edges(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("a", "b")
    for t in tables[1:]:
        out = out.unionByName(t.select("a", "b"))
    return out


def link_sets(sets: DataFrame) -> DataFrame:
    """(id, component) of the sets (id, n, unique, shared, prefix: all different) that are linked with another one."""
    entries = sets.select("id", "n", "unique", F.posexplode("prefix").alias("at", "key")).withColumn("pos", F.col("unique") + F.col("at"))
    entries = entries.withColumn("short", F.col("pos") < F.col("n") - F.ceil(6 * F.col("n") / 7) + 1).drop("at")
    lists = entries.groupBy("key").agg(F.count("*").alias("len"), F.min(F.struct("id", "n", "unique", "pos", "short")).alias("star")).where("len > 1")
    entries = stored(entries.join(lists, "key"), "lists")

    costs = entries.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.sum("len").alias("read"))
    counts = sets.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count("*").alias("sets")).join(costs, "n", "left")
    light = boundary([(r["n"], r["sets"], r["read"] or 0) for r in counts.collect()])  # one row for each size up to LIGHT_MOST

    keys = sets.where(F.col("n") <= light).select("id", "n", "shared").mapInPandas(_subsets(light), "small long, large long, key long, id long, n long")
    # the centre is of the smaller size: what two larger sets share need not be enough for them
    star = keys.groupBy("small", "large", "key").agg(F.min(F.when(F.col("n") == F.col("small"), F.col("id"))).alias("a"), F.count("*").alias("c")).where("c > 1 AND a IS NOT NULL").drop("c")
    links = keys.join(star, ["small", "large", "key"]).where("a != id").select("a", F.col("id").alias("b")).distinct()

    own = [c for c in entries.columns if c != "star"]
    first = entries.select(F.struct("star.*").alias("a"), F.struct(*own).alias("b")).where(_may_link(light))
    checked = _verified(_pairs(first), sets)
    links = stored(_edges(links, checked.where("linked")), "links")
    found = components(links)

    def open_lists(found: DataFrame) -> DataFrame:
        """The entries of lists that still hold several components."""
        placed = entries.select(*own).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        chosen = F.min_by(F.struct("component", "id", "n", "unique", "pos", "short"), F.xxhash64("id", "key")).alias("star")
        several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), chosen).where("lo != hi").select("key", "star")
        return placed.join(several, "key")

    rest = open_lists(found)
    second = rest.select(F.struct("star.*").alias("a"), F.struct(*own, "component").alias("b")).where(F.col("a.component") != F.col("b.component")).where(_may_link(light))
    again = _verified(_pairs(second).join(checked.select("a", "b"), ["a", "b"], "left_anti"), sets)
    links = stored(_edges(links, again.where("linked")), "links")
    found = components(links)

    known = _edges(checked, again)
    # two sets that link are in one band of size or in neighbouring ones, so only entries of such bands meet
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(4 / 3) * (1 + 1e-9))).cast("int")
    rest = open_lists(found).drop("star").join(sets.select("id", "prefix"), "id").withColumns({"before": F.slice("prefix", 1, (F.col("pos") - F.col("unique")).cast("int")), "band": band}).drop("prefix")
    rest = stored(rest, "open")
    upper = rest.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & ordered & (F.col("a.component") != F.col("b.component")) & _may_link(light) & ~F.arrays_overlap("a.before", "b.before")
    last = upper.alias("a").join(rest.alias("b"), apart)
    more = _verified(_pairs(last).join(known, ["a", "b"], "left_anti"), sets)
    return components(_edges(links, more.where("linked")))


def jaccard_components(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text)."""
    rows = stored(shingle_table(docs.select("doc_id", "text"), words), "sets")
    named = rows.where("doc_id is not null")
    best = stored(named.groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2")).alias("x")).select("doc_id", "x.*"), "best")
    same = stored(best.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    sets = stored(
        named.where(F.size("prefix") > 0).join(same.select("n", "f1", "f2", "id", F.col("id").alias("doc_id")), ["doc_id", "n", "f1", "f2"]).dropDuplicates(["id"]).select("id", "n", "unique", "shared", "prefix"), "representatives"
    )
    found = link_sets(sets)
    placed = (
        _with_class(best, same)
        .join(found, "id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id", "doc_id").alias("component_id"))
    )
    return placed.unionByName(rows.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def _with_class(best: DataFrame, same: DataFrame) -> DataFrame:
    """best with the id of its class of equal sets. Classes with more than one of HOT_CLASSES of the rows (fewer than so many) are looked up
    where their rows are, so that no task gets all copies of one text; the others are joined."""
    key = ["n", "f1", "f2"]
    hot = F.broadcast(same.where(F.col("copies") * HOT_CLASSES > best.count()).select(*key, "id"))
    near = best.join(hot, key, "left")
    rest = near.where("id is null").drop("id").join(same.select(*key, "id"), key, "left")
    return near.where("id is not null").unionByName(rest)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
