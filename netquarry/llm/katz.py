"""Language-model scores by a Katz back-off bigram model with Good-Turing discounts, over all documents.

Counts: a token is a word or the end of a document; each token is counted after its predecessor (or a document's start).
P(w | h) is ``keep * d(c) * c(h w) / c(h)`` for a bigram that training has, with Good-Turing discounts d for counts up to K; else it
is ``alpha(h) * P(w)``, and P(w) itself backs off from counted words to one unknown word. ``keep = 1 - RESERVED`` leaves every
context some mass, so alpha(h), the mass left divided by what P gives to the words not seen after h, makes each
context's probabilities (over the vocabulary and the unknown word) sum to one exactly. A context that training lacks has alpha 1.

How it runs: n-grams that end in one word, of every order, meet in that word's partition, so a word's own count and all it
backs off to are there. Blocks of documents send each partition their distinct bigrams with documents and counts (packed
arrays, pre-aggregated). Words with a large share of all tokens (known from a first count, at most HOT_WORDS) are split over all
partitions by their predecessor. The merged counts are stored as a partitioned table; sums over each context's words go to the
context's partition, where alpha is computed and stored, and only sums by document come back. Nothing but n_r, totals and the hot
words reaches the driver. Each phase is written to the shared folder.

Defined cases: null text is empty, an empty text is one end token. Texts are read whole. Repeated rows are scored, and counted, each
for itself; a null doc_id counts as held out. Without training rows every token is the unknown word, with score 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import bundle, runs, unbundle
from .shared import stored, table
from .words import mix, word_keys

K, RESERVED = 5, 1e-4
BLOCK_BYTES, PART_BYTES = 4 << 20, 16 << 20
SENT_BYTES = 4 << 20  # of rows that a task of the merge hands on at once
UNSEEN_MOST = 1 << 20  # bigrams that training lacks, of one document each, that are held before they are handed on
HOT_WORDS, HOT_SHARE = 10_000, 4
START, END = (mix(np.array([x], np.uint64))[0] for x in (0x535441525421, 0x454E4421))
BASE_ADD = 0.1

_ROW = "kind string, target long, block long, body binary"
_COLUMNS = ["kind", "target", "block", "body"]


def discounts(n: list[int]) -> np.ndarray:
    """d[0..K]: Katz's discounts for counts r by Good-Turing, from n[r] (r = 1..K+1: how many n-grams occur r times).

    Where these counts of counts give no discount between 0 and 1, the largest k below K that does is taken; d is 1 beyond it."""
    d = np.ones(K + 1)
    for k in range(K, 0, -1):
        if not all(n[r] for r in range(1, k + 2)):
            continue
        tail = (k + 1) * n[k + 1] / n[1]
        if tail >= 1:
            continue
        found = np.array([((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, k + 1)])
        if ((found > 0) & (found < 1)).all():
            d[1 : k + 1] = found
            break
    return d


@dataclass(frozen=True)
class Unigrams:
    """What a first count tells: tokens, vocabulary, documents of training; discounts; the hot words (sorted keys) and their counts."""

    tokens: int
    words: int
    docs: int
    d: np.ndarray
    unknown: float
    hot: np.ndarray
    hot_counts: np.ndarray

    def p(self, c: np.ndarray) -> np.ndarray:
        """P(w) by the word's count."""
        c = np.asarray(c, float)
        known = (1 - RESERVED) * self.d[np.minimum(c, K).astype(int) * (c <= K)] * c / max(1, self.tokens)
        return np.where(c > 0, known, self.unknown)


def held_out(doc_id: Column, parts: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(True))


def _range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each key: equal ranges of the key space, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about BLOCK_BYTES of text and their texts as UTF-8 (null: empty): only one slice's texts are Python objects at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends, a = np.cumsum(sizes, dtype=np.int64), 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_BYTES, "right")))
            part = batch.slice(a, b - a)
            yield part, [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
            a = b


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of _ROW."""
    kind, target, block, body = zip(*rows, strict=True)
    return pa.record_batch([pa.array(kind, pa.string()), pa.array(target, pa.int64()), pa.array(block, pa.int64()), pa.array(body, pa.binary())], names=_COLUMNS)


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _blocks(x.filter(pc.invert(x.column("held"))) for x in batches):
            keys, starts = word_keys(texts)
            u, n = np.unique(np.concatenate((keys, np.full(len(starts) - 1, END))), return_counts=True)
            p = _range_of(u, parts)
            cut = runs(p)
            yield _batch([("words", p[a], 0, bundle(np.diff(u[a:b], prepend=np.uint64(0)), n[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)])

    return run


def _count_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one range of words: ("n", r, n_r), ("all", distinct, tokens) and ("hot", key, count) of its most frequent ones."""
    told = [unbundle(x) for x in pdf["body"]]
    keys, n = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in told]), np.concatenate([x[1] for x in told])
    u, i = np.unique(keys, return_inverse=True)
    c = np.bincount(i, n).astype(np.int64)
    rows = [("all", len(u), int(c.sum()))] + [("n", r, int((c == r).sum())) for r in range(1, K + 2)]
    rows += [("hot", int(u[j].view(np.int64)), int(c[j])) for j in np.argsort(-c, kind="stable")[:64]]
    rows += [("docs", 0, int(c[u == END].sum()))]
    return pd.DataFrame(rows, columns=["what", "a", "b"])


def count_unigrams(docs: DataFrame, parts: int) -> Unigrams:
    counted = docs.select("text", "held").mapInArrow(_count_words(parts), _ROW).groupBy("target").applyInPandas(_count_counts, "what string, a long, b long")
    counted = stored(counted, "unigrams")
    sums = {(r["what"], r["k"]): (r["a"], r["b"]) for r in counted.where("what != 'hot'").groupBy("what", F.when(F.col("what") == "n", F.col("a")).alias("k")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    words, tokens = sums.get(("all", None), (0, 0))
    n = [0] + [sums.get(("n", r), (0, 0))[1] for r in range(1, K + 2)]
    d = discounts(n)
    left = 1 - (1 - RESERVED) * (1 - sum((1 - d[r]) * r * n[r] for r in range(1, K + 1)) / tokens) if tokens else 1.0
    hot = counted.where((F.col("what") == "hot") & (F.col("b") * HOT_SHARE * parts >= tokens) & (F.col("b") * HOT_WORDS >= tokens)).select("a", "b").collect()  # HOT_WORDS at most
    hot = np.array(sorted((np.int64(r["a"]).view(np.uint64), r["b"]) for r in hot), np.uint64).reshape(-1, 2)
    return Unigrams(tokens, words, sums.get(("docs", None), (0, 0))[1], d, left, hot[:, 0].copy(), hot[:, 1].astype(np.int64))


def _send(parts: int, hot: np.ndarray):
    """documents -> for each block and partition one row with the block's distinct bigrams there; one row with the block's documents."""

    def block_rows(block: int, ids: np.ndarray, known: np.ndarray, held: np.ndarray, texts: list[bytes]) -> list[tuple]:
        order = np.argsort(held, kind="stable")  # training documents first: their number tells them apart
        ids, known, held, texts = ids[order], known[order], held[order], [texts[i] for i in order]
        keys, starts = word_keys(texts)
        n_docs = len(texts)
        ends = starts[1:] + np.arange(n_docs)
        w = np.empty(len(keys) + n_docs, np.uint64)
        is_end = np.zeros(len(w), bool)
        is_end[ends] = True
        w[is_end], w[~is_end] = END, keys
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[starts[:-1] + np.arange(n_docs)] = START
        n_tokens = np.diff(starts) + 1
        doc = np.repeat(np.arange(n_docs, dtype=np.uint64), n_tokens)
        n_train = int((~held).sum())
        rows = [("block", block % parts, block, bundle(ids.view(np.uint64), known, n_tokens, [n_train]))]
        u, i = np.unique(np.concatenate((w, [START])), return_inverse=True)
        wi, hi = i[:-1].astype(np.uint64), np.empty(len(w), np.uint64)
        hi[1:] = wi[:-1]
        hi[h == START] = i[-1]
        size = np.uint64(len(u))
        code, times = np.unique((wi * size + hi) * np.uint64(n_docs) + doc, return_counts=True)
        doc, gram = code % np.uint64(n_docs), code // np.uint64(n_docs)
        first = runs(gram)
        per, first = np.diff(first), first[:-1]
        gram = gram[first]
        wi, hi = (gram // size).astype(np.int64), (gram % size).astype(np.int64)
        at = _range_of(u, parts)
        p = np.where(np.isin(u, hot)[wi], at[hi], at[wi])
        order = np.argsort(p, kind="stable")
        cut = runs(p[order])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            g = order[a:b]
            ws = runs(wi[g])
            hs, hx = np.unique(hi[g], return_inverse=True)
            entry = np.repeat(first[g] - np.concatenate(([0], np.cumsum(per[g])[:-1])), per[g]) + np.arange(per[g].sum())
            body = bundle([n_train], np.diff(u[wi[g][ws[:-1]]], prepend=np.uint64(0)), np.diff(ws), np.diff(u[hs], prepend=np.uint64(0)), hx, per[g], doc[entry], times[entry])
            rows.append(("grams", int(p[g[0]]), block, body))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for block, (rows, texts) in enumerate(_blocks(batches), first):
            ids, held = rows.column("doc_id"), rows.column("held").to_numpy(zero_copy_only=False)
            yield _batch(block_rows(block, pc.fill_null(ids, 0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), held, texts))

    return run


def _merge(parts: int, uni: Unigrams):
    """One partition of words: its bigrams' counts, what their contexts gather, and the documents' sums.

    Messages are kept as they came; words and contexts are numbered by the messages' short lists of distinct keys, so that only
    small numbers are held for each bigram of each message, and rows are handed on as they are made."""

    def merged(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
        told = []
        for x in batches:
            for kind, target, block, body in zip(*(x.column(c) for c in _COLUMNS), strict=True):
                if kind.as_py() == "block":
                    yield "block", block.as_py(), block.as_py(), body.as_py()
                else:
                    told.append((target.as_py(), block.as_py(), memoryview(body.as_buffer()).cast("B")))
        if not told:
            return
        part = told[0][0]
        ws, hs, wx, hx, train = [], [], [], [], []
        for _, _, x in told:
            n_train, w, wn, h, at, per, doc, times = unbundle(x)
            ws.append(np.cumsum(w, dtype=np.uint64))
            hs.append(np.cumsum(h, dtype=np.uint64))
            wx.append(np.repeat(np.arange(len(w), dtype=np.int32), wn.astype(np.int64)))
            hx.append(at.astype(np.int32))
            train.append(np.add.reduceat(np.where(doc < n_train[0], times, np.uint64(0)), np.concatenate(([0], np.cumsum(per.astype(np.int64))[:-1]))).astype(np.int32))
        uw, uh = np.unique(np.concatenate(ws)), np.unique(np.concatenate(hs))
        message = np.cumsum([0] + [len(x) for x in wx])
        code = np.empty(message[-1], np.int64)
        for i, (a, b) in enumerate(zip(message[:-1], message[1:], strict=True)):
            code[a:b] = np.searchsorted(uw, ws[i])[wx[i]] * len(uh) + np.searchsorted(uh, hs[i])[hx[i]]
        del ws, hs, wx, hx
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = runs(code)
        gi = np.empty(len(code), np.int32)
        gi[order] = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        c = np.add.reduceat(np.concatenate(train)[order], first[:-1], dtype=np.int64)
        del train, order
        wi, hi = (x.astype(np.int32) for x in np.divmod(code[first[:-1]], len(uh)))
        del code, first
        cw = np.bincount(wi, c, len(uw)).astype(np.int64)
        known_hot = np.isin(uw, uni.hot)
        cw[known_hot] = uni.hot_counts[np.searchsorted(uni.hot, uw[known_hot])]

        held = c > 0
        gw, gh, gc = wi[held], hi[held], c[held]
        at = runs(gw)
        yield "counts", part, 0, bundle(np.diff(uw[gw[at[:-1]]], prepend=np.uint64(0)), cw[gw[at[:-1]]], np.diff(at), gh, np.diff(uh, prepend=np.uint64(0)), gc)
        yield from (("counts of counts", r, int((gc == r).sum()), b"") for r in range(1, K + 2))
        tot = np.bincount(gh, gc, len(uh)).astype(np.int64)
        of_r = [np.bincount(gh[gc == r], minlength=len(uh)) for r in range(1, K + 1)]
        mass = np.bincount(gh, uni.p(cw)[gw], len(uh))
        del held, gw, gh, gc
        some = np.flatnonzero(tot)
        target = _range_of(uh[some], parts)
        cut = runs(target)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s = some[a:b]
            yield "contexts", target[a], 0, len(s).to_bytes(8, "little") + mass[s].tobytes() + bundle(np.diff(uh[s], prepend=np.uint64(0)), tot[s], *[m[s] for m in of_r])
        del tot, of_r, mass, some

        # the documents' part: one block's message at a time
        log_p, target = np.log10(uni.p(cw)), _range_of(uh, parts)
        follows = np.where((uw != END) & (cw > 0), np.log10(np.maximum(cw, 1)), 0.0)  # each word but the end is the next token's context
        starts = np.where(uh == START, math.log10(max(1, uni.docs)), 0.0)
        blocks = np.array([x[1] for x in told], np.uint64)

        def unseen(held: list[tuple]) -> Iterator[tuple]:
            """For each range of contexts one row with what all these messages have there."""
            m, h, doc, times = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")  # and so by target
            cut = runs(target[h[order]])
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                e = order[x:y]
                hs, hx = np.unique(h[e], return_inverse=True)
                ms, mx = np.unique(m[e], return_inverse=True)
                yield "unseen", target[hs[0]], 0, bundle(np.diff(uh[hs], prepend=np.uint64(0)), hx, blocks[ms], mx, doc[e], times[e])

        new, n_new = [], 0
        for i, ((_, block, body), a, b) in enumerate(zip(told, message[:-1], message[1:], strict=True)):
            *_, per, doc, times = unbundle(body)
            each = np.repeat(gi[a:b], per.astype(np.int64))
            ce, we, he = c[each], wi[each], hi[each]
            ids, g = np.unique(doc, return_inverse=True)
            seen = ce > 0
            new.append((np.full(len(seen) - seen.sum(), i, np.int32), he[~seen], doc[~seen].astype(np.int32), times[~seen].astype(np.int32)))
            times = times.astype(float)
            score = np.where(seen, np.log10(np.maximum(ce, 1)) + math.log10(1 - RESERVED), log_p[we]) - follows[we] - starts[he]
            sums = [np.bincount(g, times * (cw[we] > 0)), *[np.bincount(g, times * (ce == r)) for r in range(1, K + 1)]]
            floats = [np.bincount(g, times * np.log10(cw[we] + BASE_ADD)), np.bincount(g, times * score)]
            yield "docs", block, block, len(ids).to_bytes(8, "little") + b"".join(x.tobytes() for x in floats) + bundle(ids, *sums)
            n_new += len(new[-1][0])
            if n_new > UNSEEN_MOST or i == len(told) - 1:
                yield from unseen(new)
                new, n_new = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in merged(list(batches)):
            rows.append(row)
            size += len(row[3])
            if size > SENT_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return run


def _weights(d: np.ndarray):
    """One range of contexts: its back-off weights (a row to keep), and what they add to documents that have bigrams training lacks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        told = pdf[pdf["kind"] == "contexts"]
        keys, mass, ints = [], [], []
        for x in told["body"]:
            n = int.from_bytes(x[:8], "little")
            mass.append(np.frombuffer(x, np.float64, n, 8))
            first, *rest = unbundle(x[8 + 8 * n :])
            keys.append(np.cumsum(first, dtype=np.uint64))
            ints.append(np.array(rest, np.float64))
        rows = []
        u, tot, log = np.empty(0, np.uint64), np.empty(0), np.empty(0)
        if keys:
            u, i = np.unique(np.concatenate(keys), return_inverse=True)
            ints = np.concatenate(ints, axis=1)
            tot, *m = (np.bincount(i, x) for x in ints)
            lower = np.bincount(i, np.concatenate(mass))
            saved = sum((1 - d[r]) * r * x for r, x in enumerate(m, 1)) / tot
            left = RESERVED + (1 - RESERVED) * saved
            log = np.log10(left / np.maximum(1 - lower, 1e-300))
            rows.append(("weights", int(pdf["target"].iloc[0]), 0, len(u).to_bytes(8, "little") + log.tobytes() + bundle(np.diff(u, prepend=np.uint64(0)), tot)))
        if not len(u):
            return pd.DataFrame(rows, columns=_COLUMNS)
        found, n_found, bodies = [], 0, pdf["body"][pdf["kind"] == "unseen"].to_list()
        for j, x in enumerate(bodies):
            hs, hx, blocks, bx, doc, times = unbundle(x)
            hs = np.cumsum(hs, dtype=np.uint64)
            at = np.minimum(np.searchsorted(u, hs), len(u) - 1)
            add = np.where(u[at] == hs, log[at] + np.log10(tot[at]), 0.0)
            found.append((blocks[bx.astype(np.int64)], doc.astype(np.int32), times.astype(float) * add[hx.astype(np.int64)]))
            n_found += len(doc)
            if n_found > UNSEEN_MOST or j == len(bodies) - 1:
                block, doc, value = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((doc, block))
                block, doc, value = block[order], doc[order], value[order]
                cut = runs(block)
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    first = runs(doc[a:b])[:-1]
                    rows.append(("backed", int(block[a]), int(block[a]), len(first).to_bytes(8, "little") + np.add.reduceat(value[a:b], first).tobytes() + bundle(doc[a:b][first])))
                found, n_found = [], 0
        return pd.DataFrame(rows, columns=_COLUMNS)

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(uni: Unigrams, d: np.ndarray):
    """The rows of one block's documents."""
    floor = math.log10(uni.tokens + BASE_ADD * (uni.words + 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, known, n_tokens, n_train = unbundle(pdf["body"][pdf["kind"] == "block"].iloc[0])
        n = len(ids)
        n_known, base, score = np.zeros(n), np.zeros(n), np.zeros(n)
        for x in pdf["body"][pdf["kind"] == "docs"]:
            m = int.from_bytes(x[:8], "little")
            b, s = np.frombuffer(x, np.float64, 2 * m, 8).reshape(2, m)
            at, k, *of_r = unbundle(x[8 + 16 * m :])
            at = at.astype(np.int64)
            n_known[at] += k
            base[at] += b
            score[at] += s + sum(c * math.log10(d[r]) for r, c in enumerate(of_r, 1))
        for x in pdf["body"][pdf["kind"] == "backed"]:
            m = int.from_bytes(x[:8], "little")
            score[unbundle(x[8 + 8 * m :])[0].astype(np.int64)] += np.frombuffer(x, np.float64, m, 8)
        out = pd.DataFrame({"doc_id": pd.array(ids.view(np.int64), "Int64"), "held_out": np.arange(n) >= n_train[0], "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64)})
        out.loc[known == 0, "doc_id"] = pd.NA
        return out.assign(train_tokens=uni.tokens, base_score=base - n_tokens.astype(float) * floor, score=score)

    return run


def katz_scores(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of _RESULT per document, the model's tables: rows of kind "counts" and "weights", by partition)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    uni = count_unigrams(docs, parts)
    sent = docs.mapInArrow(_send(parts, uni.hot), _ROW)
    merged = stored(sent.groupBy("target").applyInArrow(_merge(parts, uni), _ROW), "katz-counts", by="kind")
    n = {r["r"]: r["n"] for r in merged.where("kind = 'counts of counts'").groupBy(F.col("target").alias("r")).agg(F.sum("block").alias("n")).collect()}
    d = discounts([n.get(r, 0) for r in range(K + 2)])
    backed = stored(merged.where("kind in ('contexts', 'unseen')").groupBy("target").applyInPandas(_weights(d), _ROW), "katz-weights", by="kind")
    told = merged.where("kind in ('block', 'docs')").unionByName(backed.where("kind = 'backed'"))
    scores = told.groupBy("block").applyInPandas(_scores(uni, d), _RESULT)
    return scores, merged.where("kind = 'counts'").unionByName(backed.where("kind = 'weights'"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))[0]
