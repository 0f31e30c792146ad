"""Suffix arrays and collocations against plain counts: nulls, marks, long texts, repeated rows, ties, empty tables, several shards."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, longest=3, least=10, top=2000):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, own in f.items():
        words = sum(c for p, c in own.items() if len(p) == 1)
        cand = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in cand.items():
            score, _, left, r = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * c >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in cand.items()):
                found.append((-score, -a, " ".join(p).encode(), left, r))
        out += [(lang, i, p.decode(), -a, left, r, words, -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "é", "日本", "x-1", "a\x1cb", "\x00"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ? ", "\r\n"]) for _ in range(rng.randint(0, 25)))
    rows = [(i, text(), rng.choice(["en", "en", "de", None])) for i in range(n)]
    return [*rows, *rows[:9], (None, None, None), (5, "", "fr"), (6, "one two three " * 30_000, "en"), (7, "!?.,\n\n", "fr"), (8, "rare words here", "fr")]


@pytest.mark.parametrize("shard", [8 << 20, 400])
def test_collocations_are_the_plain_ones(spark, shard):
    rows = corpus(250)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("phrase", F.lit("clash"))
    got = C.collocations(C.phrase_counts(docs, shard_bytes=shard))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and dict(got.dtypes)["rank"] == "bigint"
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_longer_phrases_and_few_ranks(spark):
    rows = corpus(120, 4)
    got = C.collocations(C.phrase_counts(spark.createDataFrame(rows, SCHEMA), longest=5, least=6), top=15)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 6, 15)


def test_a_full_filter_only_passes_more(spark):
    rows = corpus(80, 7)
    assert sorted(map(tuple, C.collocations(C.phrase_counts(spark.createDataFrame(rows, SCHEMA), filter_bits=64)).collect())) == plain(rows)


def test_empty_table(spark):
    assert C.collocations(C.phrase_counts(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffix_arrays_and_intervals(depth):
    rng = np.random.default_rng(depth)
    for _ in range(30):
        ids = rng.integers(0, 4, rng.integers(0, 60))
        order, lcp = C.suffix_array(ids, depth)
        assert sorted(order.tolist()) == list(range(len(ids)))
        padded = ids.tolist() + [0] * depth
        at = [next((k for k in range(depth) if padded[i + k] == 0), depth) for i in range(len(ids))]
        for a, b, n in zip(order[:-1], order[1:], lcp[1:], strict=True):
            same = next((k for k in range(depth) if padded[a + k] != padded[b + k]), depth)
            assert n == min(same, at[a], at[b])
        for n in range(1, depth + 1):
            want = Counter(tuple(padded[i : i + n]) for i in range(len(ids)) if at[i] >= n)
            places, f = C.intervals(ids, order, lcp, n)
            got = [(tuple(padded[p : p + n]), c) for p, c in zip(places.tolist(), f.tolist(), strict=True)]
            assert len(got) == len(dict(got)) and dict(got) == dict(want)
