"""The audit of sources against a plain version: many sources, blocks of them, ties, nulls, repeated rows, long texts, empty tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least, ranks=50):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, by = Counter(), defaultdict(Counter)
        for x, source, words in docs:
            if x == lang:
                df.update(set(words))
                by[source].update(words)
        kept = [t for t, n in df.items() if n >= least]
        p = {}
        for s in by:
            size = sum(by[s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (by[s][t] + 5) // (size + 5 * len(kept)) for t in kept}
        whole = {t: sum(by[s][t] for s in by) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole.values()) + 5 * len(kept)) for t in kept}
        for s in by:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in by if o != s)
            terms = sorted((q[t] - p[s][t], t) for t in kept if by[s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, item, -v, r) for part, found in (("pair", pairs), ("term", terms)) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def corpus(n, sources, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "cé", "dX", "ü") for b in "fghijklmnopq"] + ["日本"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "!? 12 x-y", "\x00tab\tz"]), rng.choice(["en", "en", "de", None]), rng.choice([*sources, None])) for i in range(n)]
    return [*rows, *rows[:5], (None, None, None, None), (7, "", "fr", "only"), (8, "ab " * 60_000 + "é", "en", sources[0]), (9, "no kept term here", "xx", "a"), (10, None, "xx", "b")]


@pytest.mark.parametrize("block", [512, 3])
def test_divergence_is_the_plain_one(spark, block):
    rows = corpus(300, [f"s{i}" for i in range(9)])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("term", F.lit("clash"))
    got = D.divergence(docs, least=12, ranks=20, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 12, 20)


def test_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_of_a_block_and_small_blocks(spark):
    terms, term, of, text, counts = D.block_runs([b"b A a", b"", b"a", b"a b"], np.array([1, 1, 1, 2]))
    got = {(terms[t].decode(), int(g)): (int(x), int(d), int(n)) for t, g, x, d, n in zip(term, of, text, *counts, strict=True)}
    assert got == {("b", 1): (0, 1, 1), ("a", 1): (0, 2, 3), ("a", 2): (3, 1, 1), ("b", 2): (3, 1, 1)}
    rows = corpus(60, ["a", "b"])
    assert sorted(map(tuple, D.divergence(spark.createDataFrame(rows, SCHEMA), least=5, block_bytes=50, cells=1).collect())) == plain(rows, 5)


def test_shares_are_exact_beyond_64_bits():
    for count, of, terms in ((0, 0, 3), (7, 9, 2), (10**13, 2 * 10**13, 10**6), (9 * 10**17, 10**18, 10**9)):
        assert int(D.share(count, of, terms)) == 1 + 10**9 * (count + 5) // (of + 5 * terms)
    assert D.share(np.array([3]), 3, 0).tolist() == [1]
