"""The Katz model against a plain Python version, and its normalisation."""

import math
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from netquarry.llm import katz

DOCS = [(i, t) for i, t in enumerate(
    ["the cat sat on the mat", "the cat sat on the hat", "a dog sat", "The Cat", "", None, "the the the the", "a dog sat on a log\nthe end", "é ü the cat", "rare words only here"] * 3
    + ["new cat sat", "the dog sat on the sofa", "nothing known at all"] * 4
)]


def brute(docs):
    words = lambda t: re.findall(r"[^ \t\n\v\f\r]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + ["</s>"]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, t in docs:
        if not held(i):
            w = words(t)
            uni.update(w)
            for h, x in zip(["<s>", *w[:-1]], w):
                bi[h, x] += 1
                ctx[h] += 1
    of = lambda c: [0] + [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]
    du, db, keep, n = katz.discounts(of(uni)), katz.discounts(of(bi)), 1 - katz.RESERVED, sum(uni.values())
    dis = lambda d, c: d[c] if c <= katz.K else 1.0
    known = {w: keep * dis(du, c) * c / n for w, c in uni.items()}
    unknown = 1 - sum(known.values())
    p1 = lambda w: known.get(w, unknown)
    after = {h: {w for a, w in bi if a == h} for h in ctx}
    alpha = {h: (1 - sum(keep * dis(db, bi[h, w]) * bi[h, w] / ctx[h] for w in after[h])) / (1 - sum(p1(w) for w in after[h])) for h in ctx}
    p2 = lambda h, w: keep * dis(db, bi[h, w]) * bi[h, w] / ctx[h] if (h, w) in bi else alpha.get(h, 1.0) * p1(w)
    for h in [*ctx, "never seen"]:
        assert sum(p2(h, w) for w in [*uni, "<unk>"]) == pytest.approx(1, abs=1e-9)
    v = len(uni)
    for i, t in docs:
        w = words(t)
        yield (i, held(i), len(w), sum(x in uni for x in w), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p2(h, x)) for h, x in zip(["<s>", *w[:-1]], w)))


@pytest.mark.parametrize("part_bytes,hot", [(1 << 25, 10_000), (40, 10_000), (40, 1)])
def test_scores_are_those_of_the_plain_version(spark, monkeypatch, part_bytes, hot):
    monkeypatch.setattr(katz, "PART_BYTES", part_bytes)
    monkeypatch.setattr(katz, "HOT_WORDS", hot)
    docs = [*DOCS, (None, "the cat"), (0, "the cat sat on the mat")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("extra", katz.F.lit(1))
    df = katz.stored(df, "docs")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted((tuple(r) for r in katz.katz_scores(df)[0].collect()), key=key)
    want = sorted(brute(docs), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-12)


def test_discounts():
    n = [0, 100, 40, 20, 12, 8, 6]
    d = katz.discounts(n)
    assert all(0 < x < 1 for x in d[1:])
    # Katz's condition: the mass that is taken from counts up to K is that of one unseen mass, n1
    assert sum(n[r] * r * (1 - d[r]) for r in range(1, 6)) == pytest.approx(n[1])
    assert (katz.discounts([0] * 7) == 1).all()


def test_empty_table(spark):
    assert katz.katz_scores(spark.createDataFrame([], "doc_id long, text string"))[0].collect() == []


def test_without_training_rows(spark):
    row = katz.katz_scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string"))[0].first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_a_merge_takes_little_memory(monkeypatch):
    """One partition's messages of several blocks: what is held beside them, and at once handed on, stays small."""
    words = np.random.Generator(np.random.PCG64(1)).zipf(1.3, 1_000_000) % 100_000
    ids = np.arange(1000)
    text = [" ".join(map(str, x)) for x in words.reshape(1000, -1)]
    docs = katz.pa.record_batch([katz.pa.array(ids), katz.pa.array(text), katz.pa.array(ids % 10 == 0)], names=["doc_id", "text", "held"])
    monkeypatch.setattr(katz, "BLOCK_BYTES", 1 << 19)
    monkeypatch.setattr(katz, "SENT_BYTES", 1 << 19)
    monkeypatch.setattr(katz.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    hot = np.empty(0, np.uint64)
    uni = katz.Unigrams(len(words), 50_000, 900, katz.discounts([0] * 7), 1e-4, hot, hot.astype(np.int64))
    sent = list(katz._send(1, hot)([docs]))
    assert len(sent) > 5
    size = sum(x.nbytes for x in sent)
    tracemalloc.start()
    try:
        before, most = tracemalloc.get_traced_memory()[0], 0
        for x in katz._merge(1, uni)(iter(sent)):
            most = max(most, x.nbytes)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert peak < 8 * size  # 12.5 times where whole arrays of keys were held
    assert most < size / 2


def test_unseen_bigrams_of_all_messages_share_rows(monkeypatch):
    """Bigrams that training lacks are handed on by range of contexts, not by range and message: else rows grow with the cube of the input."""
    text = [f"w{i} x{i % 7} y{i}" for i in range(400)]
    docs = katz.pa.record_batch([katz.pa.array(range(400)), katz.pa.array(text), katz.pa.array([i % 2 == 0 for i in range(400)])], names=["doc_id", "text", "held"])
    monkeypatch.setattr(katz, "BLOCK_BYTES", 100)
    monkeypatch.setattr(katz.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    hot = np.empty(0, np.uint64)
    uni = katz.Unigrams(800, 500, 200, katz.discounts([0] * 7), 1e-4, hot, hot.astype(np.int64))
    sent = katz.pa.Table.from_batches(katz._send(3, hot)([docs])).filter(katz.pc.field("target") == 1)
    rows = [kind for x in katz._merge(3, uni)(iter(sent.to_batches())) for kind in x.column("kind").to_pylist()]
    assert rows.count("docs") > 30
    assert 0 < rows.count("unseen") <= 3


def test_scores_where_rows_are_handed_on_in_small_lots(spark, monkeypatch):
    monkeypatch.setattr(katz, "PART_BYTES", 400)
    monkeypatch.setattr(katz, "UNSEEN_MOST", 2)
    monkeypatch.setattr(katz, "SENT_BYTES", 50)
    df = katz.stored(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5), "docs")
    got = sorted(tuple(r) for r in katz.katz_scores(df)[0].collect())
    want = sorted(brute(DOCS))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-12)
