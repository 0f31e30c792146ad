"""Small fixtures against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import components, decontamination, jaccard_join, licenses, media, quality, shared, toxicity, url_filters, warc

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(60)]


def sentence(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


# --- URL filters


def test_url_rules_and_terms(spark):
    rows = [(1, "https://WWW.Example.net/en/x?q#f"), (2, "http://example.net/e"), (3, "http://notexample.net/"), (4, "http://a.example.com/de/x"), (5, "http://x.org/fr/"), (6, None), (7, "no scheme"), (8, "http://a.b/xxx-y"),
            (9, "http://a.b/xxxy"), (10, "http://a.b/free-free"), (11, "http://a.b/free?bonus"), (12, "http://net/"), (13, "http://a.b/" + "x" * 50_000), (1, "https://WWW.Example.net/en/x?q#f")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df).collect()}
    assert got[1] == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/e", "net/", "block") and got[3][2:] == ("net/", "block") and got[12][2:] == ("net/", "block")
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert [got[i][3] for i in (8, 9, 10, 11, 13)] == ["block", "allow", "allow", "block", "allow"]
    assert url_filters.filter_urls(df.limit(0)).count() == 0


# --- Licences


def test_licenses(spark):
    rows = [(1, "Some text here.\nReleased under the MIT License.\nMore."), (2, "Licensed under the Apache License, Version 2.0."), (3, "His driver's license was revoked."), (4, None), (5, ""), (6, sentence(5000)),
            (7, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."), (1, "Some text here.\nReleased under the MIT License.\nMore."), (None, "plain words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan_licenses(df, licenses.learn(df)).groupBy("row", "doc_id").agg(F.array_sort(F.collect_set("family")).alias("f")).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r.f for r in found}
    assert got[1] == ["mit"] and got[2] == ["apache-2.0"] and got[3] == [] and got[4] == got[5] == got[6] == got[None] == [] and got[7] == ["cc-by-nc-4.0", "gpl-3.0"]
    assert licenses.scan_licenses(df.limit(0), licenses.learn(df)).count() == 0


def test_hyphenated_and_wrapped_licenses_are_those_of_an_ungated_run(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction"
    rows = [(1, "Content is CC-BY-SA 4.0."), (2, mit), (3, 'of this software and associated documentation files (the "Software"), to deal'), (4, "To the extent possible under law, the author\nhas waived all related rights to this work"),
            (5, "Released under the MIT License\nThis work is licensed under the GNU General Public License, version 3"), (6, sentence(50) + "\n" + sentence(60)), (7, "The copyright office\nopened of the software"), (8, None), (9, "under the\n\nby the of the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.learn(df)
    found = lambda gated: sorted((r.doc_id, r.passage or "", r.family, round(r.confidence, 6)) for r in licenses.scan_licenses(df, model, gated=gated).where("family IS NOT NULL").collect())
    got = found(True)
    assert got == found(False)
    of = {i: {f for d, _, f, _ in got if d == i} for i, _ in rows}
    assert of == {1: {"cc-by-sa-4.0"}, 2: {"mit"}, 3: {"mit"}, 4: {"cc0-1.0"}, 5: {"mit", "gpl-3.0"}, 6: set(), 7: set(), 8: set(), 9: set()}
    assert len([1 for d, *_ in got if d == 2]) == 1


def test_the_model_tells_unlisted_licences_from_other_texts(spark):
    none = [*licenses.OTHERS, "The driver asked for a warranty and a license.", "Permission was given to the teacher after the accident.", sentence(40)]
    unknown = ["This code may be used, copied, modified and sold by anyone at no cost.", "This program may be used, copied, modified and sold by anyone for any purpose.", "Licensed under a custom license.", "Permission to use, copy, modify and distribute this program for any purpose is hereby granted."]
    rows = [(i, x) for i, x in enumerate(none + unknown)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("passage", "words", "best", "p_best", "p_other", "family", "likeness")})
    got = licenses.scan_licenses(df, licenses.learn(df))
    of = {r.doc_id: r.family for r in got.where("family IS NOT NULL").collect()}
    assert of == {len(none) + i: "unknown" for i in range(len(unknown))}, {rows[i][1]: f for i, f in of.items()}
    assert not any(w in x.lower() for x in unknown[:2] for w in ("licen", "permission", "warrant", "copyright"))


# --- Decontamination


def brute_decontamination(docs, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if w]
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            x = words(text)
            n = min(10, len(x))
            windows = {tuple(x[a : a + n]) for a in range(len(x) - n + 1)} if x else set()
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    names.add(str(item))
        yield (i, len(w), len(hit), sorted(names))


def test_decontamination_is_that_of_the_plain_version(spark):
    items = [(i, sentence(n)) for i, n in enumerate([3, 5, 9, 10, 11, 25, 30])] + [(7, None), (8, "..."), (9, "a a a a a a a a a a a a"), (10, "solo")]
    items.append((11, items[5][1]))
    docs = [(i, sentence(RNG.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{sentence(4)} {(t or '').upper()} {sentence(3)} {t or ''}") for i, t in items] + [(200, None), (201, ""), (202, "A" + " a" * 30), (203, items[5][1][:-8]), (None, items[3][1]), (204, "x " * 20_000 + items[3][1])]
    docs.append(docs[-1])
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, words string")
    rows, hits = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(brute_decontamination(docs, items), key=key)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows.collect()), key=key)
    # rows with equal doc_id and text are reported each
    assert got == want
    assert rows.count() == len(docs)


def test_decontamination_without_items(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    rows, _ = decontamination.contamination(df, spark.createDataFrame([], "item_id long, text string"))
    assert [(r.doc_id, r.n_words, r.n_hit) for r in rows.collect()] == [(1, 2, 0)]


# --- Jaccard join


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split(r"[ \t\n\v\f\r]+", low(t)) if x]
        n = min(5, len(w))
        s = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
        if i not in sets or len(s) > len(sets[i]):
            sets[i] = s
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def near_copies():
    docs, i = [], 0
    for n in [1, 2, 4, 5, 6, 8, 12, 15, 18, 25, 40, 80]:
        for _ in range(4):
            base = sentence(n).split()
            for _ in range(5):
                copy = list(base)
                for _ in range(RNG.randint(0, 2)):
                    copy[RNG.randrange(len(copy))] = RNG.choice(VOCABULARY)
                docs.append((i, " ".join(copy)))
                i += 1
    return docs


@pytest.mark.parametrize("part_bytes,block_bytes", [(1 << 24, 1 << 22), (3_000, 2_000)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, part_bytes, block_bytes):
    monkeypatch.setattr(jaccard_join, "PART_BYTES", part_bytes)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", block_bytes)
    docs = [*near_copies(), (900, None), (901, ""), (902, "the same"), (903, "The  SAME"), (904, sentence(4000)), (902, "the same")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df).collect())
    assert got == brute_components(docs)


def test_light_sets_are_linked_by_their_subsets(spark, monkeypatch):
    """Long lists of small sets make enumeration the cheaper way; and with it alone (no set is heavy) all links are found."""
    assert jaccard_join.boundary([(3, 100, 10_000), (8, 100, 1_000_000), (16, 10, 30)]) == 8
    docs = [(i, t) for i, t in near_copies() if len(t.split()) <= 12]
    monkeypatch.setattr(jaccard_join, "boundary", lambda sizes: 8)
    monkeypatch.setattr(jaccard_join, "_may_link", lambda light: F.lit(False))
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute_components(docs) and any(i != c and n < 9 for i, n, c in got)
    assert len({t for i, t in docs if any(i == j and j != c for j, _, c in got)}) > 3


def test_hot_classes_change_nothing(spark, monkeypatch):
    docs = [*near_copies(), *((2000 + i, "the same few words in many copies of it") for i in range(200))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "HOT_CLASSES", 4)
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(df).collect()) == brute_components(docs)


def test_jaccard_of_no_rows_and_no_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(empty).collect() == []
    row = jaccard_join.jaccard_components(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first()
    assert (row.doc_id, row.n_shingles, row.component_id) == (None, 1, None)


def test_two_equal_blocks_stay_two(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 10)
    rows = [(1, "a b c d e f"), (1, "a b c d e f")]
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()) == [(1, 2, 1)]


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (None, 3), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {500: 500, 501: 500}


# --- Media


def test_media_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "é" * 50_000), (5, "x" * 64), (3, "short")]
    df = media.with_media(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text").cast("binary"))
    for r in media.with_features(df).withColumn("back", media.decode_png("media")).collect():
        own = (r.text or "").encode()
        padded = own + bytes(-len(own) % 64 or (0 if own else 64))
        assert bytes(r.back) == own and r.payload_bytes == len(padded) and r.n_bytes == len(own) and r.payload_sha256 == hashlib.sha256(padded).hexdigest()


def test_png_filters_and_broken_images():
    rows = np.random.default_rng(1).integers(0, 256, (12, 9), dtype=np.uint8)
    kinds = np.array([0, 1, 2, 3, 4, 4, 2, 2, 1, 3, 0, 4])
    filtered = np.zeros_like(rows)
    for y in range(12):
        for x in range(9):
            a = int(rows[y, x - 1]) if x else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min(((abs(p - v), i, v) for i, v in enumerate((a, b, c))))[2]][kinds[y]]
            filtered[y, x] = (int(rows[y, x]) - guess) & 255
    assert (media.unfilter(kinds, filtered) == rows).all()
    data = media.png_encode(b"hello")
    for bad in (data[:-1], data[:40] + bytes([data[40] ^ 1]) + data[41:], b"x" + data[1:]):
        with pytest.raises(ValueError):
            media.png_decode(bad)


# --- WARC


def test_warc_round_trip(spark):
    rows = [(i, f"http://a/{i}", h) for i, h in enumerate(["<p>a</p>", None, "", "<p>b</p>" * 9000, "<p>a</p>", "ü", "<p>a</p>"])] + [(6, None, "<p>a</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(shared.stored(warc.write_archives(df, archive_bytes=500), "t")).collect())
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", 0), i)
    want = sorted((i, *(("response", None) if best[h or ""] == i else ("revisit", best[h or ""])), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows)
    assert got == want
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_broken_archives_are_told():
    data = warc.record(1, "u", b"payload")
    frame = warc.zstandard.ZstdCompressor(write_checksum=True).compress(data)
    assert next(warc.read_archive(frame))[0] == 1
    for bad in (frame[:-3], b"junk" + frame, warc.zstandard.ZstdCompressor().compress(data.replace(b"payload\r\n\r\n", b"pay\r\n\r\n"))):
        with pytest.raises((ValueError, warc.zstandard.ZstdError)):
            list(warc.read_archive(bad))


# --- Classifiers


def labelled(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        good = i % 3 != 0
        text = sentence(30) + (". You are an idiot and a worthless clown." if toxic else ".") + ("" if good else " $$$ !!! ### CLICK ||| NOW " * 4)
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
        if i % 2 == 0 or toxic:
            labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows_and_odd_texts(spark):
    docs, labels = labelled(spark)
    grammar = toxicity.learn(docs, labels)
    got = toxicity.score_toxicity(docs.withColumn("held", toxicity.held_out(F.col("doc_id"))), grammar).where("held").collect()
    assert np.mean([(r.predicted == 1) == (r.doc_id % 4 == 0) for r in got]) > 0.95
    odd = toxicity.score_toxicity(spark.createDataFrame([(1, None), (2, ""), (3, sentence(20_000)), (4, "you are not an idiot"), (5, 'She said: "you idiot"')], "doc_id long, text string").withColumn("score", F.lit("clash")), grammar).collect()
    assert len(odd) == 5 and all(0 <= r.score <= 1 for r in odd) and odd[0].predicted == odd[1].predicted == odd[2].predicted == 0
    assert "negated" in odd[3].clauses and "reported" in odd[4].clauses
    assert toxicity.score_toxicity(docs.limit(0), toxicity.learn(docs.limit(0), labels.limit(0))).count() == 0


def test_quality_on_held_out_rows_and_odd_rows(spark):
    docs, labels = labelled(spark)
    model = quality.learn(docs, labels)
    got = quality.score_quality(docs.withColumn("held", quality.held_out(F.col("doc_id"))), model).where("held").collect()
    assert np.mean([(r.predicted == 1) == (r.doc_id % 3 != 0) for r in got]) > 0.9
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (3, "x " * 50_000, "en", "s", 100_000)], docs.schema)
    assert all(0 <= r.score <= 1 for r in quality.score_quality(odd, model).collect())
    assert [r.predicted for r in quality.score_quality(odd, quality.learn(odd, labels.limit(0))).collect()] == [1, 1, 1]
    assert quality.score_quality(docs.limit(0), model).count() == 0
