"""Objects out of large JSON files that are split anywhere, and fingerprints, against the standard library."""

import json
import random

import pytest
from pyspark.sql import functions as F

from netquarry.sources import containers


def shape(x, depth=0):
    out = []
    for k in sorted(x):
        v = x[k]
        out.append(f"{k}:{{{shape(v, depth + 1)}}}" if isinstance(v, dict) and depth < 3 else f"{k}:{'list' if isinstance(v, list) else type(v).__name__}")
    return ",".join(out)


def thing(rng, depth=0):
    text = lambda: "".join(rng.choice('ab{}[]",\\\n é}') for _ in range(rng.randrange(8)))
    kinds = [text, lambda: rng.randrange(99), lambda: 1.5, lambda: None, lambda: True, lambda: [text(), {"x": text()}], lambda: {}]
    return {f"k{i}{rng.choice(['', '.z', ' y'])}": thing(rng, depth + 1) if depth < 5 and rng.random() < 0.3 else rng.choice(kinds)() for i in range(rng.randrange(5))}


@pytest.mark.parametrize("block", [90, 1 << 20])
def test_objects_of_arrays_split_anywhere(spark, tmp_path, block):
    rng = random.Random(block)
    files = {f"f{i}.json": [thing(rng) for _ in range(rng.randrange(1, 25))] for i in range(3)}
    for i, (name, items) in enumerate(files.items()):
        text = json.dumps(items, indent=[None, 1][i % 2], ensure_ascii=bool(i % 3)) if i else "\n".join(json.dumps(x) for x in items)
        (tmp_path / name).write_text(text + "\n" * (i % 2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        records, failures = containers.read_objects(spark, str(tmp_path))
        assert failures.isEmpty()
        got = {}
        for r in records.withColumn("shape", containers.fingerprint(F.col("raw"))).collect():
            got.setdefault(r.source.rsplit("/", 1)[1], {})[r.place] = (json.loads(r.raw), r.shape)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {name: [x for _, (x, _) in sorted(own.items())] for name, own in got.items()} == files
    for own in got.values():
        assert all(s == shape(x) for x, s in own.values())


def test_what_is_no_record(spark, tmp_path):
    (tmp_path / "a.json").write_text('[1, {"a": "x"}, null, {"b": "' + "y" * 500 + '"}, "z", {"c": {"d": 1}} , {"open": {"e": 2}')
    records, failures = containers.read_objects(spark, str(tmp_path), most=100)
    assert sorted((r.place, json.loads(r.raw)) for r in records.collect()) == [(1, {"a": "x"}), (3, {"c": {"d": 1}})]
    assert sorted(r.reason for r in failures.collect()) == ["no object", "no object", "no object", "not closed", "too long"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "empty.json").write_text("[]")
    records, failures = containers.read_objects(spark, str(tmp_path / "b"))
    assert records.isEmpty() and failures.isEmpty()


def test_fingerprints_of_texts(spark):
    rows = {
        'CEF:0|V|P|1.0|x|y|3|src=1': "CEF|V|P|1.0", "CEF:0|V": "CEF|Malformed", "<34>1 2024 h": "SYSLOG|RFC5424", "<34>Oct 11 h": "SYSLOG|RFC3164", "a b  c": "TEXT|3_words", "  ": "TEXT|EMPTY", "": "TEXT|EMPTY",
        '{"a": 1': "TEXT|2_words", "[1]": "TEXT|1_words", None: None, "{}": "", ' {"b": {"c": []}, "a": 1.5} ': "a:float,b:{c:list}",
    }
    df = spark.createDataFrame([(x,) for x in rows], "raw string")
    assert {r.raw: r.f for r in df.select("raw", containers.fingerprint(F.col("raw")).alias("f")).collect()} == rows
