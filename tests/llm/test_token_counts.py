"""Counts by cache against the library on whole texts; hits, misses and half appends of the cache; nulls, blanks, long texts, copies, empty tables."""

import pytest
from pyspark.sql import functions as F

from netquarry.llm import token_counts as T

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["", None, "Hello   world", " Hello\tworld\n", "don't STOP'S 12345 x", "<|endoftext|> a <|startoftext|>b", "<|ENDOFTEXT|> a", "a b c\x1cd\x85e\x0bf", "é ́x H̱ İİ", "日本語のテキスト 🙂🙂", "word " * 40_000, "x" * 5_000, "naïve café\r\nZ", "Hello world"]


def whole(name, text):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        return len(Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids)
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode(text or ""))


@pytest.mark.parametrize("name,blanks", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False), ("piece_bpe_32k.model", False)])
def test_counts_are_those_of_whole_texts(spark, tmp_path, name, blanks):
    model = T.Model(public_tokenizers.path(name))
    assert model.blanks == blanks
    rows = [(i if i % 5 else None, x) for i, x in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("digest", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    got = T.count_tokens(docs, model, str(tmp_path / "c"), limit=100).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    want = sorted(((i, len((x or "").encode()), whole(name, x)) for i, x in rows), key=key)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path):
    model, cache = T.Model(public_tokenizers.path("word_bpe_49k.json")), str(tmp_path / "cache")
    docs = lambda texts: spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    T.count_tokens(docs(["a b", " a  b ", "c"]), model, cache).collect()
    batches = T._appended(spark, f"{cache}/version={model.version}")
    assert len(batches) == 1 and spark.read.parquet(*batches).count() == 2
    got = T.count_tokens(docs(["c", "a\nb", "d e f", "d e f"]), model, cache).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(0, 1), (1, 2), (2, 3), (3, 3)]
    batches = T._appended(spark, f"{cache}/version={model.version}")
    assert sorted(spark.read.parquet(x).count() for x in batches) == [1, 2]
    T.count_tokens(docs(["c", "a b"]), model, cache).collect()
    assert len(T._appended(spark, f"{cache}/version={model.version}")) == 2
    (tmp_path / "cache" / f"version={model.version}" / "batch=half").mkdir()  # an append that was not committed
    spark.read.parquet(batches[0]).write.parquet(f"{cache}/version={model.version}/batch=again")  # and one that came twice
    assert len(T._appended(spark, f"{cache}/version={model.version}")) == 3
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(docs(["c", "a b", None]), model, cache).collect()} == {0: 1, 1: 2, 2: 0}


def test_words_beyond_what_a_task_keeps(spark, tmp_path):
    model = T.Model(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"w{j}" for j in range(i, i + 6)) + " " + "y" * 70 for i in range(40)]
    rows = spark.createDataFrame([(x.encode(), x) for x in texts], "digest binary, content string").coalesce(1)
    got = {bytes(r.digest).decode(): r.n_tokens for r in T.encode_misses(rows, model, str(tmp_path / "c"), kept=3).collect()}
    assert got == {x: whole("word_bpe_49k.json", x) for x in texts}


def test_other_tokenizers_have_other_versions_and_empty_tables(spark, tmp_path):
    a, b = T.Model(public_tokenizers.path("word_bpe_49k.json")), T.Model(public_tokenizers.path("byte_bpe_50k.json"))
    assert a.version != b.version
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), a, str(tmp_path / "c")).count() == 0
