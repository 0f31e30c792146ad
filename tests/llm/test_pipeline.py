"""The pipeline's stages on a small folder of tables: each stage's decision against the operator's plain version."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_operators import brute_components, brute_decontamination, labelled, sentence  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs, labels = labelled(spark, 300)
    item = sentence(20)
    more = [(1000, f"{sentence(10)} {item} {sentence(5)}."), (1001, "one two three four five six seven eight nine ten eleven."), (1002, "one two three four five six seven eight nine ten eleven.")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in more], docs.schema))
    docs.coalesce(1).write.parquet(f"{top}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns and docs.count() <= before.count()
        kept[name] = before, docs
    before, after = kept["n-gram Jaccard join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, _, c in brute_components(rows) if i == c)
    before, after = kept["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r[0] for r in brute_decontamination([(r.doc_id, r.text) for r in before.collect()], items) if r[2] == 0)
    last = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect())
    assert all(r.lossless and len(r.ids) == 4 * r.n_pieces for r in last)


def test_repeated_ids_null_ids_and_null_texts(spark, folder):
    """Of one id the longest, then least text stays; rows without id stay; null texts are no duplicates; other columns are untouched."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_key string, component_id string"
    same = "one two three four five six seven eight"
    rows = [(1, same, "en", "s", 1, "a", "b"), (1, same + " nine", "en", "s", 2, "a", "b"), (1, same + " nine", "en", "s", 2, "a", "b"), (2, same + " nine", "en", "s", 3, "a", "b"), (None, same, "en", "s", 4, "a", "b"), (3, None, None, None, None, None, None), (4, "", "en", "s", 0, "a", "b")]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    got = stages["n-gram Jaccard join"](spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in got.collect()) == [(0, same, 4), (1, same + " nine", 2), (3, "", 0), (4, "", 0)]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    more = docs.unionByName(spark.createDataFrame([(5, f"x {item} y", "en", "s", 9, "a", "b"), (None, f"z {item}", "en", "s", 9, "a", "b")], schema))
    assert stages["benchmark decontamination"](spark, more, folder).count() == docs.count()


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
