"""The calibration and the choice of pseudo-labels against plain versions; repeated rows, clashing columns and null ids."""

import numpy as np
from pyspark.sql import functions as F

from netquarry.llm import quality as Q

from .test_operators import labelled


def test_platt_finds_slope_and_intercept():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 2, 40_000), 2)
    y = rng.random(len(x)) < 1 / (1 + np.exp(-(0.5 * x + 1)))
    a, b = Q.platt([(v, int(t), 1) for v, t in zip(x, y, strict=True)])
    assert abs(a - 0.5) < 0.03 and abs(b - 1) < 0.05


def test_surest_takes_whole_bins_of_sure_rows():
    assert Q.surest([(900, 5), (800, 5), (700, 5), (100, 50)], 7, True) == 800
    assert Q.surest([(900, 5), (100, 50)], 70, True) == 900 and Q.surest([(100, 50)], 70, True) is None
    assert Q.surest([(-900, 5), (-800, 5), (0, 9)], 3, False) == -900 and Q.surest([], 3, False) is None


def test_repeated_rows_nulls_and_clashing_columns(spark):
    docs, labels = labelled(spark, 240)
    docs = docs.unionByName(docs.where("doc_id < 40")).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    clash = docs.withColumns({"score": F.lit("x"), "_other": F.lit(1)})
    labels = labels.unionByName(spark.createDataFrame([(2, 0, 0), (2, 1, 0), (None, 1, 0)], labels.schema))
    got = Q.score_quality(clash, Q.learn(clash, labels))
    assert got.count() == 281 and got.columns == [c for c in clash.columns if c != "score"] + ["text_score", "meta_score", "score", "predicted"]
    assert got.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("score").alias("n")).where("n > 1").count() == 0
    assert docs.select(Q.held_out(docs.doc_id).alias("h")).where("h is null").count() == 0


def test_metadata_views_teach_and_are_taught(spark):
    """Sources tell the label here, so unlabelled documents get labels from both views, without any bound on their number."""
    rows = [(i, ("fine words of prose number %d" % i) if i % 2 else "$$$ ||| ### %d" % i, "en", "good" if i % 2 else "bad", 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = Q.score_quality(docs, Q.learn(docs, labels)).collect()
    assert all((r.predicted == 1) == (r.doc_id % 2 == 1) for r in got)
    assert min(abs(r.meta_score - 0.5) for r in got) > 0.2
