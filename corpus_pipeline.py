"""The corpus pipeline: STAGES of (name, function); each takes (spark, docs, sf_dir) and returns the documents that it keeps.

All stages but the last return the columns of documents as they came; the last adds the encoded text. Between stages a run writes
to the cluster's shared folder, so a lost executor costs at most a part of one stage.

Defined cases: an empty table stays empty through all stages. Null and empty texts are judged by the quality stage like any other.
Repeated rows of one doc_id are one document in the near-duplicate stage (one row stays: that of the longest, then least text);
rows without doc_id are no duplicates of anything there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netquarry.llm import decontamination, jaccard_join, pieces, quality, toxicity
from netquarry.llm.shared import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier predicts to be good."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not predict to be toxic."""
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, grammar).where("predicted = 0").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one with the least id."""
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    # only rows of repeated ids are sorted; these ids are stored, so that Spark knows whether they are few
    repeated = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    one = W.partitionBy("doc_id").orderBy(F.desc_nulls_last(F.length("text")), "text")
    several = kept.join(repeated, "doc_id", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(several).unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    _, hits = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    bad = stored(hits.select("doc_id", "text_key").distinct(), "hits")  # its size is known then: if small, no text is shuffled
    same = keyed["doc_id"].eqNullSafe(bad["doc_id"]) & (keyed["_key"] == bad["text_key"])
    return keyed.join(bad, same, "left_anti").select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their piece ids (binary) and number, and whether decoding gives the text back."""
    model = pieces.load()
    out = pieces.round_trip(docs, model)
    return out.withColumn("lossless", F.col("text").eqNullSafe(F.col("decoded"))).drop("decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", pieces_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
