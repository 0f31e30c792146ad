"""Quality classifier by co-training of two views: what a text holds, and what is known about it.

The text view has shares of character classes, of repeated words and lines, and of words by hashed groups (LEXICAL of them); a logistic
regression reads it. The metadata view has language, source and declared length (its power of two); its classifier adds the
smoothed log-likelihood ratio of each value, from counts over the training rows, in tables that hold every value that occurs.

In each of ROUNDS rounds both views label the documents that are still unlabelled, all of them: the best and the worst by log-odds,
in the labels' own proportion, of which the view is SURE, down to the log-odds at which about SHARE of the unlabelled
ones are passed (all documents of the last step of 0.01 are taken, so that no choice is made among equals). These become training rows of the
other view. Then both are calibrated (Platt) on every fourth labelled document, which neither has seen; their log-odds are added
(less the prior, which both hold), and the sum is calibrated again. All documents are scored where they are.

Fitting takes all labelled rows outside the held-out fold and all unlabelled rows; only weights, histograms of log-odds and counts of rows
reach the driver. Features are written to the shared folder once, and with the pseudo-labels in each round.

Defined cases: null text is empty; null language, source or length is a value of its own. Texts are read whole. Equal rows
score alike; each row of a repeated doc_id is a row of its own, with the id's label. Labels of one doc_id that differ are left out, null labels are none; a null doc_id has
no label and counts as held out. Values of language, source and length that training lacks add nothing. Without rows of both labels
everything is kept with score 1. Result columns replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, stored, table
from .words import encoded, word_keys

ROUNDS, SURE, SHARE = 3, 0.95, 0.05
LEXICAL, SMOOTHING, BINS, PENALTY = 48, 4.0, 100, 0.01

_CLASS = np.full(256, 6, np.uint8)  # symbols
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[*range(9, 14), 32]] = 3
_CLASS[[ord(x) for x in ".,;:'\"?-()"]] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 7
_CLASS[128:] = 8


def _shares(data: bytes, words: np.ndarray) -> list[float]:
    count = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9)
    lines = [x for x in data.split(b"\n") if x]
    n, w, marks = max(1, int(count.sum())), max(1, len(words)), max(1, len(words) + int(count[5] + count[6] + count[7]))
    lexical = np.bincount((words % np.uint64(LEXICAL)).astype(np.int64), minlength=LEXICAL)
    return [
        np.log1p(len(words)), n / w / 10, count[1] / max(1, count[0] + count[1]), count[2] / n, count[4] / w, count[5] / marks, count[6] / marks, count[7] / marks,
        float(count[6] > 0), float(count[7] > 0), 1 - len(np.unique(words)) / w, 1 - len(set(lines)) / max(1, len(lines)), min(5.0, w / max(1, len(lines)) / 50), float(not len(words)),
        *np.sqrt(lexical / w),
    ]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def text_view(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text view's features."""
    for batch in batches:
        out = []
        for text in encoded(batch):
            out.append(np.array(_shares(text, word_keys([text])[0]), np.float32))
        yield pd.Series(out, dtype=object)


#: The metadata view's values.
META = ("_qlang", "_qsource", "_qsize")


def with_views(docs: DataFrame) -> DataFrame:
    named = lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("null"))
    size = F.floor(F.log2(F.greatest(F.col("n_chars").cast("double"), F.lit(0.0)) + 1))
    values = dict(zip(META, (named(F.col("lang")), named(F.col("source")), named(F.when(F.col("n_chars").isNotNull(), size))), strict=True))
    return docs.withColumns({"_qx": text_view(F.col("text").cast("string")), **values})


@dataclass(frozen=True)
class Model:
    """text: the regression. meta: a table (view: a column of META, value, ratio: its log-likelihood ratio). base: the metadata view's log-odds
    without any value. calibration: slope and intercept of text, metadata and sum. prior: log-odds of the calibration rows."""

    text: LogisticRegressionModel
    meta: DataFrame
    base: float
    calibration: tuple[tuple[float, float], ...] = ((1.0, 0.0),) * 3
    prior: float = 0.0

    def odds(self, rows: DataFrame) -> DataFrame:
        """Adds _qt and _qm, the views' log-odds. The tables of values are as small as Spark's own size test for a broadcast says, or
        are joined by value; a hot value is split by the adaptive join then."""
        rows = self.text.transform(rows.withColumn("_qv", array_to_vector(F.col("_qx").cast("array<double>"))))
        rows = rows.withColumn("_qt", vector_to_array("_qr")[1]).drop("_qv", "_qr", "_qp", "_qc")
        names = [f"{key}_ratio" for key in META]
        for key, name in zip(META, names, strict=True):
            rows = rows.join(self.meta.where(F.col("view") == key).select(F.col("value").alias(key), F.col("ratio").alias(name)), key, "left")
        return rows.withColumn("_qm", sum((F.coalesce(c, F.lit(0.0)) for c in names), F.lit(self.base))).drop(*names)

    def calibrated(self) -> tuple[Column, Column, Column]:
        """Log-odds of text, metadata and both, of rows with _qt and _qm."""
        (a, b), (c, d), (e, f) = self.calibration
        t, m = a * _clipped(F.col("_qt")) + b, c * _clipped(F.col("_qm")) + d
        return t, m, e * _clipped(t + m - self.prior) + f


def _clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))


def _bin(x: Column) -> Column:
    return F.round(_clipped(x) * BINS).cast("int")


def platt(counted: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept that calibrate log-odds, from (log-odds, label, rows), by Newton's method with a slight pull to (1, 0)."""
    x, y, n = (np.array([r[i] for r in counted], float) for i in range(3))
    x, w, mean = np.stack((x, np.ones_like(x)), axis=1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(2), x.T @ (n * (y - p)) - (w - mean))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def surest(counted: list[tuple[int, int]], most: float, best: bool) -> int | None:
    """The bin down (or up) to which documents are taken: those of which the view is SURE, until ``most`` are passed. None: no bin."""
    sure, taken, at = round(math.log(SURE / (1 - SURE)) * BINS), 0, None
    for b, n in sorted(counted, reverse=best):
        if taken >= most or (b < sure if best else b > -sure):
            break
        taken, at = taken + n, b
    return at


def _fit(rows: DataFrame) -> Model:
    """Both views by their own training rows: labelled ones that aren't kept for calibration, and what the other view has labelled."""
    own = F.when(~F.col("kept"), F.col("y"))
    text = rows.select("_qx", F.coalesce(own, "to_text").cast("double").alias("_qy")).where("_qy is not null")
    meta = rows.select(*META, F.coalesce(own, "to_meta").alias("_qy")).where("_qy is not null")
    total = {r[0]: r[1] for r in meta.groupBy("_qy").count().collect()}
    regression = LogisticRegression(featuresCol="_qv", labelCol="_qy", rawPredictionCol="_qr", probabilityCol="_qp", predictionCol="_qc", regParam=PENALTY, maxIter=20)
    fitted = regression.fit(text.select("_qy", array_to_vector(F.col("_qx").cast("array<double>")).alias("_qv")))
    q = total[1] / (total[0] + total[1])
    values = F.explode(F.array(*[F.struct(F.lit(key).alias("view"), F.col(key).alias("value")) for key in META]))
    n = meta.select("_qy", values.alias("x")).groupBy("x.view", "x.value").agg(F.count_if(F.col("_qy") == 1).alias("good"), F.count_if(F.col("_qy") == 0).alias("bad"))
    ratio = F.log((F.col("good") + SMOOTHING * q) / (F.col("bad") + SMOOTHING * (1 - q))) - math.log(q / (1 - q))
    return Model(fitted, stored(n.select("view", "value", ratio.alias("ratio")), "ratios"), math.log(q / (1 - q)))


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """docs: doc_id, text, lang, source, n_chars. labels: doc_id, quality."""
    one = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("_hi")).where("y = _hi").drop("_hi")
    views = with_views(docs.select("doc_id", "text", "lang", "source", "n_chars")).select("doc_id", "_qx", *META)
    none = F.lit(None).cast("int")
    rows = views.join(one, "doc_id", "left").where(F.col("y").isNull() | ~held_out(F.col("doc_id")))  # held-out labels are not used, nor their documents
    rows = stored(rows.select("_qx", *META, "y", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, F.lit(False)).alias("kept"), none.alias("to_text"), none.alias("to_meta")), "views")
    known = {(r["kept"], r["y"]) for r in rows.where("y is not null").groupBy("kept", "y").count().collect()}
    if len({y for _, y in known}) < 2:
        return None
    if len(known) < 4:  # too few labels for a part of their own
        rows = rows.withColumn("kept", F.lit(False))
    share = rows.where("y is not null").agg(F.avg("y")).first()[0]
    for _ in range(rounds):
        model = _fit(rows)
        placed = model.odds(rows)
        free = F.col("y").isNull() & F.col("to_text").isNull() & F.col("to_meta").isNull()
        counted = placed.where(free).select(F.explode(F.array(F.struct(F.lit("t").alias("view"), _bin(F.col("_qt")).alias("b")), F.struct(F.lit("m").alias("view"), _bin(F.col("_qm")).alias("b")))).alias("x"))
        counts = [tuple(r) for r in counted.groupBy("x.view", "x.b").count().collect()]  # a row for each bin of each view
        pool = sum(n for view, _, n in counts if view == "t")
        taken = {}
        for view, odds in (("t", "_qt"), ("m", "_qm")):
            own = [(b, n) for v, b, n in counts if v == view]
            good, bad = surest(own, SHARE * pool * share, True), surest(own, SHARE * pool * (1 - share), False)
            label = F.lit(None).cast("int")
            if bad is not None:
                label = F.when(_bin(F.col(odds)) <= bad, 0).otherwise(label)
            if good is not None:
                label = F.when(_bin(F.col(odds)) >= good, 1).otherwise(label)
            taken[view] = label if (good, bad) != (None, None) else None
        if taken["t"] is None and taken["m"] is None:
            break
        new = {"to_meta": taken["t"], "to_text": taken["m"]}
        after = placed.withColumns({c: F.when(free, x).otherwise(F.col(c)) for c, x in new.items() if x is not None}).select(*rows.columns)
        after, before = stored(after, "views"), rows
        for frame in (model.meta, before):
            if hasattr(frame, "stored_at"):
                discard(frame)
        rows = after
    model = _fit(rows)
    return _calibrate(model, rows)


def _calibrate(model: Model, rows: DataFrame) -> Model:
    kept = F.col("kept") if rows.where("kept and y is not null").limit(1).count() else F.lit(True)
    placed = model.odds(rows.where(F.col("y").isNotNull() & kept)).select("y", "_qt", "_qm")

    def counted(x: Column) -> list[tuple[float, int, int]]:
        return [(r["b"] / BINS, r["y"], r["count"]) for r in placed.groupBy(_bin(x).alias("b"), "y").count().orderBy("b", "y").collect()]

    text, meta = counted(F.col("_qt")), counted(F.col("_qm"))
    good, bad = (sum(n for _, y, n in text if y == k) for k in (1, 0))
    model = Model(model.text, model.meta, model.base, (platt(text), platt(meta), (1.0, 0.0)), math.log((good + 0.5) / (bad + 0.5)))
    return Model(model.text, model.meta, model.base, (*model.calibration[:2], platt(counted(model.calibrated()[2]))), model.prior)


RESULT = ("text_score", "meta_score", "score")


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds text_score, meta_score, score (all the probability of label 1) and predicted (int)."""
    if model is None:
        return docs.withColumns({c: F.lit(1.0) for c in RESULT} | {"predicted": F.lit(1)})
    placed = model.odds(with_views(docs))
    own = [c for c in docs.columns if c not in (*RESULT, "predicted")]
    p = {c: 1 / (1 + F.exp(-_clipped(x))) for c, x in zip(RESULT, model.calibrated(), strict=True)}
    return placed.select(*own, *[x.alias(c) for c, x in p.items()]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text", "lang", "source", "n_chars"), learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "meta_score", "score", "predicted")
