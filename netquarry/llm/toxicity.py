"""Toxicity by a weighted finite-state pattern grammar.

Words map to classes: insults, mild insults (words that also have a harmless sense) and threats (fixed lists, and whatever words the
labelled rows show to mark toxic texts, in any language), targets, intents, copulas, negations, reporting verbs, words that mention a
word, and verbs that take a mild insult in its literal sense. A text is cut into clauses, and over each runs a cascade of transducers:

* four markers rewrite insults and threats that stand in their scope: negated (a few words, up to a pause), reported (to the clause's
  end), mentioned ("the word idiot") and literal ("take out the trash");
* the last reads the marked symbols and gives the clause's patterns: a threat needs a target after it, and is a stronger pattern
  with an intent before it; an insult "at target" has a target in its clause or a copula before it; two insults without a mark in one
  clause are "heaped"; other insults are patterns of their own.

They are composed on the fly: states of the composition are tuples of their states, and arcs are kept once made. Each pattern has a
weight (log-odds), a clause the greatest weight among its patterns (the best path), and a text the logistic of the base and the
clauses' weights, less and less for further clauses of the same pattern. So words score only as parts of patterns of clauses; what an
insult without any target weighs is learned like all weights.

Learning: the labelled rows outside the held-out fold, about TRAIN_ROWS of them at most (by hashed ids). Words are counted by
document with Spark; a word enters the lexicon if it occurs in enough toxic documents and seldom in others (which bounds their
number by that of the sample's words). Weights and base are the maximum of the labels' likelihood and a normal prior around fixed
values, over the sample's counted pattern sets; so every pattern is learned as far as it is seen.
Only texts and labels of those rows are used: never lang, source or ids.

Defined cases: null and empty texts match nothing and get the base score. Texts are scored whole. Rows with equal texts have
equal scores; repeated labels count once, rows labelled both ways are left out of learning; null labels are no labels; a null doc_id
counts as held out. Patterns of one clause with equal weights: the first by name. Without any labelled rows the fixed lists and
weights decide. Result columns replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table, thinned

TRAIN_ROWS = 20_000
#: A learned word occurs in so many toxic training texts at least, in that share of them, and so many times likelier than in others.
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_RATIO = 4, 0.015, 25.0

#: The classes' own words.
WORDS = {
    "insult": "idiot moron scum loser stupid worthless pathetic disgusting fool imbecile",
    "mild": "trash clown",
    "threat": "kill hurt destroy smash beat burn shoot stab",
    "target": "you your you're he she they they're them him her u du ihr tu vous tú usted ustedes",
    "intent": "will shall gonna going i'll we'll i'd must",
    "copula": "is are am was were be been ist bist sind est es sont eres son",
    "negation": "not no never nobody isn't aren't wasn't don't nicht kein keine pas jamais nunca",
    "report": "said says say told wrote writes claimed claims quoted according sagte schrieb dit écrit dijo escribió",
    "mention": "word words term terms name noun adjective wort mot palabra",
    "literal": "take took takes taking throw threw throws put puts empty emptied collect collected sort bag hire hired circus",
}
INSULTS = ("insult", "mild", "learned")  # learned: words that the labels show
CORE = frozenset((*INSULTS, "threat"))
PAUSE, OTHER = "pause", "other"
CLASSES = (*WORDS, "learned", PAUSE, OTHER)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[,:()\[\]\"“”«»–—]")
_CLAUSE = re.compile(r"[.!?;\n]+")


@dataclass(frozen=True)
class Marker:
    """A transducer over (class, mark) symbols: ``opens`` begins a scope of so many symbols (None: to the clause's end), ``closes`` ends it;
    symbols of ``marks`` inside it get the mark, unless they have one that it does not replace. A state is what is left of the scope."""

    mark: str
    opens: str
    scope: int | None
    marks: frozenset[str]
    closes: frozenset[str] = frozenset()
    replaces: bool = False

    def step(self, state: int, symbol: tuple[str, str]) -> tuple[int, tuple[str, str]]:
        kind, mark = symbol
        if kind == self.opens:
            return self.scope or 1, symbol
        if kind in self.closes:
            return 0, symbol
        if state and kind in self.marks and (self.replaces or not mark):
            symbol = kind, self.mark
        return state if self.scope is None else max(0, state - 1), symbol


MARKERS = (
    Marker("negated", "negation", 4, CORE, frozenset((PAUSE,))),
    Marker("reported", "report", None, CORE),
    Marker("literal", "literal", 5, frozenset(("mild",)), frozenset((PAUSE,)), True),
    Marker("mentioned", "mention", 3, CORE, frozenset(("copula",)), True),
)
MARKS = ("", *sorted(m.mark for m in MARKERS))


class Patterns:
    """The last transducer. A state: whether a target, a copula, an intent were read; insults read (with the pattern's kind so far);
    threats that wait for a target; threats that have one; unmarked insults up to two."""

    start = (False, False, False, frozenset(), frozenset(), frozenset(), 0)

    @staticmethod
    def step(state: tuple, symbol: tuple[str, str]) -> tuple:
        target, copula, intent, insults, waiting, threats, plain = state
        kind, mark = symbol
        if kind in INSULTS:
            insults |= {(kind + " at target" if target or copula else kind, mark)}
            plain = plain if mark else min(2, plain + 1)
        elif kind == "threat":
            waiting |= {("threat with intent" if intent else "threat", mark)}
        elif kind == "target":
            target, threats, waiting = True, threats | waiting, frozenset()
            insults = frozenset((k if " " in k else k + " at target", m) for k, m in insults)
        copula, intent = copula or kind == "copula", intent or kind == "intent"
        return target, copula, intent, insults, waiting, threats, plain

    @staticmethod
    def final(state: tuple) -> frozenset[str]:
        heaped = frozenset((("insults heaped", ""),)) if state[6] == 2 else frozenset()
        return frozenset(f"{kind} {mark}".strip() for kind, mark in state[3] | state[5] | heaped)


#: The prior weights of patterns, of those with a mark, and of the base.
PRIOR = {"insult at target": 6.0, "insult": 4.0, "mild at target": 5.0, "mild": 2.5, "learned at target": 4.5, "learned": 4.5, "threat with intent": 6.0, "threat": 3.0, "insults heaped": 7.0}
PRIOR_MARKED, PRIOR_BASE = 0.5, -3.0
KINDS = tuple(sorted(f"{k} {m}".strip() for k in PRIOR for m in MARKS if not (m and k == "insults heaped")))


class Composed:
    """The composition of the markers and the pattern transducer: numbered states, arcs made when first taken."""

    def __init__(self):
        self.number = {(0,) * len(MARKERS) + Patterns.start: 0}
        self.states = list(self.number)
        self.arcs: list[dict[str, int]] = [{}]

    def step(self, state: int, kind: str) -> int:
        to = self.arcs[state].get(kind)
        if to is None:
            at, symbol, after = self.states[state], (kind, ""), []
            for marker, s in zip(MARKERS, at[: len(MARKERS)], strict=True):
                s, symbol = marker.step(s, symbol)
                after.append(s)
            key = (*after, *Patterns.step(at[len(MARKERS) :], symbol))
            to = self.number.get(key)
            if to is None:
                to = self.number[key] = len(self.states)
                self.states.append(key)
                self.arcs.append({})
            self.arcs[state][kind] = to
        return to

    def patterns(self, kinds: Iterable[str]) -> frozenset[str]:
        state = 0
        for kind in kinds:
            state = self.step(state, kind)
        return Patterns.final(self.states[state][len(MARKERS) :])


COMPOSED = Composed()


@dataclass(frozen=True)
class Grammar:
    """lexicon: word to class. weights: log-odds that a text's first clause of the pattern adds. base: of a text with none."""

    lexicon: dict[str, str]
    weights: dict[str, float]
    base: float
    core: frozenset[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "core", frozenset(w for w, c in self.lexicon.items() if c in CORE))

    def matched(self, text: str) -> list[frozenset[str]]:
        """The patterns of each clause that has any."""
        text = text.lower().replace("’", "'")
        if self.core.isdisjoint(_WORD.findall(text)):
            return []
        found = []
        for clause in _CLAUSE.split(text):
            tokens = _TOKEN.findall(clause)
            if not self.core.isdisjoint(tokens) and (p := COMPOSED.patterns(self.lexicon.get(t, OTHER) if t[0].isalpha() else PAUSE for t in tokens)):
                found.append(p)
        return found

    def best(self, found: list[frozenset[str]]) -> Counter:
        """How many clauses have each pattern as their best path."""
        return Counter(min(p, key=lambda k: (-self.weights[k], k)) for p in found)

    def score(self, best: Counter) -> float:
        x = self.base + sum(self.weights[k] * (1 + math.log(n)) for k, n in best.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fixed_lexicon() -> dict[str, str]:
    return {w: c for c, words in WORDS.items() for w in words.split()}


def fixed_weights() -> dict[str, float]:
    return {k: PRIOR.get(k, PRIOR_MARKED) for k in KINDS}


def fitted(seen: list[tuple[dict[str, int], int, int]], prior: dict[str, float], base: float, spread: float = 1.5) -> tuple[dict[str, float], float]:
    """Weights (none below 0) and base: logistic regression over (best patterns, toxic, rows), with normal priors of that spread."""
    names = sorted(prior)
    x = np.array([[1 + math.log(best[k]) if k in best else 0.0 for k in names] + [1.0] for best, _, _ in seen]).reshape(len(seen), len(names) + 1)
    y, n = (np.array([r[i] for r in seen], float) for i in (1, 2))
    mean = np.array([prior[k] for k in names] + [base])
    w = mean.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + ((w - mean) ** 2).sum() / (2 * spread**2))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - (w - mean) / spread**2
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2, slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return {k: max(0.0, float(v)) for k, v in zip(names, w[:-1], strict=True)}, float(w[-1])


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of a bounded number of labelled ids outside the held-out fold; equal texts of one label are one."""
    one = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_hi"))
    one = thinned(one.where("toxic = _hi").select("doc_id", F.col("toxic").cast("int").alias("toxic")), F.col("doc_id"), most)
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_key", F.xxhash64("text")).dropDuplicates(["_key", "toxic"]).drop("_key")  # at most `most` rows of two numbers


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Grammar:
    rows = training_rows(docs, labels, most)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                counts.update((w, int(toxic)) for w in set(_WORD.findall(text.lower().replace("’", "'") if isinstance(text, str) else "")))
                counts["", int(toxic)] += 1
            yield pd.DataFrame([(w, t, n) for (w, t), n in counts.items()], columns=["word", "toxic", "n"])

    rows = stored(rows, "training")
    counts = rows.mapInPandas(words, "word string, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("good")).fillna(0)
    counts = stored(counts, "words")
    total = counts.where("word = ''").first()
    bad, good = (total["bad"], total["good"]) if total else (0, 0)
    lexicon = fixed_lexicon()
    if not (bad and good):
        return Grammar(lexicon, fixed_weights(), PRIOR_BASE)
    ratio = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    # each is in LEAST_SHARE of the toxic texts, so their number is at most the mean toxic text's words / LEAST_SHARE
    marks = counts.where((F.col("word") != "") & (F.col("bad") >= max(LEAST_DOCUMENTS, LEAST_SHARE * bad)) & (ratio >= LEAST_RATIO)).select("word")
    for r in marks.collect():
        lexicon.setdefault(r["word"], "learned")
    plain = Grammar(lexicon, fixed_weights(), PRIOR_BASE)

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [plain.best(plain.matched(text if isinstance(text, str) else "")) for text in batch["text"]]
            yield pd.DataFrame({"patterns": ["; ".join(f"{k}: {n}" for k, n in sorted(x.items())) for x in best], "toxic": batch["toxic"].astype("int32")})

    # at most one row for each training row
    seen = rows.mapInPandas(patterns, "patterns string, toxic int").groupBy("patterns", "toxic").agg(F.count("*").alias("n")).orderBy("patterns", "toxic").collect()
    parsed = [({k: int(n) for k, n in (x.rsplit(": ", 1) for x in r["patterns"].split("; ") if x)}, r["toxic"], r["n"]) for r in seen]
    return Grammar(lexicon, *fitted(parsed, fixed_weights(), PRIOR_BASE))


def score_toxicity(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """Adds score (double), predicted (int) and clauses (string: the clauses' best patterns with their counts)."""

    @F.pandas_udf("score double, clauses string")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [grammar.best(grammar.matched(x if isinstance(x, str) else "")) for x in batch]
            yield pd.DataFrame({"score": np.array([grammar.score(x) for x in found], float), "clauses": ["; ".join(f"{k}: {n}" for k, n in sorted(x.items())) for x in found]})

    return docs.withColumn("_scored", scored(F.col(text))).withColumns({
        "score": F.col("_scored.score"), "predicted": (F.col("_scored.score") >= 0.5).cast("int"), "clauses": F.col("_scored.clauses"),
    }).drop("_scored")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "clauses")
