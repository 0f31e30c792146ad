"""The grammar against a plain reading of its definition, and single sentences."""

import random

import pytest

from netquarry.llm import toxicity as T

PLAIN = T.Grammar(T.fixed_lexicon(), T.fixed_weights(), T.PRIOR_BASE)


def plain_patterns(kinds):
    """Each marker over the whole clause by its definition, then each insult and threat by looking at the whole clause."""
    marks = [""] * len(kinds)
    for m in T.MARKERS:
        for i, kind in enumerate(kinds):
            if kind not in m.marks:
                continue
            opened = [j for j in range(i) if kinds[j] == m.opens]
            closed = [j for j in range(i) if kinds[j] in m.closes]
            near = opened and (m.scope is None or i - opened[-1] <= m.scope) and (not closed or closed[-1] < opened[-1])
            if near and (m.replaces or not marks[i]):
                marks[i] = m.mark
    out = set()
    for i, kind in enumerate(kinds):
        if kind in T.INSULTS:
            out.add(f"{kind}{' at target' if 'target' in kinds or 'copula' in kinds[:i] else ''} {marks[i]}".strip())
        if kind == "threat" and "target" in kinds[i:]:
            out.add(f"threat{' with intent' if 'intent' in kinds[:i] else ''} {marks[i]}".strip())
    if sum(kind in T.INSULTS and not mark for kind, mark in zip(kinds, marks)) > 1:
        out.add("insults heaped")
    return out


def test_composition_is_the_plain_reading():
    rng = random.Random(1)
    for _ in range(4000):
        kinds = rng.choices(T.CLASSES, k=rng.randint(0, 12))
        assert T.Composed().patterns(kinds) == T.COMPOSED.patterns(kinds) == plain_patterns(kinds), kinds


@pytest.mark.parametrize("text,toxic", [
    ("take out the trash", 0), ("the word idiot is old", 0), ("I will not wait, you idiot", 1), ("you are an idiot", 1), ("you are not an idiot", 0), ('She said: "you idiot"', 0), ("I will kill you", 1),
    ("will kill", 0), ("They beat the eggs", 0), ("you're trash", 1), ("pathetic loser", 1), ("the words idiot and moron are old", 0), ("You IDIOT!", 1), ("", 0), ("window", 0), ("he said no. you moron", 1), ("We took the trash out, he saw", 0), ("x " * 50_000 + "you idiot", 1),
])
def test_sentences(text, toxic):
    assert (PLAIN.score(PLAIN.best(PLAIN.matched(text))) >= 0.5) == bool(toxic), PLAIN.matched(text)


def test_weights_are_learned_for_what_is_seen():
    prior = T.fixed_weights()
    seen = [({}, 0, 1000), ({}, 1, 10), ({"insult negated": 1}, 1, 40), ({"mild": 2}, 0, 40), ({"insult": 1}, 1, 30)]
    weights, base = T.fitted(seen, prior, T.PRIOR_BASE)
    assert weights["insult negated"] > 3 and weights["mild"] < 1.5 and weights["insult"] > 4 and weights["threat"] == pytest.approx(3) and base < -3.5


def test_repeated_rows_labels_both_ways_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(["you idiot", "fine text", None, ""] * 10)] + [(None, "fine", "x", "y"), (0, "you idiot", "x", "y")], "doc_id long, text string, clauses string, predicted string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(20)] + [(0, 1), (1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = T.score_toxicity(docs, T.learn(docs, labels)).collect()
    assert len(got) == 42 and {(r.text, r.predicted) for r in got} == {("you idiot", 1), ("fine text", 0), (None, 0), ("", 0), ("fine", 0)}
    assert docs.select(T.held_out(docs.doc_id).alias("h")).where("h is null").count() == 0
    one = T.training_rows(docs, labels).collect()
    assert sorted((r.text or "", r.toxic) for r in one) == sorted(set((r.text or "", r.toxic) for r in one)) or len(one) == len({(r.text, r.toxic) for r in one})
