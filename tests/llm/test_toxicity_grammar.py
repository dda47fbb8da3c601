"""Toxicity grammar: composed transducers against reading each layer in turn, verdicts turned, learned weights, edges."""

import random

import numpy as np
import pytest

from loom.llm import toxicity as tox
from loom.llm.toxicity import EVENTS, INTERCEPT, PRIOR, Model, clause_weight, fit_weights, reject_toxic, score_toxicity

LEXICON = {"scum": 8.0, "vequ*": 6.0}


def score(text, model=None):
    model = model or Model(LEXICON, PRIOR, INTERCEPT)
    return model.score(tox._events(model.lexicon)(text))


def by_layers(symbols):
    """Events of a clause, every layer written out by its definition over whole lists."""
    negated, out, reach, spoken = [], [], 0, False
    for s in symbols:
        negated.append(s in "IV" and reach > 0)
        reach = (0 if reach else tox.SCOPE) if s == "N" else max(0, reach - 1)
    marked = []
    for s, n in zip(symbols, negated):
        marked.append((s, ("n" if n else "") + ("r" if spoken and s in "IV" else "")))
        spoken = spoken or s == "R"
    taken = set()          # positions that a target or an address has used up
    for at, (s, marks) in enumerate(marked):
        near = None
        for back in range(at - 1, -1, -1):
            if marked[back][0] in "TIV":
                near = back if at - back <= tox.NEAR + 1 and back not in taken else None
                break
        before = marked[near] if near is not None else ("", "")
        if s == "T":
            if before[0] == "I":
                out.append("D" + before[1])
            if before[0] == "V":
                out.append("X" + before[1])
        if s == "I":
            out.append("I" + marks)
            if before[0] == "T":
                out.append("D" + marks)
                taken.add(at)
        if s == "V":
            out.append("V" + marks)
            if before[0] == "T":
                out.append("P" + marks)
    return sorted(out)


def test_composition_equals_the_layers_in_turn():
    rng = random.Random(5)
    for _ in range(5000):
        symbols = rng.choices(tox.SYMBOLS, k=rng.randint(0, 14))
        state, out = 0, []
        for s in symbols:
            state, events = tox.TABLE[state][s]
            out += [EVENTS[e] for e in events]
        assert sorted(out) == by_layers(symbols), symbols


def test_negation_report_and_threat_turn_a_verdict():
    assert score("You scum!") >= 0.7 and score("scum") >= 0.7
    assert score("You are not scum.") < 0.7 and score("She said scum.") < 0.7
    assert score("You are never not scum.") >= 0.7                     # a second negation lifts the first
    assert score("You are not scum. You scum.") >= 0.7                 # negation ends with its clause
    assert score("I will kill you.") >= 0.7 and score("Kill the process.") < 0.7
    assert score("I won't kill you.") < 0.7 and score("He wrote I will kill you.") < 0.7
    assert score("burn them and smash them") >= 0.7
    assert score("vequtra") > score("plain words") and score(None) == score("") == score(" \n")


def test_weights():
    plain = clause_weight(["such", "scum"], LEXICON)
    assert clause_weight(["you", "scum"], LEXICON) > plain == 8.0
    assert clause_weight(["not", "you"], LEXICON) == 0


def test_a_clause_without_marks_is_read_to_its_end():
    assert score("she said " + "word " * 5000 + "scum") < 0.7          # the report is 25,000 characters before the insult
    assert score("word " * 200_000 + "you scum") >= 0.7
    assert score("x" * 1_000_000) < 0.7


def test_learned_weights_leave_the_prior_only_with_evidence():
    found, bad = [], []
    for k in range(400):                                               # here negated insults are toxic, plain ones aren't
        row = np.zeros(len(EVENTS))
        row[EVENTS.index("In" if k % 2 else "I")] = 6.0
        found.append(row)
        bad.append(float(k % 2))
    weights, intercept = fit_weights(np.array(found), np.array(bad), np.ones(400))
    learned = Model(LEXICON, weights, intercept)
    assert score("not scum", learned) > 0.7 > score("scum", learned)
    assert weights[EVENTS.index("X")] == pytest.approx(PRIOR[EVENTS.index("X")])
    once = np.unique(np.array(found), axis=0)                          # weighted rows equal repeated rows
    again, _ = fit_weights(once, np.array([0.0 if r[0] else 1.0 for r in once]), np.full(2, 200.0))
    assert np.allclose(weights, again, atol=1e-6)


def test_edges(spark):
    rows = [(k, f"plain words number {k % 7}. " + ("You utter scum, go." if k % 4 == 0 else "All is fine."), int(k % 4 == 0))
            for k in range(200)]
    odd = [(900, None, None), (901, "", None), (None, "you scum", None), (5, rows[5][1], None), (5, rows[5][1], None),
           (902, "word " * 50_000 + "scum", None)]
    df = spark.createDataFrame([(i, t, y, "a", 0.5, "b") for i, t, y in rows + odd],
                               "doc_id long, text string, toxic int, bad string, score double, found string")
    train = df.filter("doc_id < 120 and toxic is not null")
    got = score_toxicity(df, train).collect()
    assert len(got) == len(df.collect())
    per = {}
    for r in got:
        per.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in per.values())                      # repeated rows score alike
    assert per[900] == per[901] and max(per[900]) < 0.7
    assert min(per[None]) >= 0.7 and min(per[902]) >= 0.7
    kept = reject_toxic(df, train)
    assert kept.columns == df.columns and kept.count() == len(got) - 50 - 2
    none = df.limit(0)
    assert score_toxicity(none, train).count() == 0 == reject_toxic(none, train).count()
    assert score_toxicity(none, none).count() == 0
    one_class = score_toxicity(df, train.filter("toxic = 1")).collect()
    assert max(r.score for r in one_class) < 0.7
    # the same model from other partitions and another order
    again = {r.doc_id: r.score for r in score_toxicity(df, train.orderBy("text").repartition(5)).collect()}
    assert all(again[i] == pytest.approx(min(s)) for i, s in per.items())
