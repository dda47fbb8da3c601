"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses (parted by sentence marks and line feeds).  The words of a clause become symbols: insult (I, of its
learned strength), threat (V), target (T), negation (N), reported speech (R), other (.).  Three transducers then rewrite
the symbols one after the other, and their composition is what runs:

* negation marks insults and threats among the ``SCOPE`` words after a negation (a second negation lifts it);
* report marks insults and threats after a verb of speech, up to the clause's end;
* address pairs them with targets: an insult within ``NEAR`` words of a target (D), a target before a threat (P), a threat
  that reaches a target (X), each with the marks of its insult or threat.

A clause scores the weights of the events that the composed machine writes - never isolated words, and a bare insult is
the event I - and a text's log-odds are an intercept and the sum of its clauses.

Both parts of the model are learned from labelled training rows, over a bounded sample (``max_labelled`` rows, chosen by
hash).  The insult lexicon: document frequencies of words and of word stems, per class.  The events' weights: logistic
regression drawn towards ``PRIOR``, so events without evidence keep their prior weight; negation, report and threat can each
turn a verdict.  The closed word lists are fixed.  Labels are used only of rows the caller marks as training rows;
language, source and id are no inputs.

An entry needs ``MIN_SHARE`` of the toxic training rows, so the lexicon holds at most 1 / MIN_SHARE times the mean number of
words and stems of a toxic training text.  Scoring is one pass over the whole texts in Arrow batches, without a shuffle.

Defined results: NULL, empty and blank texts score like a text without any event; repeated rows score alike; no labels or
only one class give an empty lexicon, the prior weights and a low score to texts without threats; empty tables give empty
results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged, text_of

MAX_LABELLED = 20_000      # documented bound of the labelled training sample
STEM = (4, 5, 6)           # lengths of the stems tried besides whole words
MIN_TOXIC = 3              # toxic training documents a lexicon entry needs
MIN_SHARE = 0.005          # ... and the least share of all toxic training documents
MIN_ODDS = 4.0             # natural log of the least odds ratio of an entry
MIN_GAIN = 16.0            # likelihood ratio statistic (G2) of an entry against chance
SCOPE = 3                  # words that a negation reaches
NEAR = 3                   # words between an insult or a threat and its target
PULL = 4.0                 # how strongly the events' weights are drawn to their prior

# Closed word classes of the grammar.
THREAT = frozenset("kill hurt burn destroy beat shoot hang crush punish smash stab strangle".split())
TARGET = frozenset("you your yours yourself u he she him her they them their this these those everyone people".split())
NEGATION = frozenset("not no never nobody none neither nor isnt arent wasnt dont doesnt didnt wont cannot cant".split())
REPORTED = frozenset("said says say quoted quotes quote called claims claimed wrote writes reported allegedly".split())

CLAUSE = re.compile(r"[.!?;:\n]+")
WORDS = re.compile(r"[^\W_]+")
APOSTROPHE = re.compile(r"(?<=\w)['\u2019](?=\w)")
CLOSED = {**dict.fromkeys(THREAT, "V"), **dict.fromkeys(TARGET, "T"), **dict.fromkeys(NEGATION, "N"),
          **dict.fromkeys(REPORTED, "R")}
SYMBOLS = "IVTNR."

# Prior weights by event; I counts in strengths (log odds of its entry), all others in occurrences.
PLAIN = {"I": 1.0, "D": 0.5, "V": 0.3, "P": 0.3, "X": 5.0}
MARKS = {"": 1.0, "n": 0.25, "r": 0.35, "nr": 0.25}
EVENTS = [kind + mark for kind in PLAIN for mark in MARKS]
PRIOR = np.array([PLAIN[e[0]] * MARKS[e[1:]] for e in EVENTS])
INTERCEPT = math.log(0.02)


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: step(state, symbol) gives the next state and the symbol written."""
    start: object
    step: Callable[[object, str], tuple[object, str]]


def _negation(state: int, symbol: str) -> tuple[int, str]:
    if symbol == "N":
        return (0 if state else SCOPE), symbol
    return max(0, state - 1), symbol + "n" if state and symbol in "IV" else symbol


def _report(state: bool, symbol: str) -> tuple[bool, str]:
    return state or symbol == "R", symbol + "r" if state and symbol[0] in "IV" else symbol


def _address(state: tuple[str, int], symbol: str) -> tuple[tuple[str, int], str]:
    """State: what waits (target, insult or threat with its marks, or nothing) and for how many words more."""
    waits, left = state
    kind, marks = symbol[0], symbol[1:]
    if kind == "T":
        met = {"I": "D", "V": "X"}.get(waits[:1])
        return ("T", NEAR), met + waits[1:] if met else ""
    if kind == "I":
        return (("", 0), f"{symbol} D{marks}") if waits == "T" else ((symbol, NEAR), symbol)
    if kind == "V":
        return (symbol, NEAR), f"{symbol} P{marks}" if waits == "T" else symbol
    return (waits, left - 1) if left else ("", 0), ""


NEGATED = Transducer(0, _negation)
SPOKEN = Transducer(False, _report)
ADDRESSED = Transducer(("", 0), _address)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what ``second`` writes on reading what ``first`` writes."""
    def step(state: tuple, symbol: str) -> tuple[tuple, str]:
        one, written = first.step(state[0], symbol)
        two, out = second.step(state[1], written)
        return (one, two), out
    return Transducer((first.start, second.start), step)


def tabled(machine: Transducer, alphabet: str = SYMBOLS) -> list[dict[str, tuple[int, tuple[int, ...]]]]:
    """The machine's reachable states as a table: state -> symbol -> (next state, positions of the events written)."""
    number, table, todo = {machine.start: 0}, [], [machine.start]
    for state in todo:                                  # grows while it is read
        row = {}
        for symbol in alphabet:
            after, written = machine.step(state, symbol)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row[symbol] = number[after], tuple(EVENTS.index(e) for e in written.split())
        table.append(row)
    return table


GRAMMAR = compose(compose(NEGATED, SPOKEN), ADDRESSED)
TABLE = tabled(GRAMMAR)


def weight_of(word: str, lexicon: dict[str, float]) -> float:
    """Strength of an insult: the word's own entry, else that of its longest stem; 0 for other words."""
    own = lexicon.get(word)
    if own is not None:
        return own
    for n in reversed(STEM):
        if len(word) > n and (own := lexicon.get(word[:n] + "*")) is not None:
            return own
    return 0.0


def clause_events(words: Iterator[str], lexicon: dict[str, float], into: np.ndarray) -> None:
    """Adds the events of a clause to ``into``."""
    state, insult = 0, EVENTS.index("D")               # the events before D are those of I
    for w in words:
        own = weight_of(w, lexicon)
        state, events = TABLE[state]["I" if own else CLOSED.get(w, ".")]
        for e in events:
            into[e] += own if e < insult else 1.0


def clause_weight(words: list[str], lexicon: dict[str, float], weights: np.ndarray = PRIOR) -> float:
    found = np.zeros(len(EVENTS))
    clause_events(iter(words), lexicon, found)
    return float(found @ weights)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray
    intercept: float

    def score(self, found: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + float(found @ self.weights)))))


def _units(words: Column) -> Column:
    stems = [F.transform(F.filter(words, lambda w, n=n: F.char_length(w) > n),
                         lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEM]
    return F.array_distinct(F.concat(words, *stems))


def _sample(labelled: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """bad (0, 1) and text of at most about max_labelled rows; a hash of id and text decides, not order or partitions."""
    rows = labelled.filter(F.col(label_col).isNotNull()).select(
        (F.col(label_col) == 1).cast("long").alias("bad"), text_of(text_col).alias("text"), F.col(id_col).alias("id"))
    n = rows.count()
    if n > max_labelled:
        share = F.lit(max_labelled / n * 1_000_000)
        rows = rows.filter(F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1_000_000)) < share)
    return staged(rows.select("bad", "text"), "toxic-train")


def _lexicon(train: DataFrame, bad: int, good: int) -> dict[str, float]:
    """Entries (words, and stems with a star) that mark toxic texts, with their log odds."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
    seen = (train.select("bad", F.explode(_units(words)).alias("unit")).groupBy("unit")
            .agg(F.sum("bad").alias("in_bad"), F.sum(1 - F.col("bad")).alias("in_good")))
    odds = F.log((F.col("in_bad") + 0.1) / (bad + 0.2)) - F.log((F.col("in_good") + 0.1) / (good + 0.2))
    both = F.col("in_bad") + F.col("in_good")
    in_good = F.when(F.col("in_good") > 0, F.col("in_good") * F.log(F.col("in_good") * (bad + good) / (both * good)))
    gain = 2 * (F.col("in_bad") * F.log(F.col("in_bad") * (bad + good) / (both * bad)) + F.coalesce(in_good, F.lit(0.0)))
    top = (seen.filter(F.col("in_bad") >= max(MIN_TOXIC, math.ceil(MIN_SHARE * bad))).withColumn("odds", odds)
           .filter((F.col("odds") >= MIN_ODDS) & (gain >= MIN_GAIN)).select("unit", "odds").collect())
    lexicon = {r["unit"]: float(r["odds"]) for r in sorted(top, key=lambda r: r["unit"])
               if r["unit"] not in CLOSED}
    # a word's entry is redundant where its stem is an entry of the same strength
    for unit in [u for u in lexicon if not u.endswith("*")]:
        for k in STEM:
            if len(unit) > k and lexicon.get(unit[:k] + "*", -1.0) >= lexicon[unit] - 1.0:
                del lexicon[unit]
                break
    return lexicon


def fit_weights(found: np.ndarray, bad: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the events by Newton steps on the logistic loss plus the pull to the prior."""
    x = np.hstack([found, np.ones((len(found), 1))])
    prior = np.append(PRIOR, INTERCEPT)
    pull = np.append(np.full(len(PRIOR), PULL), 1.0)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(times @ (np.logaddexp(0, z) - bad * z) + 0.5 * pull @ (w - prior) ** 2)

    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (p - bad)) + pull * (w - prior)
        bend = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step, size, now = np.linalg.solve(bend, slope), 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(labelled: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int = MAX_LABELLED) -> Model:
    """Lexicon and event weights from labelled training rows."""
    train = _sample(labelled, id_col, text_col, label_col, max_labelled)
    sums = train.agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("all")).first()
    bad, good = int(sums["bad"] or 0), int(sums["all"] - (sums["bad"] or 0))
    if not bad or not good:
        return Model({}, PRIOR, INTERCEPT)
    lexicon = _lexicon(train, bad, good)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = _events(lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("bad"), pa.array([events(t.as_py()).tolist() for t in b.column("text")], pa.list_(pa.float64()))],
                names=["bad", "found"])

    # at most one row per row of the bounded sample
    rows = train.mapInArrow(described, "bad long, found array<double>").groupBy("bad", "found").count().collect()
    rows = sorted(rows, key=lambda r: (r["bad"], r["found"]))
    return Model(lexicon, *fit_weights(np.array([r["found"] for r in rows]), np.array([float(r["bad"]) for r in rows]),
                                       np.array([float(r["count"]) for r in rows])))


def _clauses(text: str) -> Iterator[tuple[int, int]]:
    left = 0
    for mark in CLAUSE.finditer(text):
        yield left, mark.start()
        left = mark.end()
    yield left, len(text)


def _events(lexicon: dict[str, float]) -> Callable[[str | None], np.ndarray]:
    """A function from a text to its counts of events; only clauses with an insult or a threat are read word by word."""
    import ahocorasick
    finder = ahocorasick.Automaton()
    for u in {*lexicon, *THREAT}:
        finder.add_word(u.rstrip("*"), (len(u.rstrip("*")), u.endswith("*") or u + "*" in lexicon))
    finder.make_automaton()

    def of(value: str | None) -> np.ndarray:
        text, found = APOSTROPHE.sub("", (value or "").lower()), np.zeros(len(EVENTS))
        spans, left, right, read = _clauses(text), 0, -1, False
        for last, (length, stem) in finder.iter(text):
            start = last - length + 1
            if (start and text[start - 1].isalnum()) or (not stem and text[last + 1:last + 2].isalnum()):
                continue
            while right <= start:                      # on to the clause that holds the hit
                left, right = next(spans)
                read = False
            if not read:
                clause_events((m.group() for m in WORDS.finditer(text, left, right)), lexicon, found)
                read = True
        return found

    return of


def score_toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> DataFrame:
    """doc_id and score (0..1) of every row of docs; ``labelled`` holds id, text and label of training rows only."""
    small_batches(docs.sparkSession)
    model = learn(labelled, id_col, text_col, label_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = _events(model.lexicon)
        for b in batches:
            scores = [model.score(events(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return base.mapInArrow(scored, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")


def reject_toxic(docs: DataFrame, labelled: DataFrame, threshold: float = 0.7, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    small_batches(docs.sparkSession)
    model = learn(labelled, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = _events(model.lexicon)
        for b in batches:
            yield b.filter(pa.array([model.score(events(t.as_py())) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
