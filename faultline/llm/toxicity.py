"""Toxicity by a weighted finite-state grammar over clauses.

Method
    Words become symbols: insult, threat, target, negation, report, other. The transducers of ``GRAMMAR`` rewrite them
    by what stands around: an insult near a target becomes a directed one, after a negation a negated one, in reported
    speech a reported one, and a threat counts only with a target after it. The composed machine runs over each clause
    that has an insult or a threat. A last transducer runs over what the clauses of a text have written: an insult that
    has no target is one word alone, and counts only where an insult or threat stands before it in the text. Weights are
    summed by kind, and a logistic layer over the sums of a document gives its score. So a document's score comes from
    what the grammar accepts, never from a word alone.
    Insults are a seed list and what labels teach: words, and stems of four letters or more, that are
    significantly commoner in toxic documents of the training sample. The sample is at most ``SAMPLE`` rows of either
    class, none of them held out; labels beyond it and ids, languages and sources are never read.

Cases
    Null or empty text: no clause matches, so the score is that of clean text. No usable labels (or an empty table):
    seeds and prior weights alone. Repeated rows are scored alike; a null doc_id is scored and never learned from.
    Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm._labels import held_out, labelled, sampled, training_sample
from faultline.llm._store import bounded_batches

SAMPLE = 6000
CUTOFF = 0.3
#: A learned term stands in at least so many surroundings in toxic documents, is so much commoner there, makes up this
#: share of all at the labels' own rates, and is due to chance with at most this probability.
LEAST_TOXIC, LEAST_RATIO, LEAST_SHARE, CHANCE = 4, 20.0, 0.8, 1e-6
STEMS = (4, 5, 6, 7, 8)

# Seed words of the transducers in four languages.
INSULTS = """
abruti abschaum arschloch basura cabrón clown connard crétin cretin disgusting dumm dummkopf dumb débile estúpido fool
gilipollas hurensohn idiot idiota idiote imbecile imbécil imbécile jerk loser moron pathetic salope scum scumbag
stupid trash trottel vermin widerlich worthless wertlos
""".split()
THREATS = "kill murder hurt destroy stab strangle tuer frapper töten umbringen matar golpear".split()
TARGETS = "you your yours u he she they them him her tu toi vous te ton ihr du dich euch sie él ella ustedes tú vosotros these those people".split()
NEGATIONS = "not no never without hardly isn don doesn didn wasn aren nicht kein keine nie pas jamais sans ne nunca jamás sin".split()
REPORTS = "said says called quoted wrote reported alleged claims claimed sagte dit disait écrit dijo dice gesagt quote".split()

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE_END = re.compile(r"[.!?;:\n|]")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITGNRO"
DIRECTED, NEGATED, REPORTED = "DXQ"
KINDS = [INSULT, DIRECTED, NEGATED, REPORTED, THREAT]
#: Prior weights of the logistic layer: bias, then by kind.
PRIOR = np.array([-3.5, 2.2, 2.8, 0.6, 0.6, 2.5])


class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives the next state and the symbol written."""

    def __init__(self, start, step):
        self.start, self._step, self._known = start, step, {}

    def step(self, state, symbol):
        key = (state, symbol)
        if key not in self._known:
            self._known[key] = self._step(state, symbol)
        return self._known[key]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, ``other`` reads."""

        def step(state, symbol):
            a, written = self.step(state[0], symbol)
            b, out = other.step(state[1], written)
            return (a, b), out

        return Transducer((self.start, other.start), step)


class Rule(NamedTuple):
    """Symbols that follow ``trigger`` within ``reach`` words (0: to the end of the clause) are rewritten."""

    trigger: str
    reach: int
    rewrite: dict[str, str]


#: Threats that a target follows, in the reading from the end of the clause.
AIMED = "t"
#: The clause is read once from its end, then by the others from its start, each over what the one before has written.
GRAMMAR = {
    "target behind": Rule(TARGET, 4, {INSULT: DIRECTED, THREAT: AIMED}),
    "target before": Rule(TARGET, 4, {INSULT: DIRECTED}),
    "negation": Rule(NEGATION, 3, {INSULT: NEGATED, DIRECTED: NEGATED, THREAT: NEGATED}),
    "report": Rule(REPORT, 0, {INSULT: REPORTED, DIRECTED: REPORTED, THREAT: REPORTED}),
}


def near(rule: Rule) -> Transducer:
    def step(state, symbol):
        if symbol == rule.trigger:
            return rule.reach or -1, symbol
        out = rule.rewrite.get(symbol, symbol) if state else symbol
        return (state - 1 if state > 0 else state), out

    return Transducer(0, step)


BACKWARD, *_forward = map(near, GRAMMAR.values())
FORWARD = reduce(Transducer.then, _forward)
#: Over the symbols of a whole text: an insult without a target needs one before it.
ACCUMULATION = Transducer(False, lambda before, symbol: (before or symbol in (INSULT, DIRECTED, THREAT), OTHER if symbol == INSULT and not before else symbol))


def run_clause(symbols: list[str]) -> list[str]:
    """What the composed transducers write for a clause."""
    state, back = BACKWARD.start, []
    for s in reversed(symbols):
        state, out = BACKWARD.step(state, s)
        back.append({THREAT: OTHER, AIMED: THREAT}.get(out, out))
    state, written = FORWARD.start, []
    for s in reversed(back):
        state, out = FORWARD.step(state, s)
        written.append(out)
    return written


def machine_of(terms: Iterable[tuple[str, bool, float]]) -> ahocorasick.Automaton:
    """Finds insults (whole words or stems) and threats in lower-cased text; built once a task."""
    automaton = ahocorasick.Automaton()
    for term, stem, weight in terms:
        automaton.add_word(term, (len(term), stem, weight, INSULT))
    for term in THREATS:
        if term not in automaton:
            automaton.add_word(term, (len(term), False, 1.0, THREAT))
    automaton.make_automaton()
    return automaton


_FUNCTION = {w: s for s, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in words}


def clause_sums(text: str, machine: ahocorasick.Automaton, grammar: bool = True) -> list[float]:
    """Summed weights of a text's matched clauses by kind; without ``grammar`` every insult and threat counts as it stands."""
    text = text.lower()
    hits: dict[int, tuple[float, str]] = {}
    n = len(text)
    for end, (size, stem, weight, symbol) in machine.iter(text):
        start = end - size + 1
        if (start and text[start - 1].isalpha()) or (not stem and end + 1 < n and text[end + 1].isalpha()):
            continue
        if start not in hits or hits[start][0] < weight:
            hits[start] = (weight, symbol)
    sums = dict.fromkeys(KINDS, 0.0)
    done, state = 0, ACCUMULATION.start
    for start in sorted(hits):
        if start < done:
            continue
        # The clause around the hit, however long: back to the last mark and on to the next one.
        low = done
        for m in _CLAUSE_END.finditer(text, done, start):
            low = m.end()
        m = _CLAUSE_END.search(text, start)
        done = m.end() if m else n
        words = [(w.start(), w[0]) for w in _WORD.finditer(text, low, done)]
        symbols = [hits[at][1] if at in hits else _FUNCTION.get(w, OTHER) for at, w in words]
        for (at, _), out in zip(words, run_clause(symbols) if grammar else symbols):
            if grammar:
                state, out = ACCUMULATION.step(state, out)
            if out in sums:
                sums[out] += hits[at][0]
    return [sums[k] for k in KINDS]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label by term, summed within the partition; a stem is written with a * at its end."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            stems = {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
            counts[label].update(words | stems)
    terms = [*(counts[0].keys() | counts[1].keys())]
    for i in range(0, len(terms), 50_000):
        part = terms[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[1][t] for t in part], pa.int64()), pa.array([counts[0][t] for t in part], pa.int64())], ["term", "toxic", "clean"])


def _surroundings(candidates: frozenset[str]):
    """Each candidate with the words around its first place in a document, by label: copies give the same ones again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                words, first = ["", *_WORD.findall((text.as_py() or "").lower()), ""], set()
                for before, word, after in zip(words, words[1:], words[2:]):
                    for term in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)):
                        if term in candidates and term not in first:
                            first.add(term)
                            found.add((term, label, f"{before} {after}"))
            terms, labels, around = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32()), pa.array(around, pa.string())], ["term", "label", "around"])

    return run


def _chance(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= k)."""
    terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k, n + 1)]
    return sum(map(math.exp, terms))


def learn_terms(sample: DataFrame, n_toxic: int, n_clean: int, clean_weight: float = 1.0) -> list[tuple[str, bool, float]]:
    """(term, whether a stem, weight): the seeds and all that the sample teaches; the sample bounds them.

    ``clean_weight`` says how many clean labelled rows a sampled one stands for, if a toxic one stands for itself.
    """
    seeds = {w: (0, 0) for w in INSULTS}
    found: dict[str, tuple[int, int]] = {}
    if n_toxic and n_clean:
        counts = sample.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        ratio = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
        rows = counts.filter(F.col("term").isin(INSULTS) | ((F.col("toxic") >= LEAST_TOXIC) & (ratio >= LEAST_RATIO))).select("term").collect()
        around = sample.mapInArrow(_surroundings(frozenset(r.term for r in rows)), "term string, label int, around string").distinct()
        p = n_toxic / (n_toxic + n_clean)
        for r in around.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")).collect():
            if r.term in seeds:
                seeds[r.term] = (r.toxic, r.clean)
            elif r.toxic >= max(LEAST_TOXIC, LEAST_SHARE * (r.toxic + clean_weight * r.clean)) and _chance(r.toxic, r.toxic + r.clean, p) <= CHANCE:
                found[r.term] = (r.toxic, r.clean)

    def weight(toxic, clean):
        # Shrunk towards a ratio of 20 by two documents' worth of belief.
        return min(3.0, max(0.0, math.log((toxic + 2) / (n_toxic + 2) / ((clean + 0.1) / (n_clean + 2)))) / 2)

    out = {w: (w, False, weight(*c) if sum(c) else 1.5) for w, c in seeds.items()}
    stems: list[str] = []
    whole = {w: c for w, c in (seeds | found).items() if not w.endswith("*")}
    for term in sorted((t for t in found if t.endswith("*")), key=lambda t: (len(t), t)):
        # A stem that one word makes up for the most part is that word.
        if not any(term.startswith(s) for s in stems) and not any(w.startswith(term[:-1]) and c[0] >= 0.5 * found[term][0] for w, c in whole.items()):
            stems.append(term[:-1])
            out[term] = (term[:-1], True, weight(*found[term]))
    for term, c in found.items():
        if not term.endswith("*") and not any(term.startswith(s) for s in stems):
            out[term] = (term, False, weight(*c))
    best: dict[str, tuple[str, bool, float]] = {}
    for term, stem, w in sorted(out.values(), key=lambda x: (x[1], -x[2], x[0])):
        if w > 0:
            best.setdefault(term, (term, stem, w))
    return sorted(best.values())


def _features(sums: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones((len(sums), 1)), np.log1p(np.asarray(sums, float))), axis=1)


def fit(sums: np.ndarray, labels: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of the logistic layer, held near the prior; toxic and clean rows weigh alike, weights stay positive."""
    w = PRIOR.copy()
    if not len(labels) or labels.min() == labels.max():
        return w
    x, y = _features(sums), labels.astype(float)
    balance = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - 0.5 * (x.T @ (balance * (p - y)) + 0.002 * (w - PRIOR))
        w[1:] = np.maximum(w[1:], 0)
    return w


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[tuple, np.ndarray]:
    """(terms, weights) from the training sample."""
    sample = training_sample(labels, "toxic", per_class)
    if not sample:
        return tuple(learn_terms(docs, 0, 0)), PRIOR.copy()
    rows = sampled(docs, sample)
    n_toxic = sum(label for _, label in sample)
    n_clean = len(sample) - n_toxic
    usual = labelled(labels, "toxic").groupBy("label").count().collect()
    rate = {r.label: r["count"] for r in usual}
    stands_for = rate.get(0, 0) / max(n_clean, 1) / (rate.get(1, 0) / max(n_toxic, 1) or 1)
    terms = tuple(learn_terms(rows, n_toxic, n_clean, max(1.0, stands_for)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(terms)
        for batch in batches:
            found = [clause_sums(t.as_py() or "", machine) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["label", "sums"])

    got = rows.mapInArrow(sums, "label int, sums array<double>").collect()
    return terms, fit(np.array([r.sums for r in got]).reshape(-1, len(KINDS)), np.array([r.label for r in got]))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and the summed weights by kind of clause match, one row a row of ``docs``."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms, weights = train(docs, labels, per_class)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(terms)
        for batch in batches:
            sums = np.array([clause_sums(t.as_py() or "", machine) for t in batch.column(1)]).reshape(-1, len(KINDS))
            p = 1 / (1 + np.exp(-_features(sums) @ weights))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], ["doc_id", "score", "insult", "directed", "negated", "reported", "threat"])

    out = docs.mapInArrow(score, "doc_id long, score double, insult double, directed double, negated double, reported double, threat double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "insult", "directed", "negated", "reported", "threat")
