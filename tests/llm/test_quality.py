import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm.quality_model import quality_scores
from faultline.llm.quality_rules import COUNTS, GRIDS, RISK, _certified, cutoffs, quality_filtered, quality_verdicts
from faultline.llm.toxicity import DIRECTED, INSULT, INSULTS, NEGATED, PRIOR, REPORTED, THREAT, _features, clause_sums, learn_terms, machine_of, run_clause, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(covered)


def test_counts(spark, docs, labels, odd, nothing):
    extra = spark.createDataFrame([(1, "a b c a b c a"), (2, "x x x x"), (3, "x x x"), (4, "a\nb\n a\na\n\n\n"), (5, "日本 # é$ \U0001f600"), (6, "  a b \x0b c")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    for df in (docs, odd, extra):
        rows = quality_verdicts(df, labels).collect()
        got = sorted(repr((r.doc_id, *[r[c] for c in COUNTS[:5]], r.base_failed)) for r in rows)
        expected = []
        for r in df.collect():
            c = plain_counts(r.text)
            expected.append(repr((r.doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])))
        assert got == sorted(expected)
        assert not [r for r in rows if r.base_failed and r.kept]
    assert quality_verdicts(nothing, labels).count() == 0 and quality_verdicts(docs, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_filter_keeps_columns(docs, labels, odd):
    for df in (docs, odd):
        out = quality_filtered(df, labels)
        assert out.columns == df.columns and out.count() == quality_verdicts(df, labels).filter("kept").count()


def binomial_cdf(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_exact_bound(spark):
    cases = [(n, k) for n in (1, 50, 400, 2000) for k in (0, 1, 3, 10, 19) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("level", F.lit(0.01))
    for r in df.select("n", "k", _certified("n", "k", 0.02, "level").alias("ok")).collect():
        assert r.ok == (binomial_cdf(r.k, r.n, 0.02) <= 0.01 and r.k < 0.02 * r.n)


def test_cutoffs_control_risk(spark):
    """Chosen cutoffs are certified ones; over fresh data the good documents lost stay within the risk."""
    r = random.Random(5)

    def rows(n):
        for i in range(n):
            good = r.random() < 0.8
            yield "big" if i % 10 else "small", good, {k: 0.0 for k in GRIDS} | {"symbols": min(1.0, r.expovariate(60 if good else 6)), "short_words": -5.0}

    schema = "stratum string, good boolean, values map<string,double>"
    chosen = {x.stratum: x.cutoffs for x in cutoffs(spark.createDataFrame([*rows(30000)], schema)).collect()}
    assert set(chosen) == {"big", "small"} and set(chosen["big"]) == {"symbols"}
    fresh = [*rows(30000)]
    for stratum, cut in chosen.items():
        good = [v for s, g, v in fresh if s == stratum and g]
        assert sum(v["symbols"] > cut["symbols"] for v in good) <= 1.2 * RISK * len(good)
    few = cutoffs(spark.createDataFrame([*rows(60)], schema)).collect()
    assert few == []


def test_copies_are_no_evidence(spark):
    """Labelled copies count once, so what is too little to certify a cutoff stays too little; a text with any bad label is not good."""
    r = random.Random(8)
    text = lambda bad: " ".join(f"{r.choice('abcdefgh')}{'word' * 2}{'#$%' if bad and i % 2 else ''}{r.randrange(10**6)}" for i in range(60))
    few, lang = [(text(i < 10), i >= 10) for i in range(60)], F.lit("en")
    rows = [(100 * k + i, t, int(good)) for k in range(40) for i, (t, good) in enumerate(few)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("lang", lang)
    assert quality_verdicts(df.drop("quality"), df.select("doc_id", "quality")).filter("failed_rules <> ''").count() == 0
    many = [(i, text(i < 200), int(i >= 200)) for i in range(2400)]
    df = spark.createDataFrame(many, "doc_id long, text string, quality int").withColumn("a.b c", lang)
    verdicts = quality_verdicts(df.drop("quality"), df.select("doc_id", "quality"))
    assert verdicts.filter("doc_id < 200 and failed_rules <> ''").count() == 200 and verdicts.filter("doc_id >= 200 and not kept").count() <= 0.02 * 2200
    kept = quality_filtered(df.drop("quality"), df.select("doc_id", "quality"))
    assert kept.columns == ["doc_id", "text", "a.b c"] and kept.count() == verdicts.filter("kept").count()


def accuracy(df, labels, column):
    rows = df.join(labels, "doc_id").filter("held_out").collect()
    return sum(r.predicted == r[column] for r in rows) / len(rows)


def ranking(df, labels, column):
    """How often a held-out row of label 1 scores above one of label 0, ties counting half."""
    rows = df.join(labels, "doc_id").filter("held_out").collect()
    one, zero = (np.array([r.score for r in rows if r[column] == x]) for x in (1, 0))
    return float(np.mean((one[:, None] > zero[None, :]) + 0.5 * (one[:, None] == zero[None, :])))


@pytest.fixture(scope="module")
def larger(spark):
    """Some thousand labelled documents."""
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_quality_model(larger, odd, nothing):
    docs, labels = larger
    scores = quality_scores(docs, labels)
    assert accuracy(scores, labels, "quality") >= 0.93 and ranking(scores, labels, "quality") >= 0.98
    assert scores.filter("score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0
    assert quality_scores(odd, labels).count() == odd.count() and quality_scores(nothing, labels).count() == 0
    assert {r.score for r in quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_read(spark, larger):
    """Turning held-out labels round changes no score, nor does another lang or source."""
    docs, labels = larger
    turned = labels.withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    for c in ("quality", "toxic"):
        turned = turned.withColumn(c, F.when(F.col("held"), 1 - F.col(c)).otherwise(F.col(c)))
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    for f in (quality_scores, toxicity):
        a, b = ({r.doc_id: round(r.score, 9) for r in f(d, x).collect()} for d, x in ((docs, labels), (other, turned.drop("held"))))
        assert a == b


def test_toxicity(larger, odd, nothing):
    docs, labels = larger
    scores = toxicity(docs, labels)
    assert accuracy(scores, labels, "toxic") >= 0.93 and ranking(scores, labels, "toxic") >= 0.92
    assert scores.filter("score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0
    rows = toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows}) == 1 and rows[0].predicted == 0
    assert toxicity(nothing, labels).count() == 0 and toxicity(odd, labels.limit(0)).count() == odd.count()


def test_grammar():
    # G is a target, T a threat.
    assert run_clause(list("GOI")) == ["G", "O", DIRECTED] and run_clause(list("IOG")) == [DIRECTED, "O", "G"]
    assert run_clause(list("OI")) == ["O", INSULT]
    assert run_clause(list("NOI")) == ["N", "O", NEGATED]
    assert run_clause(list("ROOOOI"))[-1] == REPORTED
    assert run_clause(list("TG"))[0] == THREAT and run_clause(list("TO"))[0] == "O"
    assert run_clause(list("NTG"))[1] == NEGATED
    terms = (("idiot", False, 2.0), ("chll", True, 1.0))
    sums = clause_sums("You idiot. The plan is sound: not an idiot! He said idiot, x\nchllado idiotic", machine_of(terms))
    # insult, directed, negated, reported, threat; idiotic is another word.
    assert sums == [1.0, 2.0, 2.0, 2.0, 0.0]


def test_a_word_alone():
    """An insult without a target counts only after another match of the text."""
    m = machine_of([("idiot", False, 1.5), ("moron", False, 1.0)])
    assert clause_sums("a fine idiot stood there", m) == [0, 0, 0, 0, 0]
    assert clause_sums("a fine idiot stood there. And a moron", m) == clause_sums("a fine idiot, a moron", m) == [1.0, 0, 0, 0, 0]
    assert clause_sums("You idiot. A moron", m) == [1.0, 1.5, 0, 0, 0] and clause_sums("He said idiot. A moron", m) == [0, 0, 0, 1.5, 0]


def test_grammar_matters():
    """Ablation: with the grammar, prior weights part what is meant from what is told, denied or a word alone; without it they do not."""
    r = random.Random(6)
    insult, filler = lambda: r.choice(INSULTS), lambda n: " ".join(r.choice("plan house river green table walked early morning".split()) for _ in range(n))
    toxic = [f"{filler(9)}. you are a {insult()} and {insult()}, {filler(3)}. I will kill you {filler(2)}" if i % 2 else f"{filler(5)} {insult()} {insult()}. these people are {insult()} {filler(4)}" for i in range(40)]
    clean = [f"{filler(5)}. he said that {filler(3)} {insult()}. {filler(4)}. you are not {insult()}" if i % 2 else f"{filler(6)} a {insult()} stood there. to kill time {filler(3)}" for i in range(40)]
    m = machine_of([(w, False, 1.5) for w in INSULTS])

    def right(grammar):
        scores = lambda texts: _features(np.array([clause_sums(t, m, grammar) for t in texts])) @ PRIOR
        good, bad = scores(clean), scores(toxic)
        return float(np.mean(bad[:, None] > good[None, :])), float(np.mean(np.concatenate((bad > 0, good <= 0))))

    with_grammar, without = right(True), right(False)
    assert with_grammar[0] == 1.0 and with_grammar[1] >= 0.95
    assert without[1] <= 0.8


def test_long_clauses():
    """Clauses are read to their marks, however long."""
    m, far = machine_of([("idiot", False, 1.5)]), "wort " * 300
    assert clause_sums(f"He said {far} idiot", m) == clause_sums("He said idiot", m) != clause_sums("you idiot", m)
    assert clause_sums(f"He said {far} idiot {far} idiot", m) == clause_sums("He said idiot wort idiot", m)
    # 400 characters after the first hit a cut would fall between the threat and its target.
    between = "wort " * 78
    threat = clause_sums(f"idiot {between}kill you", m)
    assert threat[[INSULT, DIRECTED, NEGATED, REPORTED, THREAT].index(THREAT)] == 1
    assert clause_sums(f"He said {far}. you {far} idiot idiot", m) == clause_sums("idiot idiot", m)


def test_all_terms_are_kept(spark):
    """No number of learned terms drives out a seed or another term."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    learned = {name(i) for i in range(4200)}
    rows = [(f"{' '.join(sorted(learned))} w{c}" if label else f"clean {c}", label) for c in "abcdefgh" for label in (1, 0) for _ in range(3)]
    sample = spark.createDataFrame([(" ".join(random.Random(i).sample(text.split(), len(text.split()))), label) for i, (text, label) in enumerate(rows)], "text string, label int")
    found = {t for t, stem, _ in learn_terms(sample, 24, 24) if not stem}
    assert learned | set(INSULTS) <= found
