"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Base rules are fixed. On top of them each measure of a text (share of symbols, of repeated lines, of words in
repeated windows, of capitals, mean word length, few words) has a cutoff for each stratum (the language). Cutoffs
are learned from labelled rows: of a grid that runs from the mildest to the strictest, a cutoff is certified if the
exact binomial test rejects "this rule drops more than RISK / rules of the good documents of the stratum" at the
level DELTA / (strata * rules), and all milder ones are certified (fixed-sequence testing within a grid, Bonferroni
between grids). So with probability 1 - DELTA no stratum loses more than RISK of its good documents to the learned
rules. The bound presumes independent rows, so of labelled rows each doc_id counts once and each text of a stratum once,
good only if all its labels are. Of the certified cutoffs, the one with the most bad less good documents dropped is used, the mildest of equals;
a stratum with too few labels to certify anything has no learned rule.

Cases
    Null or empty text: no words, all measures 0, base_failed. Null lang: a stratum of its own. Labels with a null
    quality or without a document are ignored; no labels, or an empty table: base rules alone. Repeated rows are
    judged one by one; of several labels of a doc_id the worst counts, of several rows of a labelled doc_id the one with
    the smallest hash. Null doc_id: judged, never used to learn. Without a lang column all documents are one stratum.
    Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm._store import by_position, stored

RISK, DELTA = 0.02, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SPACE = " \t\n\x0b\f\r"
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines"]
#: Each rule drops a text whose value is over the cutoff. Grids run from the mildest cutoff to the strictest.
GRIDS: dict[str, list[float]] = {
    "symbols": [0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "repeated_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2],
    "repeated_words": [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "capitals": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "long_words": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0],
    "short_words": [-1.2, -1.5, -2.0, -2.2, -2.5, -2.8, -3.0, -3.2],
}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeated(words: Column, n: Column) -> Column:
    """Words that lie in a window of three words found twice or more."""

    def covered(found: Column) -> Column:
        last = F.size(found) - 1
        starts = F.filter(
            F.transform(found, lambda x, k: F.when(((k > 0) & (F.get(found, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(found, k + 1)["h"] == x["h"])), x["i"])),
            lambda i: i.isNotNull(),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    windows = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    count = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)))
    return F.when(n < 4, 0).otherwise(count)


def measured(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``columns`` of ``docs`` as the struct ``doc``, with doc_id, stratum, a hash and the counts of the whole text; and each column's name in the struct."""
    rows, name = by_position(docs)
    text = F.coalesce(F.col(name["text"]).cast("string"), F.lit(""))
    stratum = F.coalesce(F.col(name["lang"]).cast("string"), F.lit("\0null")) if "lang" in name else F.lit("")
    # Each level is used several times by the next, so the optimizer keeps it as a projection of its own.
    own = ["doc", "doc_id", "stratum", "source"]
    df = rows.select(F.struct(*[name[c] for c in columns]).alias("doc"), F.col(name["doc_id"]).cast("long").alias("doc_id"), stratum.alias("stratum"), F.xxhash64(text).alias("source"), text.alias("t"))
    df = df.select(*own, "t", F.btrim("t", F.lit(_SPACE)).alias("trimmed"))
    df = df.select(*own, "t", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", _SPACES)).alias("words"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("lines"))
    n = F.size("words")
    df = df.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words"), n).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("t", "[^\\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    return df, name


def _values() -> Column:
    """Map of rule to value; a measure of nothing is 0."""
    chars, words, lines = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    length = F.col("word_chars") / words
    values = {"symbols": F.col("n_symbols") / chars, "repeated_lines": F.col("n_dup_lines") / lines, "repeated_words": F.col("n_repeat_words") / words, "capitals": F.col("n_capitals") / chars, "long_words": length, "short_words": -length}
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])


def _certified(n: str, k: str, risk: float, level: str) -> Column:
    """Whether P(Binomial(n, risk) <= k) <= level, by summing the exact terms in logarithms."""
    return F.expr(
        f"case when {k} >= {risk}D * {n} then false else aggregate(sequence(0L, {k}), named_struct('t', {n} * ln(1 - {risk}D), 's', 0D), "
        f"(a, j) -> named_struct('t', a.t + ln(greatest({n} - j, 1L) / (j + 1D)) + ln({risk}D / (1 - {risk}D)), 's', a.s + exp(a.t)), a -> a.s <= {level}) end"
    )


def cutoffs(values: DataFrame, risk: float = RISK, delta: float = DELTA, grids: dict[str, list[float]] = GRIDS) -> DataFrame:
    """(stratum, cutoffs: map of rule to cutoff) from labelled rows of (stratum, good, values)."""
    grid = F.create_map(*[x for k, v in grids.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rules = len(grids)
    long = values.select("stratum", "good", F.explode("values").alias("rule", "value"))
    # How many cutoffs of the grid a row exceeds: the mildest that many drop it.
    counts = long.select("stratum", "good", "rule", F.size(F.filter(F.element_at(grid, F.col("rule")), lambda c: F.col("value") > c)).alias("passed")).groupBy("stratum", "rule", "passed").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    own = Window.partitionBy("stratum", "rule")
    strict = own.orderBy(F.col("step").desc())
    total = counts.groupBy("stratum").agg((F.sum("good") / rules).cast("long").alias("n"))
    strata = total.agg(F.count(F.lit(1)).alias("strata"))
    steps = counts.select("stratum").distinct().select("stratum", F.explode(F.create_map(*[x for k, v in grids.items() for x in (F.lit(k), F.lit(len(v)))])).alias("rule", "last")).select("stratum", "rule", F.explode(F.sequence(F.lit(1), "last")).alias("step"))
    # Step s drops the rows that exceed s cutoffs of the grid or more: the last step is the mildest, its first cutoff.
    rows = steps.join(counts.withColumnRenamed("passed", "step"), ["stratum", "rule", "step"], "left").na.fill(0, ["good", "bad"])
    rows = rows.withColumn("k", F.sum("good").over(strict)).withColumn("b", F.sum("bad").over(strict)).join(total, "stratum").join(F.broadcast(strata))
    rows = rows.withColumn("level", F.lit(delta) / (rules * F.col("strata"))).withColumn("ok", _certified("n", "k", risk / rules, "level"))
    rows = rows.withColumn("ok", F.min("ok").over(strict)).filter("ok and b > k")
    best = rows.groupBy("stratum", "rule").agg(F.max_by("step", F.struct(F.col("b") - F.col("k"), F.col("step"))).alias("step"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.get(F.element_at(grid, F.col("rule")), F.size(F.element_at(grid, F.col("rule"))) - F.col("step"))))).alias("cutoffs"))


def judged(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """``counts`` (of :func:`measured`) with base_failed, kept and failed_rules.

    ``counts`` is read twice, so it should be stored. ``labels`` are the labelled holdout; to validate on some of them, leave them out.
    """
    rows = counts.withColumn("values", _values())
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    # Rows that fail the base rules are gone in any case; the cutoffs are for the others. Copies are no evidence of their own.
    learn = rows.filter(~F.col("base_failed")).select("doc_id", "stratum", "source", "values").join(known, "doc_id")
    learn = learn.groupBy("doc_id").agg(F.min_by(F.struct("stratum", "source", "values", "quality"), F.struct("source", "stratum")).alias("r")).select("r.*")
    learn = learn.groupBy("stratum", "source").agg(F.first("values").alias("values"), (F.min("quality") == 1).alias("good")).select("stratum", "good", "values")
    chosen = stored(cutoffs(learn), "quality-cutoffs", small=True)
    rows = rows.join(chosen, "stratum", "left")
    failed = F.coalesce(F.map_keys(F.map_filter("cutoffs", lambda rule, cutoff: F.element_at(F.col("values"), rule) > cutoff)), F.array().cast("array<string>"))
    return rows.withColumn("failed_rules", F.array_sort(failed)).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept and the learned rules that it fails."""
    counts, name = measured(docs, ["doc_id"])
    return judged(stored(counts, "quality-counts"), labels).select(F.col(f"doc.{name['doc_id']}").alias("doc_id"), *COUNTS[:5], "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def quality_filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    counts, _ = measured(docs, docs.columns)
    return judged(stored(counts, "quality-documents"), labels).filter("kept").select("doc.*").toDF(*docs.columns)
