"""Spelling variants: words one edit apart, found with Aho-Corasick automata over halves of words.

Two words are near if exactly one code point inserted, deleted or replaced makes one of the other.

Method
    1. Words are counted in the tasks that read the texts, and the counts added up: what is shuffled is a row for each
       word and task, whatever the word's frequency.
    2. A word has two segments, its halves. One edit leaves one of them whole, and at its place: the first half at the
       start, the second at the end. Segments are dealt to shards by hash, and each word is sent to the shards of the
       segments that it could have in common with a word of a length that differs by one at most; that is four segments,
       whatever the vocabulary.
    3. A shard builds an automaton of its segments and scans its words. An occurrence counts where it stands at the start
       or at the end as the segment does in its own word, and where the lengths allow one edit. What is left of the words
       beside the segment is compared by hiding one place, so the pairs of words with a common segment are not listed,
       only those that are near. A shard gives a word one row: how many it found near to it, and the best of them.
    4. A segment that more than ``HOT`` words have is narrowed by the halves of what is left beside it: one of these is
       whole as well. So a shard has a bounded number of words for each segment.
    5. The last word along the forms is found by doubling steps until nothing changes; each step is written.

A pair is found by the first of the word's segments that the other one shares, so it is counted once.

Cases
    Null or empty text, or text without letters: no words. Null doc_id: reads as an empty one where the doc_id decides.
    Rows that share a doc_id, equal or not, are counted each. Very long texts are read by one task, as a whole. Empty
    table: no rows. Of equally frequent near words the smallest in code-point order is the best. Other columns are
    ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm._memory import released
from faultline.llm._store import bounded_batches, dropped, stored

#: Code points and occurrences that a word has at least; how many times as frequent its form is.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
#: One run of letters in so many loses a code point, by a hash of doc_id and run.
ONE_IN = 199
#: Words of a task that are counted before the counts are passed on.
COUNTED = 200_000
#: Words for each shard, and words with one segment from which it is narrowed.
SHARD_WORDS, HOT = 100_000, 20_000
#: Narrowed segments that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Runs that can have a word of the least length; runs of letters are maximal.
_RUNS = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([*counts.keys()], pa.string()), pa.array([*counts.values()], pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = (text.as_py() or "").encode("utf-8").lower().decode("utf-8")  # bytes: only A-Z change
            state = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, n in Counter(_RUNS.findall(text)).items():
                h = zlib.crc32(run.encode("utf-8"), state)
                if h % ONE_IN == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LENGTH:
                        continue
                counts[run] += n
        if len(counts) > COUNTED:
            yield flush()
    yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(released(_counts), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _halves(size: Column) -> list[Column]:
    """What a word of ``size`` has in front and behind in each of its segments."""
    half = F.floor(size / 2).cast("int")
    return [F.struct(half.alias("front"), F.lit(0).alias("behind")), F.struct(F.lit(0).alias("front"), (size - half).cast("int").alias("behind"))]


def _narrowed(rest: Column) -> list[Column]:
    """The segment of a row and either half of the ``rest`` beside it."""
    half = F.floor(rest / 2).cast("int")
    return [F.struct((F.col("front") + half).alias("front"), "behind"), F.struct("front", (F.col("behind") + rest - half).cast("int").alias("behind"))]


def _with_key(rows: DataFrame) -> DataFrame:
    size = F.length("word")
    return rows.withColumn("key", F.concat(F.substring("word", F.lit(1), F.col("front")), F.lit("|"), F.substring("word", size - F.col("behind") + 1, F.col("behind"))))


def _dealt(words: DataFrame, shards: int, hot_words: int) -> DataFrame:
    """(shard, held, front, behind, word, n): each word where its segments are held, and where it is to be scanned."""
    size, columns = F.length("word"), ["word", "n"]
    held = _with_key(words.select(*columns, F.lit(True).alias("held"), F.inline(F.array(*_halves(size)))))
    lengths = F.filter(F.sequence(size - 1, size + 1), lambda x: x >= LEAST_LENGTH)
    scanned = _with_key(words.select(*columns, F.lit(False).alias("held"), F.inline(F.array_distinct(F.flatten(F.transform(lengths, lambda x: F.array(*_halves(x))))))))
    hot = stored(held.groupBy("key").count().filter(F.col("count") > hot_words).select("key", F.lit(True).alias("hot")), "spelling-hot")
    n, rows = hot.count(), held.unionByName(scanned)
    if n:
        rows = rows.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, "key", "left")
        rest = F.length("word") - F.col("front") - F.col("behind")
        rests = F.when(F.col("held"), F.array(rest)).otherwise(F.filter(F.sequence(rest - 1, rest + 1), lambda x: x >= 0))
        own = F.struct("front", "behind")
        parts = F.when(F.col("hot"), F.array_distinct(F.flatten(F.transform(rests, lambda x: F.array(*_narrowed(x)))))).otherwise(F.array(own))
        rows = _with_key(rows.select(*columns, "held", F.inline(parts)))
    return rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "held", "front", "behind", "word", "n")


def earlier_segments(size: int, front: int, behind: int) -> list[tuple[int, int]]:
    """The segments of a word that come before this one, of which only those that this one can occur together with."""
    half = size // 2
    if behind == 0:
        return []
    if front == half:
        return [(half + (size - half) // 2, 0)]
    return [(half, 0)] + ([(half // 2, size - half)] if front == 0 and behind > size - half else [])


def _shares(word: str, other: str, front: int, behind: int) -> bool:
    """Whether ``other`` has this segment of ``word``."""
    return len(other) >= front + behind and other.startswith(word[:front]) and other.endswith(word[len(word) - behind :])


def _less_one(x: str) -> list[str]:
    """``x`` with each of its places left out in turn."""
    return [x[:i] + x[i + 1 :] for i in range(len(x))]


def near_in_group(held: list[str], scanned: list[str], front: int, behind: int) -> Iterator[tuple[str, str]]:
    """(scanned, held) of the near ones among words that share the segment."""
    rest = {w[front : len(w) - behind]: w for w in held}
    hidden, shorter = defaultdict(list), defaultdict(list)
    for r, w in rest.items():
        less = _less_one(r)
        for i, x in enumerate(less):
            hidden[i, x].append(w)
        for x in {*less}:
            shorter[x].append(w)
    for v in scanned:
        r = v[front : len(v) - behind]
        less = _less_one(r)
        for i, x in enumerate(less):
            for w in hidden.get((i, x), ()):
                if w != v:
                    yield v, w
        for w in shorter.get(r, ()):
            yield v, w
        for x in {*less}:
            if x in rest:
                yield v, rest[x]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard: (word, n_near, form_n, form) of the words that it finds others near to."""
    counts, groups, scanned = {}, {}, set()
    for batch in batches:
        for held, front, behind, word, n in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
            counts[word] = n
            if held:
                groups.setdefault((word[:front], word[len(word) - behind :] if behind else ""), ([], []))[0].append(word)
            else:
                scanned.add(word)
    automaton = ahocorasick.Automaton()
    for segment in {s for key in groups for s in key if s}:
        automaton.add_word(segment, segment)
    if groups:
        automaton.make_automaton()
        for v in scanned:
            fronts, ends, last = [""], [""], len(v) - 1
            for end, segment in automaton.iter(v):
                if end + 1 == len(segment):
                    fronts.append(segment)
                if end == last:
                    ends.append(segment)
            for f in fronts:
                for e in ends:
                    group = groups.get((f, e))
                    if group and len(f) + len(e) <= len(v):
                        group[1].append(v)
    number, best = Counter(), {}
    for (f, e), (held, found) in groups.items():
        for v, w in near_in_group(held, found, len(f), len(e)):
            if any(_shares(w, v, *s) for s in earlier_segments(len(w), len(f), len(e))):
                continue
            number[v] += 1
            key = (-counts[w], w)
            if v not in best or key < best[v]:
                best[v] = key
    words = [*number]
    columns = [words, [number[v] for v in words], [-best[v][0] for v in words], [best[v][1] for v in words]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame, shards: int | None = None, hot_words: int = HOT) -> DataFrame:
    """(word, n_near, form_n, form) for each of the stored ``words`` (word, n) that has near ones: their number, and the most frequent of them."""
    spark = words.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // SHARD_WORDS))
    rows = _dealt(words, shards, hot_words).repartitionById(shards, "shard")
    found = rows.mapInArrow(released(_near), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("form_n"), "b.form")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the last word along the forms (word, form) of each word that has one. A form is more frequent than its word, so there is no way round."""
    known = stored(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        above = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(known.join(above, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-forms")
        dropped(known)
        known = step
        if step.filter("moved").isEmpty():
            return known.select("word", "root")


def spelling_variants(docs: DataFrame, shards: int | None = None, hot_words: int = HOT) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``docs`` (doc_id, text) that is long and frequent enough.

    form is the most frequent near word, if it is ``FORM_FACTOR`` times as frequent as the word, with form_n its count;
    root the last word along the forms, the word itself where it has none; n_near the number of near words.
    """
    words = stored(word_counts(docs), "spelling-words")
    near = words.join(near_words(words, shards, hot_words), "word", "left")
    some = F.col("form_n") >= FORM_FACTOR * F.col("n")
    out = stored(near.select("word", F.when(some, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(some, F.col("form_n")).alias("form_n")), "spelling-near")
    dropped(words)
    roots = last_forms(out.filter("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
